"""Assays, activity functions, model statistics and models on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenfunnel.functions import scalars as fn
from screenfunnel.operators import assays, models, stats
from screenfunnel.operators.order import group_quantiles
from screenfunnel.operators.profile import distinct_counts
from screenfunnel.operators.stats import Desirability
from screenfunnel.plans.prioritise import shortlist
from screenfunnel.session import scratch_path
from screenfunnel.queries.base import query, settle, table

# --- assays -----------------------------------------------------------------------------------

# Each event as a measurement of a user ("molecule"), in mixed units, relations and formats.
ASSAYS_SQL = """
    assays AS (
      SELECT event_id, user_id, event_type,
        CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS val,
        CASE WHEN event_type = 'signup' THEN 'uM' WHEN event_type = 'view' THEN 'NM' ELSE 'nM' END AS unit,
        CASE WHEN value > 40 THEN '>=' WHEN value > 30 THEN '<' ELSE '=' END AS rel,
        CASE WHEN value > 20 THEN ' Cell-Free Format ' WHEN value > 15 THEN 'tissue format'
             ELSE 'single protein format' END AS label
      FROM events)
"""


def event_assays(spark: SparkSession, sf: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.when(kind == "error", "n/a").otherwise(v.cast("string")).alias("val"),
        F.when(kind == "signup", "uM").when(kind == "view", "NM").otherwise("nM").alias("unit"),
        F.when(v > 40, ">=").when(v > 30, "<").otherwise("=").alias("rel"),
        F.when(v > 20, " Cell-Free Format ").when(v > 15, "tissue format").otherwise("single protein format").alias("label"),
    )


@query(
    "assay_filter",
    f"""WITH {ASSAYS_SQL}
    SELECT event_id, TRY_CAST(val AS DOUBLE) AS val FROM assays
    WHERE regexp_matches(unit, '(?i)nM') AND contains(rel, '=')
      AND lower(trim(label)) IN ('single protein format', 'cell-free format', 'cell-based format')
      AND TRY_CAST(val AS DOUBLE) IS NOT NULL""",
)
def assay_filter(spark: SparkSession, sf: str) -> DataFrame:
    return assays.assay_filter(event_assays(spark, sf), "val", "unit", "rel", "label").select("event_id", "val")


@query(
    "target_filter",
    """SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')""",
)
def target_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("kind", F.lit(" ic50 "))
    return assays.target_filter(events, ["click", "view"], "event_type", "kind", "value").select(
        "event_id", "event_type", "value"
    )


@query(
    "assay_median_mean",
    """SELECT user_id, floor((median(value)) * 1e4 + 0.5001) / 1e4 AS v_median, floor((avg(value)) * 1e4 + 0.5001) / 1e4 AS v_mean
       FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def assay_median_mean(spark: SparkSession, sf: str) -> DataFrame:
    found = assays.median_mean_by(table(spark, sf, "events"), "user_id", "value", "v")
    return found.select("user_id", settle("v_median", 4).alias("v_median"), settle("v_mean", 4).alias("v_mean"))


@query(
    "assay_outer_summary",
    """WITH x AS (SELECT user_id, median(value) AS md, avg(value) AS mn FROM events
                  WHERE event_type = 'click' GROUP BY user_id),
            y AS (SELECT user_id, median(value) AS md, avg(value) AS mn FROM events
                  WHERE event_type = 'view' GROUP BY user_id),
            tx AS (SELECT user_id, arg_min(props, event_id) AS props FROM events
                   WHERE event_type = 'click' AND props <> '' GROUP BY user_id),
            ty AS (SELECT user_id, arg_min(props, event_id) AS props FROM events
                   WHERE event_type = 'view' AND props <> '' GROUP BY user_id)
       SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(ty.props, tx.props) AS props,
              floor((x.md) * 1e4 + 0.5001) / 1e4 AS click_median, floor((y.md) * 1e4 + 0.5001) / 1e4 AS view_median,
              floor((x.mn) * 1e4 + 0.5001) / 1e4 AS click_mean, floor((y.mn) * 1e4 + 0.5001) / 1e4 AS view_mean
       FROM x FULL OUTER JOIN y ON x.user_id = y.user_id
       LEFT JOIN tx ON tx.user_id = coalesce(x.user_id, y.user_id)
       LEFT JOIN ty ON ty.user_id = coalesce(x.user_id, y.user_id)""",
)
def assay_outer_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    found = assays.assay_summary(
        events.filter("event_type = 'click'"), events.filter("event_type = 'view'"), "user_id", "value", "props", "event_id",
        ("click", "view"),
    )
    numbers = ("click_median", "view_median", "click_mean", "view_mean")
    return found.select("user_id", "props", *[settle(c, 4).alias(c) for c in numbers])


@query(
    "assay_attach",
    """WITH p AS (SELECT * FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, o_totalprice,
                    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1),
            s AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_acctbal AS a_median,
                    CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS DOUBLE) END AS b_median,
                    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a_mean, CAST(c_nationkey AS DOUBLE) AS b_mean FROM customer)
       SELECT o_orderkey, p.k, o_totalprice, a_median, b_median, floor((a_median / b_median) * 1e4 + 0.5001) / 1e4 AS "SI_median",
              a_mean, b_mean, CASE WHEN b_mean <> 0 THEN floor((a_mean / b_mean) * 1e4 + 0.5001) / 1e4 END AS "SI_mean"
       FROM p JOIN s ON p.k = s.k""",
)
def assay_attach(spark: SparkSession, sf: str) -> DataFrame:
    products = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"), "o_totalprice")
    nation = F.col("c_nationkey").cast("double")
    summary = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("sid"),
        F.col("c_custkey").cast("string").alias("k"),
        F.col("c_acctbal").alias("a_median"),
        F.when(nation > 3, nation).alias("b_median"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a_mean"),
        nation.alias("b_mean"),
    )
    found = assays.attach_assays(products, summary, "k", "o_totalprice", "o_orderkey", "sid", ("a", "b"))
    return found.withColumns({c: settle(c, 4) for c in ("SI_median", "SI_mean")})


# --- activity functions -----------------------------------------------------------------------


@query(
    "activity_functions",
    """SELECT event_id, floor((-log10((value - 5) * 1e-9)) * 1e6 + 0.5001) / 1e6 AS p, floor((power(10, 9 - value / 50)) * 1e4 + 0.5001) / 1e4 AS nm,
              value * 20 <= 1000 AS is_active, floor((2 * value - event_id) * 1e4 + 0.5001) / 1e4 AS score,
              CASE WHEN user_id <> 0 THEN floor((value / user_id) * 1e6 + 0.5001) / 1e6 END AS si
       FROM events WHERE value - 5 > 0
       UNION ALL
       SELECT event_id, NULL, floor((power(10, 9 - value / 50)) * 1e4 + 0.5001) / 1e4, value * 20 <= 1000, floor((2 * value - event_id) * 1e4 + 0.5001) / 1e4,
              CASE WHEN user_id <> 0 THEN floor((value / user_id) * 1e6 + 0.5001) / 1e6 END
       FROM events WHERE NOT value - 5 > 0""",
)
def activity_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    v, event = F.col("value"), F.col("event_id").cast("double")
    return e.select(
        "event_id",
        settle(fn.pic50(v - 5), 6).alias("p"),
        settle(fn.ic50_nm(v / 50), 4).alias("nm"),
        fn.active(v * 20).alias("is_active"),
        settle(fn.qsar_score(v, event), 4).alias("score"),
        settle(fn.selectivity(v, F.col("user_id").cast("double")), 6).alias("si"),
    )


@query(
    "numeric_coercion",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN ''
                                 ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events""",
)
def numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "error", "n/a")
        .when(F.col("event_type") == "view", "")
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", fn.number(text).alias("v"))


# --- statistics -------------------------------------------------------------------------------

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
DOMAIN_SQL = """
    p AS (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2,
                 avg(l_discount) m3, stddev_pop(l_discount) s3, avg(l_tax) m4, stddev_pop(l_tax) s4 FROM lineitem),
    d AS (SELECT l_orderkey, l_linenumber, l_partkey,
            sqrt(power((l_quantity - m1) / s1, 2) + power((l_extendedprice - m2) / s2, 2)
               + power((l_discount - m3) / s3, 2) + power((l_tax - m4) / s4, 2)) AS dist FROM lineitem, p),
    c AS (SELECT quantile_cont(dist, 0.95) AS cut FROM d)
"""


@query(
    "scaled_distance_ad",
    f"""WITH {DOMAIN_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, floor((dist) * 1e5 + 0.5001) / 1e5 AS "AD_Distance", dist <= cut AS "In_AD" FROM d, c""",
)
def scaled_distance_ad(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", *FEATURES)
    found = stats.fit_domain(li, FEATURES).transform(li)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", settle("AD_Distance", 5).alias("AD_Distance"), "In_AD")


@query(
    "group_quantile",
    """SELECT l_suppkey, count(*) AS n, floor((quantile_cont(l_extendedprice, 0.95)) * 1e4 + 0.5001) / 1e4 AS q95,
              floor((median(l_extendedprice)) * 1e4 + 0.5001) / 1e4 AS med FROM lineitem GROUP BY l_suppkey""",
)
def group_quantile(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice")
    found = group_quantiles(li, ["l_suppkey"], "l_extendedprice", {"q95": 0.95, "med": 0.5})
    return found.select("l_suppkey", "n", settle("q95", 4).alias("q95"), settle("med", 4).alias("med"))


@query(
    "quantile_cutoff",
    "SELECT count(*) AS n, floor((quantile_cont(l_extendedprice, 0.95)) * 1e4 + 0.5001) / 1e4 AS cut FROM lineitem",
)
def quantile_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    found = group_quantiles(table(spark, sf, "lineitem", "l_extendedprice"), [], "l_extendedprice", {"cut": 0.95})
    return found.select("n", settle("cut", 4).alias("cut"))


@query(
    "array_distance",
    """SELECT vec_id, floor((list_distance(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[])) * 1e6 + 0.5001) / 1e6 AS d
       FROM embeddings""",
)
def array_distance(spark: SparkSession, sf: str) -> DataFrame:
    halves = [F.slice("embedding", at, 32).cast("array<double>") for at in (1, 33)]
    return table(spark, sf, "embeddings").select("vec_id", settle(fn.array_distance(*halves), 6).alias("d"))


# The widest candidate that leaves at least 2 rows per bin, found over 2 … 10 bins.
BINS_SQL = """
    span AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    ks AS (SELECT unnest(range(2, 11)) AS k),
    edges AS (SELECT k, i, CASE WHEN i = k THEN hi ELSE lo + i * ((hi - lo) / k) END AS edge
              FROM ks, span, (SELECT unnest(range(1, 11)) AS i) WHERE i <= k),
    placed AS (SELECT k, l_orderkey, l_linenumber, l_partkey, l_extendedprice, min(i) AS bin
               FROM lineitem JOIN edges ON l_extendedprice <= edge GROUP BY ALL),
    counts AS (SELECT k, bin, count(*) AS n FROM placed GROUP BY k, bin),
    best AS (SELECT max(k) AS k FROM (SELECT k FROM counts WHERE n >= 2 GROUP BY k HAVING count(*) = k))
"""


@query(
    "stratify_bins",
    f"""WITH {BINS_SQL}
    SELECT bin AS stratum, n, k AS n_bins FROM counts JOIN best USING (k)""",
)
def stratify_bins(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice")
    binned = stats.stratify_bins(li, "l_extendedprice")
    # Every bin is filled, so the number of bins is the number of groups (ten at most).
    counts = binned.groupBy("stratum").agg(F.count("*").alias("n"))
    return counts.withColumn("n_bins", F.count("*").over(W.partitionBy()))


@query(
    "stratified_split",
    """WITH h AS (SELECT o_orderkey, o_orderpriority, substr(sha256(o_orderkey || '|42'), 1, 12) AS h FROM orders),
            r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS rn,
                         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM h)
       SELECT o_orderkey, o_orderpriority, rn <= floor(n * 0.2 + 0.5) AS is_test FROM r""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return stats.stratified_split(o, "o_orderpriority", "o_orderkey")


@query(
    "model_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS f FROM lineitem)
       SELECT count(*) AS n_rows, floor((avg(abs(y - f))) * 1e4 + 0.5001) / 1e4 AS mae, floor((sqrt(avg((y - f) * (y - f)))) * 1e4 + 0.5001) / 1e4 AS rmse,
              floor((1 - sum((y - f) * (y - f)) / (var_pop(y) * count(y))) * 1e6 + 0.5001) / 1e6 AS r2 FROM p""",
)
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("f"))
    m = stats.regression_metrics(p, "y", "f")
    return m.select("n_rows", settle("mae", 4).alias("mae"), settle("rmse", 4).alias("rmse"), settle("r2", 6).alias("r2"))


@query(
    "class_accuracy",
    """SELECT floor((avg(CASE WHEN (l_returnflag = 'R')::INT = (l_quantity > 25)::INT THEN 1.0 ELSE 0.0 END)) * 1e6 + 0.5001) / 1e6 AS accuracy
       FROM lineitem""",
)
def class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), (F.col("l_quantity") > 25).alias("f"))
    return stats.accuracy(p, "y", "f").select(settle("accuracy", 6).alias("accuracy"))


@query(
    "desirability",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey,
         (0.1 + 0.9 / (1 + exp(-(l_quantity - 25.0 + 10.0) / 4.0)) * (1 - 1 / (1 + exp(-(l_quantity - 25.0 - 10.0) / 6.0)))) / 0.95 AS d1,
         (0.05 + 1.0 / (1 + exp(-(l_discount - 0.05 + 0.02) / 0.01)) * (1 - 1 / (1 + exp(-(l_discount - 0.05 - 0.02) / 0.02)))) / 1.1 AS d2
         FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, round(exp((0.66 * ln(d1) + 0.34 * ln(d2)) / 1.0), 4) AS "QED" FROM d""",
)
def desirability(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    parts = [
        Desirability("l_quantity", 0.1, 0.9, 25.0, 20.0, 4.0, 6.0, 0.95, 0.66),
        Desirability("l_discount", 0.05, 1.0, 0.05, 0.04, 0.01, 0.02, 1.1, 0.34),
    ]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", stats.desirability(parts).alias("QED"))


@query(
    "distinct_counts",
    """SELECT count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey,
              count(DISTINCT l_orderkey) AS n_l_orderkey FROM lineitem""",
)
def distincts(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_counts(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey"])


# --- models (rows only: the draws are not those of another engine) ------------------------------


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("f1"),
        F.avg("l_extendedprice").alias("f2"),
        F.avg("l_discount").alias("f3"),
        F.avg("l_tax").alias("f4"),
        F.sum("l_extendedprice").alias("IC50_COX2_median"),
        F.min("l_extendedprice").alias("IC50_COX1_median"),
    )


def scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Two lots of trees; how many trees and how deep are parameters, see the README for the time that the defaults take."""
    path = scratch_path(spark, "features")
    part_features(spark, sf).write.parquet(path)
    rows = models.add_targets(spark.read.parquet(path))
    fitted = models.fit_activity_models(rows, ("f1", "f2", "f3", "f4"), "l_partkey", trees=10, depth=5, lot=5)
    return models.score_activity(rows, fitted)


@query("forest_scores")
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_parts(spark, sf).select(
        "l_partkey", "AD_Distance", "In_AD", "pIC50_COX2_pred", "pIC50_COX1_pred", "SI_pred", "QSAR_score"
    )


@query(
    "forest_identities",
    """SELECT l_partkey, true AS nm_of_target, true AS nm_of_off_target, true AS selectivity, true AS score, true AS within_training
       FROM lineitem GROUP BY l_partkey""",
)
def forest_identities(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for the predictions of any forest: the derived columns, and a mean of training values lies among them."""
    rows = scored_parts(spark, sf)
    near = lambda x, y: F.abs(x - y) <= F.lit(1e-9) * F.abs(y)
    c = F.col
    # pIC50 = 9 - log10(nM); a training value of the target is at most 9 - log10 of the least sum.
    least, most = part_features(spark, sf).agg(F.min("IC50_COX2_median"), F.max("IC50_COX2_median")).first()
    return rows.select(
        "l_partkey",
        near(c("IC50_COX2_pred_nM"), F.pow(F.lit(10.0), 9 - c("pIC50_COX2_pred"))).alias("nm_of_target"),
        near(c("IC50_COX1_pred_nM"), F.pow(F.lit(10.0), 9 - c("pIC50_COX1_pred"))).alias("nm_of_off_target"),
        near(c("SI_pred"), c("IC50_COX1_pred_nM") / c("IC50_COX2_pred_nM")).alias("selectivity"),
        (F.abs(c("QSAR_score") - (2 * c("pIC50_COX2_pred") - c("pIC50_COX1_pred"))) < 1e-9).alias("score"),
        c("pIC50_COX2_pred").between(9 - F.log10(F.lit(most)) - 1e-9, 9 - F.log10(F.lit(least)) + 1e-9).alias("within_training"),
    )


@query("cluster_shortlist")
def cluster_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("ID"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)],
        F.get("embedding", F.lit(0)).cast("double").alias("QED"),
        F.abs(F.get("embedding", F.lit(1))).cast("double").alias("PriceMol"),
    ).persist()
    found = shortlist(rows, k=5, features=[f"f{i}" for i in range(64)])
    return found.shortlist.select("ID", "Cluster", "SelectionRank", "Point selected", "CentroidDistance", "QED", "PriceMol")
