"""Rankings, cuts, groups, task grids and profiles on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.operators import groups, profile, ranking, tasks
from screenfunnel.operators.ranking import Component
from screenfunnel.queries.base import query, settle, table

# --- ranking ----------------------------------------------------------------------------------


def norm_sql(value: str, invert: bool, n: str = "count(*) OVER ()") -> str:
    """Average rank of the non-null values, normalised by the number of all rows."""
    rank = (
        f"(rank() OVER (PARTITION BY {value} IS NULL ORDER BY {value}) - 1"
        f" + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0)"
    )
    share = f"{rank} / greatest({n} - 1, 1)"
    return f"CASE WHEN {value} IS NOT NULL THEN {'1 - ' if invert else ''}{share} END"


@query(
    "rank_normalise",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey,
                          CASE WHEN l_discount > 0.09 THEN NULL ELSE l_quantity END AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, q, floor(({norm_sql("q", True)}) * 1e6 + 0.5001) / 1e6 AS norm FROM v""",
)
def rank_normalise(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("l_discount") > 0.09, F.lit(None)).otherwise(F.col("l_quantity"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"))
    return ranking.rank_normalise(li, "q", "l_orderkey", "norm").withColumn("norm", settle("norm", 6))


@query(
    "composite_score",
    f"""WITH c AS (SELECT o_custkey AS id, sum(o_totalprice) AS total, CAST(count(*) AS DOUBLE) AS n,
                          CAST(min(o_orderkey) AS DOUBLE) AS first FROM orders GROUP BY o_custkey),
             s AS (SELECT id, {norm_sql("total", True)} AS a, {norm_sql("n", False)} AS b, {norm_sql("first", True)} AS c FROM c)
        SELECT id, floor((a) * 1e6 + 0.5001) / 1e6 AS total_norm, floor((b) * 1e6 + 0.5001) / 1e6 AS n_norm, floor((c) * 1e6 + 0.5001) / 1e6 AS first_norm,
               round(0.5 * a + 0.4 * b + 0.1 * c, 4) AS final_score FROM s""",
)
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"), F.min("o_orderkey").cast("double").alias("first")
    )
    parts = [
        Component("total", "total_norm", 0.5, True), Component("n", "n_norm", 0.4, False), Component("first", "first_norm", 0.1, True),
    ]
    scored = ranking.composite_score(c, parts, "id")
    return scored.select("id", *[settle(p.out, 6).alias(p.out) for p in parts], "final_score")


@query(
    "md_score",
    f"""WITH s AS (SELECT o_orderkey, {norm_sql("o_totalprice", True)} AS a, {norm_sql("o_custkey", True)} AS b,
                          round(0.2 * (o_totalprice / 100000.0), 4) AS pen FROM orders)
        SELECT o_orderkey, floor((a) * 1e6 + 0.5001) / 1e6 AS norm_rank_cox2, floor((b) * 1e6 + 0.5001) / 1e6 AS norm_rank_cox1, pen AS instability_penalty,
               round(2 * a - b - pen, 4) AS md_score FROM s""",
)
def md_score(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("score_cox2"),
        F.col("o_custkey").cast("double").alias("score_cox1"),
        (F.col("o_totalprice") / 100000.0).alias("instability"),
    )
    found = ranking.md_score(o, "o_orderkey")
    return found.select(
        "o_orderkey",
        settle("norm_rank_cox2", 6).alias("norm_rank_cox2"),
        settle("norm_rank_cox1", 6).alias("norm_rank_cox1"),
        "instability_penalty",
        "md_score",
    )


@query(
    "winnow_topk",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn,
                         count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, o_totalprice, CASE WHEN rn <= least(n, greatest(CAST(floor(n * 0.3) AS BIGINT), 100))
              THEN 'accepted' ELSE 'rejected' END AS decision FROM r""",
)
def winnow_topk(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = ranking.winnow(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.3, 100)
    return accepted.withColumn("decision", F.lit("accepted")).unionByName(rejected.withColumn("decision", F.lit("rejected")))


@query(
    "budget_cascade",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey,
                    CASE WHEN l_discount > 0.09 THEN NULL ELSE l_quantity END AS q,
                    l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem),
            s AS (SELECT *, row_number() OVER (ORDER BY coalesce(q, 'Infinity'::DOUBLE), id) AS rn, count(*) OVER () AS n
                  FROM p WHERE q IS NULL OR q <= 40)
       SELECT id, q, 'max_price' AS reason FROM p WHERE q > 40
       UNION ALL
       SELECT id, q, CASE WHEN rn > floor(n * 0.5) THEN 'acceptance_rate' WHEN rn > 20000 THEN 'max_sample_size' END FROM s""",
)
def budget_cascade(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.when(F.col("l_discount") > 0.09, F.lit(None)).otherwise(F.col("l_quantity"))
    rows = li.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), q.alias("q"))
    accepted, rejected = ranking.budget_cascade(rows, "q", "id", max_price=40.0, rate=0.5, max_rows=20000, out="reason")
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


# --- groups -----------------------------------------------------------------------------------


@query(
    "top_n_per_group",
    """SELECT l_suppkey, l_orderkey, l_extendedprice, l_quantity, rn AS "SelectionRank" FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity, l_orderkey) AS INT) AS rn
         FROM lineitem) WHERE rn <= 5""",
)
def top_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_extendedprice", "l_quantity")
    return groups.top_n_per_group(li, "l_suppkey", 5, "l_extendedprice", "l_quantity", "l_orderkey")


REPRESENTATIVE_SQL = """
    SELECT lang, doc_id, n_chars, 'point_selected:flag' AS "RepresentativeRule" FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END DESC,
                                   n_chars, doc_id) AS rn FROM documents) WHERE rn = 1
    UNION ALL
    SELECT lang, doc_id, n_chars, 'centroid_distance:n_chars' FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, n_chars, doc_id) AS rn FROM documents) WHERE rn = 1
    UNION ALL
    SELECT lang, doc_id, n_chars, 'qed_price_rank' FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(source) DESC, n_chars, doc_id) AS rn FROM documents) WHERE rn = 1
"""


@query("group_representative", REPRESENTATIVE_SQL)
def group_representative(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("source").isin("src1", "src2"), " Yes ").otherwise("no")
    docs = table(spark, sf, "documents").select(
        "lang", "doc_id", "n_chars", flag.alias("flag"), F.length("source").alias("width")
    )

    def pick(**by):
        found = groups.representative_per_group(docs, "lang", score="width", price="n_chars", id_col="doc_id", **by)
        return found.select("lang", "doc_id", "n_chars", "RepresentativeRule")

    return pick(selected_col="flag").unionByName(pick(distance_col="n_chars")).unionByName(pick())


@query(
    "group_summary",
    """SELECT o_orderpriority, count(*) AS "ClusterSize", min(o_totalprice) AS "PriceMolMin",
              floor((median(o_totalprice)) * 1e4 + 0.5001) / 1e4 AS "PriceMolMedian", max(o_totalprice) AS "PriceMolMax",
              CAST(min(o_custkey) AS DOUBLE) AS "QEDMin", CAST(median(o_custkey) AS DOUBLE) AS "QEDMedian",
              CAST(max(o_custkey) AS DOUBLE) AS "QEDMax"
       FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_totalprice, o_custkey
             FROM orders) GROUP BY o_orderpriority""",
)
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    o = table(spark, sf, "orders").select(priority.alias("o_orderpriority"), "o_totalprice", "o_custkey")
    found = groups.summarise_groups(o, "o_orderpriority", "o_totalprice", "o_custkey")
    return found.withColumn("PriceMolMedian", settle("PriceMolMedian", 4))


@query(
    "attach_labels",
    """SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "lang")
    # Documents that nobody has labelled get the label -1, so that the labels are complete.
    known = docs.select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    labels = known.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
    return groups.attach_labels(docs, labels, "doc_id", "quality", ("toxic",))


# --- tasks ------------------------------------------------------------------------------------


@query(
    "task_grid",
    """WITH l AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
            r AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS j, count(*) OVER () AS n FROM region)
       SELECT (i - 1) * n + j AS task_id, CAST(s_suppkey AS VARCHAR) AS ligand_id, r_name AS receptor_id FROM l CROSS JOIN r""",
)
def task_grid(spark: SparkSession, sf: str) -> DataFrame:
    receptors = tasks.receptor_list(table(spark, sf, "region"), "r_name")
    return tasks.task_grid(table(spark, sf, "supplier"), receptors, "s_suppkey", "s_suppkey")


@query(
    "task_grid_of_tables",
    """WITH l AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
            r AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS j, count(*) OVER () AS n FROM customer)
       SELECT (i - 1) * n + j AS task_id, n_name AS ligand_id, c_name AS receptor_id FROM l CROSS JOIN r""",
)
def task_grid_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """More receptors than a list may hold."""
    return tasks.task_grid_of_tables(
        table(spark, sf, "nation"), table(spark, sf, "customer"), "n_name", "n_nationkey", "c_name", "c_custkey"
    )


GRID_SQL = """
    grid AS (SELECT CAST(o_orderkey AS VARCHAR) AS ligand_id, r.receptor_id,
               (row_number() OVER (ORDER BY o_orderkey, r.j)) AS task_id
             FROM orders, (VALUES ('6COX', 1), ('3KK6', 2)) r(receptor_id, j)),
    logs AS (SELECT CAST(l_orderkey AS VARCHAR) AS ligand_id, CASE l_linestatus WHEN 'F' THEN '6COX' ELSE '3KK6' END AS receptor_id,
               count(*) FILTER (WHERE l_quantity > 5) AS n_poses FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
    poses AS (SELECT CAST(l_orderkey AS VARCHAR) AS ligand_id, CASE l_linestatus WHEN 'F' THEN '6COX' ELSE '3KK6' END AS receptor_id,
               sum(CAST(l_quantity AS BIGINT)) * 10 AS n_bytes, max(l_discount) > 0.01 AS has_marker
              FROM lineitem WHERE l_tax > 0.01 GROUP BY 1, 2)
"""


def order_tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A grid of orders × two receptors, with logs and pose files made up of the line items."""
    grid = tasks.task_grid(table(spark, sf, "orders"), ["6COX", "3KK6"], "o_orderkey", "o_orderkey")
    receptor = F.when(F.col("l_linestatus") == "F", "6COX").otherwise("3KK6").alias("receptor_id")
    ligand = F.col("l_orderkey").cast("string").alias("ligand_id")
    li = table(spark, sf, "lineitem")
    logs = li.filter("l_returnflag <> 'N'").groupBy(ligand, receptor).agg(F.count_if(F.col("l_quantity") > 5).alias("n_poses"))
    poses = (
        li.filter("l_tax > 0.01")
        .groupBy(ligand, receptor)
        .agg(
            (F.sum(F.col("l_quantity").cast("long")) * 10).alias("n_bytes"), (F.max("l_discount") > 0.01).alias("has_marker")
        )
    )
    return grid, logs, poses


@query(
    "pending_tasks",
    f"""WITH {GRID_SQL}
    SELECT task_id, ligand_id, receptor_id FROM grid
    WHERE NOT EXISTS (SELECT 1 FROM logs JOIN poses USING (ligand_id, receptor_id)
                      WHERE logs.ligand_id = grid.ligand_id AND logs.receptor_id = grid.receptor_id)""",
)
def pending_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.pending_tasks(*order_tasks(spark, sf)).select("task_id", "ligand_id", "receptor_id")


@query(
    "missing_inputs",
    """SELECT CAST(o_orderkey AS VARCHAR) AS ligand_id, r.receptor_id,
              CASE WHEN o_orderstatus = 'P' THEN 'ligand file missing' ELSE 'receptor file missing' END AS reason
       FROM orders, (VALUES ('6COX'), ('3KK6')) r(receptor_id) WHERE o_orderstatus = 'P' OR r.receptor_id = '3KK6'""",
)
def missing_inputs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    grid = tasks.task_grid(orders, ["6COX", "3KK6"], "o_orderkey", "o_orderkey")
    ligands = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("ligand_id"))
    receptors = spark.createDataFrame([("6COX",)], "receptor_id string")
    return tasks.missing_inputs(grid, ligands, receptors).select("ligand_id", "receptor_id", "reason")


CHECK_SQL = """
    checked AS (
      SELECT coalesce(g.ligand_id, l.ligand_id) AS ligand_id, coalesce(g.receptor_id, l.receptor_id) AS receptor_id,
        CASE WHEN g.ligand_id IS NULL THEN 'orphaned' WHEN l.ligand_id IS NULL OR p.ligand_id IS NULL THEN 'missing'
             WHEN n_poses = 0 OR n_bytes < 100 OR NOT has_marker THEN 'failed' ELSE 'complete' END AS outcome,
        CASE WHEN n_poses = 0 THEN 'no Vina poses in log'
             WHEN n_bytes < 100 THEN 'pose file too small (' || n_bytes || ' B)'
             WHEN NOT has_marker THEN 'pose file missing Vina markers' END AS why
      FROM (SELECT * FROM grid WHERE receptor_id = '6COX' OR length(ligand_id) > 3) g
      FULL OUTER JOIN logs l ON g.ligand_id = l.ligand_id AND g.receptor_id = l.receptor_id
      LEFT JOIN poses p ON p.ligand_id = coalesce(g.ligand_id, l.ligand_id) AND p.receptor_id = coalesce(g.receptor_id, l.receptor_id))
"""


def checked_tasks(spark: SparkSession, sf: str) -> DataFrame:
    grid, logs, poses = order_tasks(spark, sf)
    # Logs of tasks that were never planned become orphans.
    planned = grid.filter("receptor_id = '6COX' or length(ligand_id) > 3")
    return tasks.check_tasks(planned, logs, poses)


@query(
    "task_check",
    f"""WITH {GRID_SQL}, {CHECK_SQL}
    SELECT ligand_id, receptor_id, outcome, CASE WHEN outcome = 'failed' THEN why END AS reason FROM checked""",
)
def task_check(spark: SparkSession, sf: str) -> DataFrame:
    return checked_tasks(spark, sf)


@query(
    "task_roll_up",
    f"""WITH {GRID_SQL}, {CHECK_SQL}
    SELECT receptor_id, count(*) FILTER (WHERE outcome <> 'orphaned') AS total,
           count(*) FILTER (WHERE outcome = 'complete') AS complete, count(*) FILTER (WHERE outcome = 'missing') AS missing,
           count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'orphaned') AS orphaned,
           CASE WHEN count(*) FILTER (WHERE outcome = 'complete') = count(*) FILTER (WHERE outcome <> 'orphaned') THEN 'PASS'
                WHEN count(*) FILTER (WHERE outcome = 'complete') > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status
    FROM checked GROUP BY receptor_id""",
)
def task_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.roll_up(checked_tasks(spark, sf))


@query(
    "task_status",
    f"""WITH {GRID_SQL}, {CHECK_SQL}
    SELECT count(*) FILTER (WHERE outcome <> 'orphaned') AS total,
           count(*) FILTER (WHERE outcome = 'complete') AS complete, count(*) FILTER (WHERE outcome = 'missing') AS missing,
           count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'orphaned') AS orphaned,
           'PARTIAL' AS status FROM checked""",
)
def task_status(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.overall_status(tasks.roll_up(checked_tasks(spark, sf)))


# --- profiles ---------------------------------------------------------------------------------


@query(
    "histogram",
    """WITH v AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'accepted' END AS part, o_totalprice AS v FROM orders),
            s AS (SELECT part, min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM v GROUP BY part),
            b AS (SELECT v.part, CAST(least(floor((v - lo) / w), 49) AS INT) AS bin, lo, w FROM v JOIN s ON v.part = s.part)
       SELECT part, bin, floor((lo + bin * w) * 1e4 + 0.5001) / 1e4 AS bin_start, count(*) AS n FROM b GROUP BY part, bin, lo, w""",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderstatus", "o_totalprice")
    parts = {"accepted": o.filter("o_orderstatus <> 'P'"), "rejected": o.filter("o_orderstatus = 'P'")}
    return profile.histogram(parts, "o_totalprice").withColumn("bin_start", settle("bin_start", 4))


@query(
    "column_profile",
    """WITH r AS (SELECT avg(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s1,
                         avg(CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s2,
                         avg(CASE WHEN TRY_CAST(user_id AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s3
                  FROM (SELECT CASE WHEN value > 60 THEN 'high' ELSE CAST(value AS VARCHAR) END AS v, event_type, user_id FROM events)),
            l AS (SELECT 'v' AS "column", s1 AS s FROM r UNION ALL SELECT 'event_type', s2 FROM r UNION ALL SELECT 'user_id', s3 FROM r)
       SELECT "column", floor((s) * 1e6 + 0.5001) / 1e6 AS numeric_share, floor((1 - s) * 1e6 + 0.5001) / 1e6 AS missing_share, s >= 0.95 AS numeric_like,
              s >= 0.95 AND 1 - s > 0.3 AS many_missing FROM l""",
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("value") > 60, "high").otherwise(F.col("value").cast("string"))
    e = table(spark, sf, "events").select(v.alias("v"), "event_type", "user_id")
    found = profile.profile_columns(e, ["v", "event_type", "user_id"])
    return found.withColumns({c: settle(c, 6) for c in ("numeric_share", "missing_share")})


@query(
    "fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(o_orderkey || '|' || coalesce(o_orderstatus, '\\N') || '|' ||
              coalesce(o_orderpriority, '\\N')), 1, 8) AS BIGINT)) AS BIGINT) AS md5_sum FROM orders""",
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return profile.fingerprint(o).select("n_rows", F.col("md5_sum").cast("long").alias("md5_sum"))
