"""Per-group picks and summaries (clusters of the shortlist)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number, require_columns
from screenfunnel.operators.dedupe import first_per_key
from screenfunnel.operators.order import group_quantiles, null_safe_join

INF = float("inf")
# Spark itself pre-limits rank filters per task up to this many rows per group.
PRELIMITED = 1000


def top_n_per_group(
    df: DataFrame,
    group: str,
    n: int = 3,
    score: str = "QED",
    price: str = "PriceMol",
    id_col: str = "ID",
    out: str = "SelectionRank",
) -> DataFrame:
    """The ``n`` best rows per group: score descending (missing last), price ascending (missing
    last), id. Spark drops rows beyond n in each task before the shuffle; beyond its limit for
    that, a salted first pass does the same."""
    if n <= 0:
        raise ValueError("n must be greater than 0")
    order = [
        F.coalesce(number(score), F.lit(-INF)).desc(),
        F.coalesce(number(price), F.lit(INF)),
        F.col(id_col),
    ]
    if n > PRELIMITED:
        part = W.partitionBy(group, F.pmod(F.xxhash64(id_col), F.lit(64))).orderBy(*order)
        df = df.withColumn(out, F.row_number().over(part)).filter(F.col(out) <= n).drop(out)
    return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(out) <= n)


def representative_per_group(
    df: DataFrame,
    group: str,
    selected_col: str | None = None,
    distance_col: str | None = None,
    score: str = "QED",
    price: str = "PriceMol",
    id_col: str = "ID",
) -> DataFrame:
    """One row per group with the rule that chose it: the flagged row, else the one nearest to the
    centre, else the best score; then price, then id. The caller names the column to go by."""
    if selected_col is not None:
        as_number = number(selected_col)
        # A column with any number in it is read as numbers, otherwise as words.
        numeric = not df.filter(as_number.isNotNull()).limit(1).isEmpty()
        words = F.lower(F.trim(F.col(selected_col).cast("string"))).isin("1", "true", "yes", "y")
        chosen = F.coalesce(as_number, F.lit(0.0)) if numeric else F.when(words, 1.0).otherwise(0.0)
        lead, rule = -chosen, f"point_selected:{selected_col}"
    elif distance_col is not None:
        lead, rule = F.coalesce(number(distance_col), F.lit(INF)), f"centroid_distance:{distance_col}"
    else:
        lead, rule = F.coalesce(-number(score), F.lit(INF)), "qed_price_rank"
    order = [lead, F.coalesce(number(price), F.lit(INF)), F.col(id_col)]
    return first_per_key(df, [group], order).withColumn("RepresentativeRule", F.lit(rule))


def summarise_groups(
    df: DataFrame, group: str, price: str = "PriceMol", score: str = "QED"
) -> DataFrame:
    """Size and min / exact median / max of price and score per group; the null group is kept."""
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("ClusterSize"))
    for column, name in ((price, "PriceMol"), (score, "QED")):
        values = df.select(group, number(column).alias("_v"))
        stats = group_quantiles(values, [group], "_v", {"median": 0.5}).select(
            group,
            F.col("min").alias(f"{name}Min"),
            F.col("median").alias(f"{name}Median"),
            F.col("max").alias(f"{name}Max"),
        )
        out = null_safe_join(out, stats, [group], "left")
    return out


def attach_labels(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    label: str,
    optional: Sequence[str] = ("Point selected", "PC1", "PC2", "PC3"),
) -> DataFrame:
    """Left join checked to be one to one and complete: a repeated key on either side, or a row
    without a label, is an error."""
    require_columns(labels, [key, label], "attach_labels")
    taken = [key, label, *[c for c in optional if c in labels.columns]]
    for side, name in ((df, "rows"), (labels, "labels")):
        if not side.groupBy(key).count().filter("count > 1").limit(1).isEmpty():
            raise ValueError(f"attach_labels: repeated {key} among the {name}")
    joined = df.join(labels.select(*taken), key, "left")
    missing = joined.filter(F.col(label).isNull()).count()
    if missing:
        raise ValueError(f"attach_labels: {missing:,} rows have no {label}")
    return joined
