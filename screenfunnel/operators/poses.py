"""Pose tables: caps, spread, best pose, pivots over receptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenfunnel.operators.dedupe import first_per_key

# Which target each receptor structure stands for.
RECEPTOR_LABELS = {"6COX": "COX2", "3KK6": "COX1"}


def with_label(df: DataFrame, labels: dict[str, str] = RECEPTOR_LABELS, out: str = "cox_label") -> DataFrame:
    """The target of a receptor; an unknown receptor is its own label."""
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(label, F.col("receptor_id")), F.col("receptor_id")))


def cap_poses(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first ``n`` poses per log; Spark drops the others before the shuffle."""
    numbered = df.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return numbered.filter(F.col("_no") <= n).drop("_no")


def best_score(df: DataFrame, keys: Sequence[str], order: str, score: str = "score") -> DataFrame:
    """The first pose's score per log, rounded to 2 decimals."""
    return df.groupBy(*keys).agg(F.round(F.min_by(score, order), 2).alias("docking_score"))


def pose_spread(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "pose_no",
    score: str = "score",
    low: str = "rmsd_lb",
    high: str = "rmsd_ub",
    top: int = 3,
) -> DataFrame:
    """Larger of the score range and (max high − min low) over the first three poses; 0 for a
    single pose."""
    first = cap_poses(df, keys, order, top)
    spread = F.greatest(F.max(score) - F.min(score), F.max(high) - F.min(low))
    return first.groupBy(*keys).agg(
        F.round(F.when(F.count("*") >= 2, spread).otherwise(0.0), 3).alias("pose_spread")
    )


def best_pose(df: DataFrame, keys: Sequence[str], score: str, rank: str) -> DataFrame:
    """Per key the pose with the highest score, the first of equals."""
    return first_per_key(df, keys, [-F.coalesce(F.col(score), F.lit(float("-inf"))), F.col(rank)])


def pivot_scores(
    df: DataFrame,
    key: str,
    label: str,
    value: str,
    labels: Sequence[str],
    how: str = "min",
    prefix: str = "score_",
    order: str | None = None,
) -> DataFrame:
    """One column per label with the min or max value, or the first one by ``order`` (the least
    value of equals). Without any row for a label the result is empty, as later steps need every
    label."""
    if how == "first" and order is None:
        raise ValueError("the first value needs an order column")
    by = F.struct(F.col(order).isNull(), F.col(order), value) if order else None
    agg = {"min": F.min, "max": F.max, "first": lambda v: F.min_by(v, by)}[how]
    wide = df.groupBy(key).pivot(label, list(labels)).agg(agg(value))
    wide = wide.select(key, *[F.col(x).alias(f"{prefix}{x.lower()}") for x in labels])
    present = df.select(F.col(label).alias("_label")).filter(F.col(label).isin(*labels)).distinct().count()
    return wide if present == len(set(labels)) else wide.filter(F.lit(False))


def docking_analysis(scores: DataFrame, spreads: DataFrame, labels: Sequence[str] = ("COX2", "COX1")) -> DataFrame:
    """Best score and pose spread per ligand and target, and the larger spread as instability."""
    wide = pivot_scores(scores, "ligand_id", "cox_label", "docking_score", labels, "min")
    unstable = pivot_scores(spreads, "ligand_id", "cox_label", "pose_spread", labels, "max", "instability_")
    unstable = unstable.withColumn("instability", F.greatest(*[F.col(f"instability_{x.lower()}") for x in labels]))
    return wide.join(unstable, "ligand_id", "left")
