"""Rank-normalised scores, top-k winnowing and price-ordered cuts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import holds, number
from screenfunnel.operators.order import column_ranks, count_and_edges, lookup_counted, order_cutoff, up_to, value_ranks
from screenfunnel.session import scratch_path

INF = float("inf")


@dataclass(frozen=True)
class Component:
    """One part of a composite: weight · rank-normalised column."""

    column: str
    out: str
    weight: float = 1.0
    invert: bool = True


def rank_normalise(df: DataFrame, value: str, id_col: str, out: str, invert: bool = True) -> DataFrame:
    """(average rank − 1) / (n − 1) in [0, 1], or one minus that when low values are good.

    A missing value stays missing but counts in n. Ranks are taken on the distinct values, then
    looked up by value.
    """
    return rank_columns(df, [Component(value, out, invert=invert)], id_col)


def rank_columns(df: DataFrame, parts: Sequence[Component], id_col: str) -> DataFrame:
    """:func:`rank_normalise` of several columns.

    Several columns are ranked together: the table is stored once with row numbers, its columns become
    (column, value) rows that one banded rank and one lookup serve, and the shares go back by row number. Missing values
    take no part in that.
    """
    if len(parts) == 1:
        return _rank_one(df, parts[0], id_col)
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ranked")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    values = [f"_v{i}" for i in range(len(parts))]
    rows = stored.select("_row", *[number(p.column).alias(v) for v, p in zip(values, parts)])
    total, edges = count_and_edges(rows, values)
    ranks = column_ranks(rows, values, edges).select("col", "value", F.col("n").alias("_n"), _share("below", "n", total).alias("_share"))
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(v).alias("value")) for i, v in enumerate(values)])
    present = rows.select("_row", F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell")).select("_row", "cell.*")
    placed = lookup_counted(present, ranks, ["col", "value"], "_row", total)
    wide = placed.groupBy("_row").agg(*[F.max(F.when(F.col("col") == i, F.col("_share"))).alias(v) for i, v in enumerate(values)])
    shares = {p.out: F.lit(1.0) - F.col(v) if p.invert else F.col(v) for v, p in zip(values, parts)}
    return stored.join(wide, "_row", "left").withColumns(shares).drop("_row", *values)


def _share(below: str, n: str, total: int) -> Column:
    return (F.col(below) + (F.col(n) - 1) / 2) / F.lit(float(max(total - 1, 1)))


def _rank_one(df: DataFrame, part: Component, id_col: str) -> DataFrame:
    rows = df.withColumn("_v", number(part.column))
    total, edges = count_and_edges(rows, ["_v"])
    ranks = value_ranks(rows.select("_v"), "_v", edges["_v"]).select("_v", F.col("n").alias("_n"), _share("below", "n", total).alias("_share"))
    share = F.lit(1.0) - F.col("_share") if part.invert else F.col("_share")
    return lookup_counted(rows, ranks, "_v", id_col, total).withColumn(part.out, share).drop("_v", "_n", "_share")


def composite_score(
    df: DataFrame, parts: Sequence[Component], id_col: str, out: str = "final_score", digits: int = 4
) -> DataFrame:
    """Weighted sum of rank-normalised columns, rounded."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.lit(part.weight) * F.col(part.out)
    return rank_columns(df, parts, id_col).withColumn(out, F.round(total, digits))


def md_score(
    df: DataFrame,
    id_col: str = "ligand_id",
    target: str = "score_cox2",
    off_target: str = "score_cox1",
    instability: str = "instability",
    penalty: float = 0.2,
) -> DataFrame:
    """2·norm(target) − norm(off target) − penalty·instability; no instability known counts as 0.

    A row with a missing instability among known ones has no score, as its penalty is unknown.
    """
    known = instability in df.columns and not df.filter(F.col(instability).isNotNull()).limit(1).isEmpty()
    if not known:
        df = df.withColumn(instability, F.lit(0.0))
    df = rank_columns(df, [Component(target, "norm_rank_cox2"), Component(off_target, "norm_rank_cox1")], id_col)
    df = df.withColumn("instability_penalty", F.round(F.lit(penalty) * F.col(instability), 4))
    return df.withColumn(
        "md_score",
        F.round(F.lit(2.0) * F.col("norm_rank_cox2") - F.col("norm_rank_cox1") - F.col("instability_penalty"), 4),
    )


def keep_count(total: int, rate: float, minimum: int) -> int:
    """How many rows a winnow keeps: the rate (at least one row if it is above 0), or the minimum
    if that is more, but never more than there are."""
    if total == 0:
        return 0
    by_rate = int(total * rate)
    if rate > 0 and by_rate == 0:
        by_rate = 1
    return min(total, max(by_rate, minimum))


def winnow(
    df: DataFrame, score: str, id_col: str, rate: float = 0.01, minimum: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the best rows by score, best share or at least ``minimum``.

    Ties go by id, null ids last; rows equal in both stand or fall together. The cut is found first
    as a (score, id) pair; both results are then plain filters, so no row
    is sorted or moved to be kept. Pass a stored table: it is read once to count, once to cut.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    if minimum <= 0:
        raise ValueError("minimum must be greater than 0")
    keys = [F.coalesce(-number(score), F.lit(INF)), *_id_keys(df, id_col)]
    keep = keep_count(df.count(), rate, minimum)
    cut = order_cutoff(df, keys, keep)
    if cut is None:
        return df.filter(F.lit(False)), df
    kept = up_to(keys, cut)
    return df.filter(kept), df.filter(~kept)


def budget_cascade(
    df: DataFrame,
    price: str,
    id_col: str,
    max_price: float | None = None,
    rate: float | None = None,
    max_rows: int | None = None,
    strict_missing: bool = False,
    out: str = "PriceCtrlRejection",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the one reason): drop above ``max_price``, keep the cheapest share
    of the rest, then at most ``max_rows``.

    In price order every step cuts off a tail, so two cut points decide every row. A missing price
    sorts last and passes ``max_price`` unless ``strict_missing``.
    """
    if rate is not None and not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be greater than 0")
    if max_price is not None and max_price < 0:
        raise ValueError("max_price must be >= 0")
    amount = number(price)
    over = F.lit(False)
    if max_price is not None:
        over = holds(amount > max_price)
        if strict_missing:
            over = over | amount.isNull()
    keys = [F.coalesce(amount, F.lit(INF)), *_id_keys(df, id_col)]
    survivors = df.filter(~over)
    n = survivors.count()

    reason = F.when(over, "max_price")
    if rate is not None and n > 0:
        keep = int(n * rate)
        if rate > 0 and keep == 0:
            keep = 1
        if keep < n:
            reason = reason.when(_beyond(survivors, keys, keep), "acceptance_rate")
            n = keep
    if max_rows is not None and n > max_rows:
        reason = reason.when(_beyond(survivors, keys, max_rows), "max_sample_size")
    tagged = df.drop(out).withColumn(out, reason)
    return tagged.filter(F.col(out).isNull()).drop(out), tagged.filter(F.col(out).isNotNull())


def _id_keys(df: DataFrame, id_col: str) -> list:
    """Order keys of an id that may be null: null ids come last, and no comparison is unknown."""
    nothing = F.lit("" if dict(df.dtypes)[id_col] == "string" else 0)
    return [F.col(id_col).isNull().cast("int"), F.coalesce(F.col(id_col), nothing)]


def _beyond(df: DataFrame, keys: list, k: int):
    cut = order_cutoff(df, keys, k)
    return F.lit(True) if cut is None else ~up_to(keys, cut)
