"""One row per key. Every choice is an aggregate with a partial step before the shuffle, so a hot
key sends one row per task, and ends on an id so that it does not depend on input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number
from screenfunnel.operators.order import number_rows

INF = float("inf")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that is smallest in ``order`` (none of it null)."""
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def cheapest_per_key(df: DataFrame, key: str, price: str, id_col: str) -> DataFrame:
    """The cheapest row of each key; a missing price comes last, ties go to the smaller id."""
    return first_per_key(df, [key], [F.coalesce(number(price), F.lit(INF)), F.col(id_col)])


def most_complete_per_key(df: DataFrame, key: str, metrics: Sequence[str], id_col: str) -> DataFrame:
    """The row of each key with most non-null metrics, ties to the smaller id."""
    filled = sum((F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in metrics), F.lit(0))
    return first_per_key(df, [key], [-filled, F.col(id_col)])


def first_nonblank_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first non-empty value of each non-null key."""
    return (
        df.filter(F.col(key).isNotNull() & (F.col(value) != ""))
        .groupBy(key)
        .agg(F.min_by(value, order).alias(value))
    )


def unique_names(df: DataFrame, id_col: str, key_col: str, order: str, out: str = "unique_id") -> DataFrame:
    """A unique name per row when ids repeat: ``id__hash``, and ``__dK`` behind the K-th repeat.

    The hash is of ``id|key``; a blank id is called ``MOL``, characters outside ``A-Za-z0-9_.-``
    become ``_``. ``order`` is a numeric column that numbers the repeats. When no id repeats the
    id itself is the name. The column is called ``out`` or, if taken, ``out_1``, ``out_2`` …
    """
    name, k = out, 1
    while name in df.columns:
        name, k = f"{out}_{k}", k + 1
    repeats = df.groupBy(F.col(id_col).cast("string").alias("id")).count().filter("count > 1").limit(1)
    if repeats.isEmpty():
        return df.withColumn(name, F.col(id_col).cast("string"))
    base = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = F.when(base == "", "MOL").otherwise(base)
    digest = F.substring(F.sha2(F.concat(base, F.lit("|"), F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 256), 1, 12)
    token = F.regexp_replace(F.concat(base, F.lit("__"), digest), "[^A-Za-z0-9_.-]", "_")
    numbered = number_rows(df.withColumn("_token", token), order, keys=["_token"], out="_no")
    return numbered.withColumn(
        name,
        F.when(F.col("_no") == 1, F.col("_token")).otherwise(
            F.concat("_token", F.lit("__d"), (F.col("_no") - 1).cast("string"))
        ),
    ).drop("_token", "_no")
