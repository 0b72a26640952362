"""Counters, histograms, column profiles and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import holds, number


def stage_counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: all rows, the rows meeting each condition, and the share of the first in percent."""
    counts = [F.count_if(holds(c)).alias(name) for name, c in conditions.items()]
    first = next(iter(conditions))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts).withColumn(
        "accepted_pct", F.coalesce(F.try_divide(F.col(first) * 100.0, F.col("n_rows")), F.lit(0.0))
    )


def observed(df: DataFrame, conditions: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """The same counters taken on the way, without a job of their own."""
    watch = Observation(name)
    counts = [F.count_if(holds(c)).alias(n) for n, c in conditions.items()]
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), *counts), watch


def histogram(parts: dict[str, DataFrame], value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins per part (such as accepted, rejected); each part's bins span its own
    range, nulls are left out, empty bins are not listed."""
    if bins <= 0:
        raise ValueError("bins must be greater than 0")
    rows = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(p).alias("part"), number(value).alias("v")).filter("v is not null") for p, df in parts.items()],
    )
    span = {
        r.part: (r.lo, r.hi)
        for r in rows.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    }
    # One range per named part: literals in the plan.
    low, width = F.lit(None).cast("double"), F.lit(None).cast("double")
    for part, (lo, hi) in span.items():
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        low = F.when(F.col("part") == part, F.lit(lo)).otherwise(low)
        width = F.when(F.col("part") == part, F.lit((hi - lo) / bins)).otherwise(width)
    at = F.least(F.floor((F.col("v") - low) / width).cast("int"), F.lit(bins - 1))
    return (
        rows.select("part", at.alias("bin"), low.alias("low"), width.alias("width"))
        .groupBy("part", "bin", "low", "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "n")
    )


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the share of rows readable as a number and the share of those missing one; one
    pass over the table, then one line per column."""
    readable = [F.avg(F.when(number(c).isNotNull(), 1.0).otherwise(0.0)).alias(f"r{i}") for i, c in enumerate(columns)]
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("numeric_share")) for i, c in enumerate(columns)])
    return (
        df.agg(*readable)
        .select(F.explode(lines).alias("line"))
        .select("line.*")
        .withColumn("missing_share", F.lit(1.0) - F.col("numeric_share"))
        .withColumn("numeric_like", F.col("numeric_share") >= 0.95)
        .withColumn("many_missing", F.col("numeric_like") & (F.col("missing_share") > 0.30))
    )


def validate_features(
    df: DataFrame, id_col: str, text_col: str, ignore: Sequence[str] = (), minimum: int = 3
) -> tuple[list[str], int]:
    """(numeric-like feature columns, rows with a repeated id) of a clustering input, or an error."""
    for c in (id_col, text_col):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
    if "batch" in df.columns:
        raise ValueError("a column named 'batch' is not allowed")
    candidates = [c for c in df.columns if c != id_col and c not in ignore]
    if len(candidates) < minimum:
        raise ValueError(f"at least {minimum} feature columns are needed, found {len(candidates)}")
    good = [r.column for r in profile_columns(df, candidates).filter("numeric_like").collect()]
    if len(good) < minimum:
        raise ValueError(f"at least {minimum} numeric columns are needed, found {len(good)}")
    repeats = df.groupBy(F.col(id_col).cast("string")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    return [c for c in candidates if c in good], repeats


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash (64-bit XOR and sum of 32-bit parts of MD5).

    Backslashes and bars inside values are escaped, so no two rows are written alike. The sum is a
    decimal: whole numbers of any table fit.
    """

    def escaped(c: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1"), F.lit("\\N"))

    line = F.concat_ws("|", *map(escaped, df.columns))
    part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(F.xxhash64(*df.columns)).alias("xor_hash"),
        F.sum(part.cast("decimal(28,0)")).alias("md5_sum"),
    )


def require_distinct(a: DataFrame, b: DataFrame) -> None:
    """Two inputs must not be the same table."""
    if fingerprint(a).first() == fingerprint(b).first():
        raise ValueError("the two inputs are identical")


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct values per column: exact, or estimated at a fraction of the cost."""
    how = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*[how(F.col(c)).alias(f"n_{c}") for c in columns])
