"""Scaling, applicability domain, stratified bins and splits, model metrics, desirability."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number
from screenfunnel.operators.order import group_quantiles, null_safe_join, values_at


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column (1 where a column is constant)."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return (F.col(column).cast("double") - F.lit(self.mean[i])) / F.lit(self.std[i])

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({f"{prefix}{c}": self.scaled(c) for c in self.columns})

    def centroid(self, df: DataFrame) -> tuple[float, ...]:
        row = df.agg(*[F.avg(self.scaled(c)) for c in self.columns]).first()
        return tuple(row)

    def distance(self, centroid: Sequence[float]) -> Column:
        """Euclidean distance of the scaled row to a centroid."""
        total = F.lit(0.0)
        for c, m in zip(self.columns, centroid, strict=True):
            gap = self.scaled(c) - F.lit(m)
            total = total + gap * gap
        return F.sqrt(total)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    if any(row[f"m{i}"] is None for i in range(len(columns))):
        raise ValueError("fit_scaler: a column has no values")
    return Scaler(
        tuple(columns),
        tuple(row[f"m{i}"] for i in range(len(columns))),
        tuple(row[f"s{i}"] or 1.0 for i in range(len(columns))),
    )


def quantile_cutoff(df: DataFrame, value: str, q: float = 0.95) -> float:
    """Exact linear-interpolated quantile of a column."""
    return group_quantiles(df, [], value, {"cut": q}).first().cut


@dataclass(frozen=True)
class Domain:
    """Where a model may be trusted: near enough to the centre of its training rows."""

    scaler: Scaler
    centroid: tuple[float, ...]
    cutoff: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("AD_Distance", self.scaler.distance(self.centroid)).withColumn(
            "In_AD", F.col("AD_Distance") <= F.lit(self.cutoff)
        )


def fit_domain(df: DataFrame, columns: Sequence[str], q: float = 0.95) -> Domain:
    scaler = fit_scaler(df, columns)
    centroid = scaler.centroid(df)
    cutoff = quantile_cutoff(df.select(scaler.distance(centroid).alias("d")), "d", q)
    return Domain(scaler, centroid, cutoff)


def _bin_of(value: Column, edges: Sequence[float]) -> Column:
    """1-based right-closed bin; the lowest edge belongs to bin 1."""
    out = F.when(value <= F.lit(edges[1]), 1)
    for i, edge in enumerate(edges[2:], start=2):
        out = out.when(value <= F.lit(edge), i)
    return out


def stratify_bins(
    df: DataFrame, value: str, n_bins: int = 10, min_per_bin: int = 2, out: str = "stratum"
) -> DataFrame:
    """Equal-width bins for stratified sampling: the most bins, up to ``n_bins`` and the number of
    distinct values, of which every one (empty ones too) has ``min_per_bin`` rows.

    All candidates are counted in one aggregate row.
    """
    v = number(value)
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if span.lo is None:
        raise ValueError("no values to stratify")
    distinct = df.select(v.alias("v")).filter("v is not null").distinct().limit(n_bins).count()
    choices = {k: [float(e) for e in np.linspace(span.lo, span.hi, k + 1)] for k in range(2, min(n_bins, distinct) + 1)}
    if choices:
        # Rows up to each edge; a bin holds the difference of two neighbours.
        upto = df.agg(
            *[
                F.count_if(v <= F.lit(edge)).alias(f"c{k}_{b}")
                for k, edges in choices.items()
                for b, edge in enumerate(edges[1:], start=1)
            ]
        ).first()
        for k in sorted(choices, reverse=True):
            ends = [0, *[upto[f"c{k}_{b}"] for b in range(1, k + 1)]]
            if min(hi - lo for lo, hi in zip(ends, ends[1:])) >= min_per_bin:
                return df.withColumn(out, _bin_of(v, choices[k]))
    raise ValueError("no number of bins leaves enough rows in every bin")


def stratified_split(
    df: DataFrame, stratum: str, id_col: str, share: float = 0.2, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Flag ``share`` of every stratum (rounded to whole rows) as test rows, by a hash of id and
    seed. The cut is looked up per stratum, a missing one being a stratum like any other; the rows
    themselves are not sorted.
    """
    token = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))), 256), 1, 12), 16, 10)
    rows = df.withColumn("_hash", token.cast("long"))
    cuts = values_at(
        rows, [stratum], "_hash", {"_cut": lambda n: F.floor(n * F.lit(share) + 0.5) - 1}, ties=[id_col]
    ).select(stratum, F.col("_cut"))
    joined = null_safe_join(rows, cuts, [stratum], "left")
    taken = F.struct(F.col("_hash"), F.col(id_col)) <= F.col("_cut")
    return joined.withColumn(out, F.coalesce(taken, F.lit(False))).drop("_hash", "_cut")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R² in one pass."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    gap = a - p
    sse, sst = F.sum(gap * gap), F.var_pop(a) * F.count(a)
    return df.filter(a.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    same = F.when(F.col(actual).cast("int") == F.col(predicted).cast("int"), 1.0).otherwise(0.0)
    return df.agg(F.avg(same).alias("accuracy"))


@dataclass(frozen=True)
class Desirability:
    """Asymmetric double sigmoid: floor a, height b, centre c, width d, slopes e and f, its maximum
    for scaling to 1, and the weight in the mean."""

    column: str
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    maximum: float
    weight: float = 1.0

    def value(self) -> Column:
        x = number(self.column)
        rise = 1.0 + F.exp(-(x - F.lit(self.c) + F.lit(self.d / 2)) / F.lit(self.e))
        fall = 1.0 + F.exp(-(x - F.lit(self.c) - F.lit(self.d / 2)) / F.lit(self.f))
        return (F.lit(self.a) + F.lit(self.b) / rise * (F.lit(1.0) - F.lit(1.0) / fall)) / F.lit(self.maximum)


def desirability(parts: Sequence[Desirability], digits: int = 4) -> Column:
    """Weighted geometric mean of desirabilities, rounded; null if any input is missing."""
    total = sum(p.weight for p in parts)
    logs = F.lit(0.0)
    for p in parts:
        d = p.value()
        logs = logs + F.lit(p.weight) * F.log(F.when(d > 0, d))
    return F.round(F.exp(logs / F.lit(total)), digits)
