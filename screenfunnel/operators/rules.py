"""Row filters that say why a row was rejected."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from screenfunnel.functions.scalars import above, fixed, holds, insert_after, keep_existing, number, require_columns

# NaN is never beyond a limit; Spark sorts it above all numbers, so only ">" has to care.
OPS: dict[str, Callable[[Column, float], Column]] = {
    ">": lambda v, b: above(v, b),
    "<": lambda v, b: v < F.lit(b),
    "<=": lambda v, b: v <= F.lit(b),
}


@dataclass(frozen=True)
class Limit:
    """A row fails when ``column op bound``; ``digits`` formats the value (None: as it is)."""

    column: str
    op: str
    bound: float | int
    digits: int | None = None
    name: str | None = None

    def fails(self) -> Column:
        """Null for a missing value."""
        return OPS[self.op](F.col(self.column), self.bound)

    def label(self) -> Column:
        shown = F.col(self.column).cast("string") if self.digits is None else fixed(self.column, self.digits)
        return F.concat(F.lit(f"{self.name or self.column}="), shown, F.lit(f"{self.op}{self.bound}"))


def rejection_reason(limits: Sequence[Limit]) -> Column:
    """All failing labels in the order of the limits, joined by ``"; "``; empty when none fails.

    A missing value fails no limit.
    """
    return F.concat_ws("; ", *[F.when(x.fails(), x.label()) for x in limits])


def range_filter(
    df: DataFrame, limits: Sequence[Limit], out: str = "Rejection", rejected_columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with its reasons). Both are plain filters over one scan, no shuffle.

    Limits on text columns read them as numbers.
    """
    require_columns(df, [x.column for x in limits], "range_filter")
    if not limits:
        return df, df.withColumn(out, F.lit("")).filter(F.lit(False))
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name in {x.column for x in limits}]
    df = df.withColumns({c: number(c) for c in texts}) if texts else df
    failed = reduce(lambda a, b: a | b, [x.fails() for x in limits])
    rejected = df.filter(failed).withColumn(out, rejection_reason(limits))
    if rejected_columns is not None:
        rejected = keep_existing(rejected, [*rejected_columns, out])
    return df.filter(~holds(failed)), rejected


def tag_range(df: DataFrame, limits: Sequence[Limit], out: str = "Rejection") -> DataFrame:
    """``df`` with the reasons of its rejection, or null in accepted rows: :func:`range_filter` in one pass."""
    require_columns(df, [x.column for x in limits], "tag_range")
    if not limits:
        return df.withColumn(out, F.lit(None).cast("string"))
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name in {x.column for x in limits}]
    df = df.withColumns({c: number(c) for c in texts}) if texts else df
    reason = rejection_reason(limits)
    return df.withColumn(out, F.when(reason != "", reason))


def derive_limits(
    product_limits: dict[str, float], deltas: dict[str, float], partner: DataFrame
) -> dict[str, float]:
    """Upper limits for one reactant: product limit − change by the reaction − least partner value.

    A row above such a limit can give no allowed product with any partner, so it is dropped before
    pairing. The partner minima are one aggregate row.
    """
    columns = list(product_limits)
    least = partner.agg(*[F.min(number(c)).alias(c) for c in columns]).first()
    return {c: product_limits[c] - deltas.get(c, 0.0) - (least[c] or 0.0) for c in columns}


def tag_rule_set(
    df: DataFrame,
    rules: dict[str, Column],
    max_fail: int = 1,
    out: str = "Violation",
    after: str | None = None,
    decision: str = "decision",
) -> DataFrame:
    """``df`` with the violated rules and ``accepted`` (at most ``max_fail`` of them) or ``rejected``, in one pass."""
    # The generator keeps the optimiser from evaluating the rules once per use of the result.
    failed = F.array_compact(F.array(*[F.when(~holds(passed), F.lit(name)) for name, passed in rules.items()]))
    tagged = df.select("*", F.explode(F.array(failed)).alias("_failed"))
    names = F.when(F.size("_failed") == 0, "none").otherwise(F.array_join("_failed", ", "))
    tagged = insert_after(tagged, out, names, after) if after else tagged.withColumn(out, names)
    verdict = F.when(F.size("_failed") <= max_fail, "accepted").otherwise("rejected")
    return tagged.withColumn(decision, verdict).drop("_failed")


def rule_set_filter(
    df: DataFrame,
    rules: dict[str, Column],
    max_fail: int = 1,
    out: str = "Violation",
    after: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a row stays if at most ``max_fail`` of the named rules fail. Store :func:`tag_rule_set`
    instead where both sides are needed and the input is costly."""
    tagged = tag_rule_set(df, rules, max_fail, out, after, "_decision")
    return tuple(tagged.filter(F.col("_decision") == side).drop("_decision") for side in ("accepted", "rejected"))


def clean_key(
    df: DataFrame,
    candidates: Sequence[str],
    name: str,
    valid: Callable[[Column], Column] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Rows with a usable key: the first of several column names that exists, trimmed, not blank,
    and valid if a test is given. The drops per step are counted into ``observation``."""
    source = next((c for c in candidates if c in df.columns), None)
    if source is None:
        raise ValueError(f"clean_key: none of {list(candidates)} found")
    if observation is not None:
        df = df.observe(observation, *_drop_counts(source, valid))
    trimmed = df.withColumn(source, F.trim(F.col(source))).filter(F.col(source) != "")
    if valid is not None:
        trimmed = trimmed.filter(holds(valid(F.col(source))))
    return trimmed if source == name else trimmed.withColumnRenamed(source, name)


def clean_key_counts(df: DataFrame, key: str, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """The counts of :func:`clean_key` as one row."""
    return df.agg(*_drop_counts(key, valid))


def _drop_counts(key: str, valid: Callable[[Column], Column] | None) -> list[Column]:
    blank = F.trim(F.col(key)) == ""
    usable = F.col(key).isNotNull() & ~blank
    ok = holds(valid(F.trim(F.col(key)))) if valid else F.lit(True)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(key).isNull()).alias("n_missing"),
        F.count_if(holds(blank)).alias("n_blank"),
        F.count_if(usable & ~ok).alias("n_invalid"),
        F.count_if(usable & ok).alias("n_kept"),
    ]


def class_filter(df: DataFrame, column: str, in_class: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows of the class, one row of counts: valid input, missing key, not in class)."""
    present = F.col(column).isNotNull() & (F.trim(F.col(column)) != "")
    match = holds(in_class(F.col(column)))
    counts = df.agg(
        F.count_if(present & match).alias("n_in_class"),
        F.count_if(~holds(present)).alias("n_invalid"),
        F.count_if(holds(present) & ~match).alias("n_not_in_class"),
    )
    return df.filter(present & match), counts


def valid_price(df: DataFrame, price: str = "PriceG") -> DataFrame:
    return df.filter(above(price, 0.0))


def ensure_columns(df: DataFrame, calculators: dict[str, Column]) -> DataFrame:
    """Add the columns that are missing, from the given expressions; existing ones stay."""
    missing = {c: expr for c, expr in calculators.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def threshold_candidates(
    df: DataFrame,
    n: int,
    score: str = "md_score",
    id_col: str = "ligand_id",
    instability: str = "instability",
    max_instability: float | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """The ids of the first ``n`` rows by score after the optional thresholds (top-k report)."""
    if max_instability is not None and instability in df.columns:
        df = df.filter(F.col(instability) <= max_instability)
    if min_score is not None and score in df.columns:
        df = df.filter(F.col(score) >= min_score)
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(id_col)).limit(n).select(id_col)
