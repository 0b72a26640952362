"""Assay measurements: filter, summarise per molecule, join two targets, attach to products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number, selectivity
from screenfunnel.operators.dedupe import cheapest_per_key, first_nonblank_per_key, most_complete_per_key
from screenfunnel.operators.order import group_quantiles

# The assay formats that are used.
ASSAY_FORMATS = ("single protein format", "cell-free format", "cell-based format")


def target_filter(
    df: DataFrame, targets: Sequence[str], target_col: str, type_col: str, value_col: str, kind: str = "IC50"
) -> DataFrame:
    """Measurements of one kind for the given targets that have a value."""
    return df.filter(
        F.trim(F.col(target_col)).isin(*targets)
        & (F.upper(F.trim(F.col(type_col))) == kind)
        & (F.trim(F.col(value_col).cast("string")) != "")
    )


def assay_filter(
    df: DataFrame,
    value: str = "Standard Value",
    units: str = "Standard Units",
    relation: str = "Standard Relation",
    label: str = "BAO Label",
    labels: Sequence[str] = ASSAY_FORMATS,
    unit_pattern: str = "nM",
    relation_text: str = "=",
    exact_relation: bool = False,
) -> DataFrame:
    """Rows in the right unit, relation and assay format with a numeric value.

    The unit is a case-insensitive pattern. The relation only has to contain the text, so ``>=``
    passes unless ``exact_relation`` is set.
    """
    quoted = F.regexp_replace(F.trim(F.col(relation)), "^'|'$", "")
    related = (quoted == relation_text) if exact_relation else F.col(relation).contains(relation_text)
    wanted = sorted({x.strip().lower() for x in labels})
    return (
        df.filter(
            F.col(units).rlike(f"(?i){unit_pattern}") & related & F.lower(F.trim(F.col(label))).isin(*wanted)
        )
        .withColumn(value, number(value))
        .filter(F.col(value).isNotNull())
    )


def median_mean_by(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """Exact median and mean per non-null key."""
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    found = group_quantiles(rows, [key], value, {"median": 0.5})
    return found.select(
        key, F.col("median").alias(f"{prefix}_median"), (F.col("total") / F.col("n")).alias(f"{prefix}_mean")
    )


def summarise_pair(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """Full outer join of two summaries that are unique per key."""
    return x.join(y, key, "full_outer")


def prefer(x: DataFrame, y: DataFrame, key: str, value: str) -> DataFrame:
    """``y``'s value where there is one, else ``x``'s (both unique per key)."""
    other = x.select(key, F.col(value).alias("_other"))
    return y.select(key, value).join(other, key, "full_outer").select(
        key, F.coalesce(F.col(value), F.col("_other")).alias(value)
    )


def assay_summary(
    off_target: DataFrame,
    target: DataFrame,
    key: str,
    value: str,
    text: str,
    order: str,
    names: tuple[str, str] = ("IC50_COX1", "IC50_COX2"),
) -> DataFrame:
    """Median and mean of both targets per molecule, with the target's structure text preferred."""
    merged = summarise_pair(
        median_mean_by(off_target, key, value, names[0]), median_mean_by(target, key, value, names[1]), key
    )
    texts = prefer(
        first_nonblank_per_key(off_target, key, text, order), first_nonblank_per_key(target, key, text, order), key, text
    )
    return merged.join(texts, key, "left").select(
        key, text, *[f"{n}_{stat}" for stat in ("median", "mean") for n in names]
    )


def attach_assays(
    products: DataFrame,
    summary: DataFrame,
    key: str = "SMILES",
    price: str = "PriceMol",
    id_col: str = "ID",
    summary_id: str = "ChEMBL_ID",
    names: tuple[str, str] = ("IC50_COX1", "IC50_COX2"),
    after: str | None = None,
    before: str | None = None,
) -> DataFrame:
    """Inner join of the cheapest product per key with the most complete summary per key, with
    selectivity ratios placed between ``after`` and ``before`` when both exist in that order.

    Both sides are unique per key after the de-duplication, so the join has no hot key.
    """
    metrics = [f"{n}_{stat}" for stat in ("median", "mean") for n in names]
    left = cheapest_per_key(products.withColumn(key, F.trim(F.col(key))), key, price, id_col)
    right = summary.withColumn(key, F.trim(F.col(key))).filter(F.col(key) != "")
    right = right.withColumns({m: number(m) for m in metrics})
    right = most_complete_per_key(right, key, metrics, summary_id).select(key, *metrics)
    joined = left.drop(*metrics).join(right, key, "inner")
    ratios: dict[str, Column] = {
        f"SI_{stat}": selectivity(f"{names[0]}_{stat}", f"{names[1]}_{stat}") for stat in ("median", "mean")
    }
    joined = joined.withColumns(ratios)
    placed = [c for stat in ("median", "mean") for c in (f"{names[0]}_{stat}", f"{names[1]}_{stat}", f"SI_{stat}")]
    rest = [c for c in products.columns if c not in placed]
    if after in rest and before in rest and rest.index(after) < rest.index(before):
        at = rest.index(after) + 1
        return joined.select(*rest[:at], *placed, *rest[at:])
    return joined.select(*rest, *placed)
