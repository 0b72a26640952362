"""Column functions of the funnel. All are built-in expressions; ANSI mode safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Activity is called at or below this many nM.
ACTIVE_NM = 1000.0
# Gram factor of each weight unit.
GRAMS_PER_UNIT = {"mg": 0.001, "g": 1.0, "kg": 1000.0}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null.

    The cast alone would read a type letter after the digits, as in ``1d``, as part of a number. For
    columns that are no text the test on the type is folded away.
    """
    v = col(c).try_cast("double")
    lettered = (F.typeof(col(c)) == "string") & col(c).cast("string").rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~F.isnan(v) & ~lettered, v)


def is_number(c: str | Column) -> Column:
    """Neither missing nor NaN, in a form that can be pushed to the scan: NaN sorts above infinity."""
    return col(c) <= F.lit(float("inf"))


def above(c: str | Column, bound: float) -> Column:
    """c > bound, which NaN is not; both halves can be pushed to the scan."""
    return (col(c) > F.lit(bound)) & is_number(c)


def holds(cond: Column) -> Column:
    """A condition in which "unknown" counts as "no"."""
    return F.coalesce(cond, F.lit(False))


def pic50(nm: str | Column) -> Column:
    return F.when(col(nm) > 0, -F.log10(col(nm) * F.lit(1e-9)))


def ic50_nm(p: str | Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(9.0) - col(p))


def active(nm: str | Column, limit: float = ACTIVE_NM) -> Column:
    return col(nm) <= F.lit(limit)


def qsar_score(p_target: str | Column, p_off_target: str | Column) -> Column:
    return F.lit(2.0) * col(p_target) - col(p_off_target)


def selectivity(off_target: str | Column, target: str | Column) -> Column:
    """Ratio of two measurements; null when one is missing or the divisor is 0."""
    divisor = col(target)
    return F.when(divisor != 0, col(off_target) / F.nullif(divisor, F.lit(0.0)))


def grams(amount: str | Column, unit: str | Column) -> Column:
    """Weight in grams; null for an unknown unit."""
    u = col(unit)
    return (
        F.when(u == "mg", col(amount) / F.lit(1000.0))
        .when(u == "g", col(amount))
        .when(u == "kg", col(amount) * F.lit(1000.0))
    )


def price_per_gram(price: str | Column, amount: str | Column, unit: str | Column) -> Column:
    g = grams(amount, unit)
    return F.when(g > 0, col(price) / F.nullif(g, F.lit(0.0)))


def content_key(*parts: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), 1, 16)


def strip_letter(c: str | Column, letter: str) -> Column:
    return F.regexp_replace(col(c), f"^{letter}+", "")


def pair_id(left: str | Column, right: str | Column, left_letter: str = "A", right_letter: str = "C") -> Column:
    """``A12`` and ``C3`` give ``A12C3``."""
    return F.concat(
        F.lit(left_letter), strip_letter(left, left_letter), F.lit(right_letter), strip_letter(right, right_letter)
    )


def extend_id(left: str | Column, right: str | Column, letter: str = "N") -> Column:
    """``A12C3`` and ``N7`` give ``A12C3N7``."""
    return F.concat(col(left), F.lit(letter), strip_letter(right, letter))


def suffix_id(left: str | Column, letter: str = "S") -> Column:
    return F.concat(col(left), F.lit(letter))


def id_head(c: str | Column, letter: str = "C") -> Column:
    """The part before the last ``letter``: the first partner of a pair id."""
    return F.regexp_extract(col(c), f"^(.*){letter}[^{letter}]*$", 1)


def id_without_tail(c: str | Column, letter: str = "N") -> Column:
    """Drop a trailing ``N7``."""
    return F.regexp_replace(col(c), f"{letter}[0-9]+$", "")


def id_without_suffix(c: str | Column, letter: str = "S") -> Column:
    return F.regexp_replace(col(c), f"{letter}$", "")


def stem_parts(stem: str | Column) -> tuple[Column, Column]:
    """(ligand, receptor) of ``ligand_receptor``, split at the last underscore."""
    return F.regexp_extract(col(stem), "^(.*)_([^_]*)$", 1), F.regexp_extract(col(stem), "^(.*)_([^_]*)$", 2)


def fixed(v: str | Column, digits: int) -> Column:
    """``%.{digits}f`` with the rounding of C: the exact binary value decides, exact ties go to even.

    Java formatting rounds the shortest decimal form instead (2.675 gives 2.68, C gives 2.67). The
    error of value * 10^digits is recovered by splitting the value into two halves.
    """
    value = col(v).cast("double")
    scale = 10**digits
    size = F.abs(value)
    product = size * F.lit(float(scale))
    stretched = size * F.lit(134217729.0)
    high = stretched - (stretched - size)
    low = size - high
    error = (high * F.lit(float(scale)) - product) + low * F.lit(float(scale))
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    return F.concat(
        sign,
        F.floor(units / scale).cast("string"),
        F.lit("."),
        F.lpad((units % scale).cast("string"), digits, "0"),
    )


def distance(xs: Sequence[str | Column], ys: Sequence[str | Column]) -> Column:
    """Euclidean distance between two points given as columns."""
    total = F.lit(0.0)
    for x, y in zip(xs, ys, strict=True):
        total = total + (col(x) - col(y)) * (col(x) - col(y))
    return F.sqrt(total)


def array_distance(x: str | Column, y: str | Column) -> Column:
    """Euclidean distance between two array columns."""
    gaps = F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g))


def insert_after(df: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """Put a column right behind another one, replacing an old copy."""
    order = [c for c in df.columns if c != name]
    at = order.index(after) + 1
    return df.withColumn(name, value).select(*order[:at], name, *order[at:])


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, needed: Sequence[str], where: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {', '.join(missing)}")
