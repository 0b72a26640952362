"""Order statistics without a one-partition window.

``F.row_number().over(W.orderBy(...))`` sends a whole table through one task, and a window
partitioned by a key sends the whole of a hot key through one. Everything here first cuts the
order column into bands of about equal row count (approximate percentiles, exact results), so a
task sees one band of one group, and groups by value before any window, so a value held by a third
of the rows is one row by then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Up to this many key tuples are fetched by one ordered limit.
DIRECT_FETCH = 10_000
# A value held by more rows than this (and by more than 0.1 % of all) is looked up in salted copies.
HOT_ROWS = 1_000_000


def default_bands(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def band_edges(df: DataFrame, value: str, n_bands: int | None = None) -> list[float]:
    """At most ``n_bands - 1`` increasing cut points of ``value``; one column is scanned."""
    return count_and_edges(df, [value], n_bands)[1][value]


def count_and_edges(
    df: DataFrame, values: Sequence[str], n_bands: int | None = None
) -> tuple[int, dict[str, list[float]]]:
    """Row count of ``df`` and the cut points of several columns, in one pass."""
    n_bands = n_bands or default_bands(df)
    shares = [i / n_bands for i in range(1, n_bands)]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.percentile_approx(F.col(v).cast("double"), shares, max(10_000, 10 * n_bands)).alias(f"e{i}")
            for i, v in enumerate(values)
        ],
    ).first()

    def finite(edges: list[float] | None) -> list[float]:
        return sorted({e for e in (edges or []) if e == e and abs(e) != float("inf")})

    return row.n, {v: finite(row[f"e{i}"]) for i, v in enumerate(values)}


def add_band(df: DataFrame, value: str, edges: Sequence[float], out: str = "_band") -> DataFrame:
    """Band number of ``value``: monotone in the value, equal values share a band."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol="_band_in", outputCol=out, handleInvalid="keep"
    )
    return (
        cut.transform(df.withColumn("_band_in", F.col(value).cast("double")))
        .withColumn(out, F.col(out).cast("int"))
        .drop("_band_in")
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; keeps the left key columns."""
    marked = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(marked, cond, how).drop(*[f"_r_{c}" for c in on])


def running_sum(
    df: DataFrame,
    value: str,
    weight: str | Column = 1,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    out: str = "running",
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` per group in the order (value, ties).

    ``value`` must not be null. The band offsets are windowed per group over at most one row per
    band; the rows themselves only inside (group, band).
    """
    weight = F.col(weight) if isinstance(weight, str) else F.lit(weight)
    if edges is None:
        edges = band_edges(df, value)
    group = [*keys, "_band"]
    banded = add_band(df.withColumn("_weight", weight), value, edges)
    before = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        banded.groupBy(*group)
        .agg(F.sum("_weight").alias("_total"))
        .select(*group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*group).orderBy(value, *ties).rowsBetween(W.unboundedPreceding, 0)
    rows = banded.withColumn("_inside", F.sum("_weight").over(inside))
    return (
        null_safe_join(rows, offsets, group)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_weight", "_band", "_inside", "_offset")
    )


def number_rows(
    df: DataFrame, value: str, keys: Sequence[str] = (), ties: Sequence[str] = (), out: str = "row_no"
) -> DataFrame:
    """1-based row number per group, in the order (value, ties)."""
    return running_sum(df, value, 1, keys, ties, out)


def prefix_ids(df: DataFrame, order: str, prefix: str, out: str = "ID") -> DataFrame:
    """``A1, A2 …`` in the order of a unique numeric column."""
    if not prefix.isalpha():
        raise ValueError("the prefix must be letters only, such as 'A'")
    numbered = number_rows(df, order, out="_no")
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.col("_no").cast("string"))).drop("_no")


def value_ranks(df: DataFrame, value: str, edges: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct non-null value: ``n`` rows hold it, ``below`` rows are smaller."""
    present = df.select(value).filter(F.col(value).isNotNull())
    if edges is None:
        edges = band_edges(present, value)
    hist = present.groupBy(value).agg(F.count("*").alias("n"))
    return running_sum(hist, value, "n", edges=edges, out="_upto").select(
        value, "n", (F.col("_upto") - F.col("n")).alias("below")
    )


def column_ranks(df: DataFrame, values: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """:func:`value_ranks` of several columns in one pass: per column number ``col`` and distinct non-null value ``n`` and
    ``below``. Columns become rows, so the shuffles do not grow in number with the columns."""
    banded = df.select(*values)
    for i, v in enumerate(values):
        banded = add_band(banded, v, edges[v], f"_b{i}")
    cells = F.array(
        *[F.struct(F.lit(i).alias("col"), F.col(f"_b{i}").alias("_band"), F.col(v).alias("value")) for i, v in enumerate(values)]
    )
    present = banded.select(F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell")).select("cell.*")
    hist = present.groupBy("col", "_band", "value").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("col").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hist.groupBy("col", "_band")
        .agg(F.sum("n").alias("_total"))
        .select("col", "_band", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("col", "_band").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = hist.withColumn("_upto", F.sum("n").over(inside)).join(offsets, ["col", "_band"])
    return placed.select("col", "value", "n", (F.col("_upto") - F.col("n") + F.col("_offset")).alias("below"))


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    ties: Sequence[str] = (),
) -> DataFrame:
    """Per group: row count, total, min and max, and for every named 0-based rank the row there.

    ``ranks`` maps an output name to a function of the group's row count. Null values are left
    out; a rank outside the group gives null. With ``ties`` the outputs are structs
    (value, *ties). Only bands that hold a wanted rank are looked into.
    """
    present = df.select(*keys, value, *ties).filter(F.col(value).isNotNull())
    edges = band_edges(present, value)
    hist = (
        add_band(present, value, edges)
        .groupBy(*keys, "_band", value, *ties)
        .agg(F.count("*").alias("_n"))
    )
    per_group = W.partitionBy(*keys)
    bands = (
        hist.groupBy(*keys, "_band")
        .agg(
            F.sum("_n").alias("_band_n"),
            F.sum(F.col(value) * F.col("_n")).alias("_band_total"),
            F.min(value).alias("_band_min"),
            F.max(value).alias("_band_max"),
        )
        .withColumn("_size", F.sum("_band_n").over(per_group))
        .withColumn("_total", F.sum("_band_total").over(per_group))
        .withColumn("_min", F.min("_band_min").over(per_group))
        .withColumn("_max", F.max("_band_max").over(per_group))
        .withColumn("_upto", F.sum("_band_n").over(per_group.orderBy("_band")))
        .withColumn("_before", F.col("_upto") - F.col("_band_n"))
    )
    at = {name: fn(F.col("_size")) for name, fn in ranks.items()}
    holds = [(r >= F.col("_before")) & (r < F.col("_upto")) for r in at.values()]
    # The first band is kept too, so that a group whose ranks all fall outside still shows up.
    wanted = bands.filter(reduce(lambda x, y: x | y, [F.col("_before") == 0, *holds])).select(
        *keys, "_band", "_before", "_size", "_total", "_min", "_max"
    )
    inside = W.partitionBy(*keys, "_band").orderBy(value, *ties).rowsBetween(W.unboundedPreceding, 0)
    placed = null_safe_join(hist, wanted, [*keys, "_band"]).withColumn(
        "_end", F.sum("_n").over(inside) + F.col("_before")
    )
    pick = F.struct(value, *ties) if ties else F.col(value)
    return placed.groupBy(*keys).agg(
        F.max("_size").alias("n"),
        F.max("_total").alias("total"),
        F.max("_min").alias("min"),
        F.max("_max").alias("max"),
        *[
            F.max(F.when((r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")), pick)).alias(name)
            for name, r in at.items()
        ],
    )


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, with n, total, min and max of the values.

    ``F.percentile`` would keep all distinct values of a group in one task's memory.
    """
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    found = values_at(df, keys, value, ranks)
    outs = []
    for name, q in quantiles.items():
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        share = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        outs.append((lo + (hi - lo) * share).alias(name))
    return found.select(*keys, "n", "total", "min", "max", *outs)


def order_cutoff(df: DataFrame, keys: Sequence[Column], k: int) -> tuple | None:
    """The k-th smallest (1-based) key tuple, all keys ascending and not null.

    Small k is one ordered limit. A larger k range-partitions the keys, counts each range, and goes
    on inside the one range that holds the answer, so no task ever holds more than one range and
    the driver sees one line per range. End with a unique key to have no ties.
    """
    if k <= 0:
        return None
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[c.alias(n) for c, n in zip(keys, names)])
    key = F.struct(*names)
    while k > DIRECT_FETCH:
        parts = (
            rows.repartitionByRange(max(32, default_bands(df)), *names)
            .groupBy(F.spark_partition_id().alias("part"))
            .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
            .orderBy("lo")
            .collect()
        )
        for part in parts:
            if k <= part.n:
                break
            k -= part.n
        else:
            return None
        if part.lo == part.hi:
            return tuple(part.lo)
        low, high = tuple(part.lo), tuple(part.hi)
        cols = [F.col(n) for n in names]
        rows = rows.filter(~before(cols, low) & up_to(cols, high))
    row = rows.orderBy(*names).limit(k).agg(F.max(key).alias("key"), F.count("*").alias("n")).first()
    return tuple(row.key) if row.n == k else None


def before(keys: Sequence[Column], bound: tuple) -> Column:
    """keys < bound, lexicographically."""
    first = keys[0] < F.lit(bound[0])
    if len(keys) == 1:
        return first
    return first | ((keys[0] == F.lit(bound[0])) & before(keys[1:], bound[1:]))


def up_to(keys: Sequence[Column], bound: tuple) -> Column:
    """keys <= bound, lexicographically; a plain filter that can reach the scan."""
    if len(keys) == 1:
        return keys[0] <= F.lit(bound[0])
    return (keys[0] < F.lit(bound[0])) | ((keys[0] == F.lit(bound[0])) & up_to(keys[1:], bound[1:]))


def lookup_counted(
    df: DataFrame, per_value: DataFrame, key: str | Sequence[str], id_col: str, total: int
) -> DataFrame:
    """Left join of ``per_value`` (unique ``key``, its row count in ``_n``) onto ``df``.

    Values held by more than 0.1 % of all rows (at most 1000 of them in a column, hence the broadcast) are
    spread over salted copies, so one hot value does not become one hot task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if total <= HOT_ROWS:
        return df.join(per_value, keys, "left")
    salts = 64
    is_hot = F.col("_n") > F.lit(max(total / 1000, HOT_ROWS))
    hot = per_value.filter(is_hot).select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)])
    salted = per_value.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)])
    rows = df.join(F.broadcast(hot), same, "left").withColumn(
        "_salt", F.when(F.col("_hot0").isNotNull(), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).otherwise(0)
    )
    return rows.join(salted, [*keys, "_salt"], "left").drop("_salt", *[f"_hot{i}" for i in range(len(keys))])
