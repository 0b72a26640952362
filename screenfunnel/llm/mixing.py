"""Mixing sources to target weights by Pareto order sampling.

Targets: each source's share of all words follows its weight, held at ``cap`` times the source's own words; what is cut off
goes to the others by weight, which is one water level for all sources below their caps. A document's expected copies are
target / words of its source (times its own weight, if it has one). The whole part is certain; the fraction is the inclusion
probability p of one more copy. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a hash of the whole row, and
taken in that order until the source's missing words are met.

The rank order of a source is never sorted as a whole: words are summed by source and slice of the rank, the running sum
over slices finds the slice with the cut, and only its rows are ordered. What comes out is one row per source, so that a
hot source costs no more than any other and texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenfunnel.llm.common import word_count
from screenfunnel.session import scratch_path

#: Weights of the sources in order of code points, null last, again and again. Fixed values.
WEIGHTS = (5, 2, 1)
CAP = 3
SLICES = 4096
#: Up to so many sources (about 10 MB) their plan is broadcast; beyond, it is joined by a shuffle.
SENT_SOURCES = 100_000


def chance(seed: str, *columns: Column) -> Column:
    """A number strictly between 0 and 1 from the MD5 of the columns; equal rows have equal numbers."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _same_source(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with what is planned for their source; few sources are sent to the rows, so that a hot one is not shuffled."""
    known = plan.withColumnRenamed("source", "s")
    return rows.join(F.broadcast(known) if few else known, _same_source(F.col("source"), F.col("s"))).drop("s")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target; all sizes together are shared out.

    The windows run over one row per source. A source without words gets the target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(x)) for x in weights])
    weighed = by_source.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % len(weights)))
    level = F.col("source_size") * cap / F.col("weight")
    up = W.orderBy(level, F.col("source").asc_nulls_last())
    capped = F.sum(F.col("source_size") * cap).over(up.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    water = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(capped, F.lit(0.0))) / rest
    # holding one more source at its cap raises the level as long as that source was above its cap, so the highest is right
    full = weighed.withColumn("water", water).withColumn("final", F.max("water").over(W.partitionBy()))
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.col("final"))
    return full.select("source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"))


def _copies(df: DataFrame, cap: int) -> DataFrame:
    """Expected copies, certain copies, inclusion probability and rank of rows that know target and weighed size."""
    expected = F.when(F.col("weighed") > 0, F.least(F.col("target") / F.col("weighed") * F.col("weight"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    df = df.withColumn("expected", expected).withColumn("certain", F.floor("expected"))
    p = F.col("expected") - F.col("certain")
    odds = F.col("u") / (1 - F.col("u"))
    return df.withColumn("q", F.when((p > 0) & (F.col("size") > 0), odds / (p / (1 - p))))


def mixing_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target, weighed, q_cut, fill_u.

    sizes: source, size (long), weight (double, of the document), u. Taken are the certain copies, one more of every
    document with q <= q_cut, and one of the document fill_u: of those ranked later, the one whose size is nearest to the
    words still missing, if taking it comes nearer to the target. Full copies of a row share its u and are taken alike.
    """
    targets = source_targets(sizes, weights, cap)
    weighed = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("weight")).alias("weighed"))
    known = targets.join(weighed.withColumnRenamed("source", "s"), _same_source(F.col("source"), F.col("s"))).drop("s")
    known = _stored(known, "targets")
    few = known.count() <= SENT_SOURCES

    def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return _with_plan(rows, plan, few)

    ranked = _copies(with_plan(sizes, known), cap)
    place = F.floor(F.col("q") / (1 + F.col("q")) * SLICES).cast("int")
    slices = ranked.groupBy("source", place.alias("slice")).agg(
        F.sum(F.col("certain") * F.col("size")).alias("whole"), F.sum("size").alias("n")
    )
    by_source = W.partitionBy("source")
    missing = slices.withColumn("whole", F.sum("whole").over(by_source)).where("slice is not null")
    running = F.coalesce(F.sum("n").over(by_source.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    missing = missing.withColumn("before", running)
    # the slice in which the running sum passes the words that are missing; the last one if it never does
    lack = with_plan(missing, known.select("source", "target")).withColumn("lack", F.col("target") - F.col("whole"))
    last = lack.where(F.col("before") <= F.col("lack")).groupBy("source").agg(
        F.max_by(F.struct("slice", "before", "lack"), "slice").alias("at")
    )
    at = _stored(known.join(last.withColumnRenamed("source", "s"), _same_source(F.col("source"), F.col("s")), "left").select(
        *known.columns, F.col("at.slice").alias("cut_slice"), F.col("at.before").alias("before"), F.col("at.lack").alias("lack")
    ), "slices")
    inside = with_plan(_copies(with_plan(sizes, known), cap).withColumn("slice", place), at.select("source", "cut_slice", "before", "lack"))
    by_q = inside.where("slice = cut_slice").groupBy("source", "q", "before", "lack").agg(F.sum("size").alias("n"))
    sums = by_q.withColumn("upto", F.col("before") + F.sum("n").over(by_source.orderBy("q")))
    cut = sums.where("upto <= lack").groupBy("source").agg(F.max("q").alias("cut_q"), F.max("upto").alias("upto"))
    cuts = _stored(at.join(cut.withColumnRenamed("source", "s"), _same_source(F.col("source"), F.col("s")), "left").select(
        *known.columns,
        # without a row in the slice, everything before the slice is taken
        F.coalesce("cut_q", F.col("cut_slice") / SLICES / (1 - F.col("cut_slice") / SLICES) * (1 - 1e-12)).alias("q_cut"),
        (F.col("lack") - F.coalesce("upto", "before")).alias("gap"),
    ), "cuts")
    later = _copies(with_plan(sizes, cuts), cap).where("q > q_cut and abs(size - gap) < gap")
    fill = later.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "u")).alias("fill"))
    plan = cuts.join(fill.withColumnRenamed("source", "s"), _same_source(F.col("source"), F.col("s")), "left").select(
        "source", "source_size", "target", "weighed", "q_cut", F.col("fill.u").alias("fill_u")
    )
    return _stored(plan, "plan")


def sized_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None,
               seed: str = "mix") -> DataFrame:
    """The rows of ``df`` as struct ``row``, with source, size in words, weight and the random number u."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row")
    return df.select(
        row, F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        chance(seed, F.col(doc_id), F.col(source), F.col(text)).alias("u"),
    )


def take(sized: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows with source_size, target and ``copies``; every row stays, with 0 copies if it has no words.

    Null sources are one source, which comes last; null texts have no words; full copies of a row are taken alike.
    """
    joined = _with_plan(sized, plan, plan.count() <= SENT_SOURCES)
    more = F.coalesce(F.col("q") <= F.col("q_cut"), F.lit(False)) | F.coalesce(F.col("u") == F.col("fill_u"), F.lit(False))
    ranked = _copies(joined, cap)
    copies = F.when(F.col("size") > 0, F.col("certain") + more.cast("long")).otherwise(F.lit(0)).cast("long")
    return ranked.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixture(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus: every row as often as it is taken, with the columns of ``df``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "sizes")
    sized = sized_rows(df, text, doc_id, source)
    sized.drop("row").write.parquet(path)
    taken = take(sized, mixing_plan(spark.read.parquet(path))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
