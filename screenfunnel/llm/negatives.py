"""Hard negatives by inner product, found with segment summaries.

Vectors are quantised and packed in blocks (the index, a stored table). A block also holds, for each level, the mean and the
deviation of every segment of every vector. For two vectors and one segment of n components, the inner product is
``n * mean_a * mean_b`` plus or minus at most ``n * dev_a * dev_b``; the sum over the segments bounds the score. Coarse
segments are tried first, finer ones for the pairs that may still matter, and only what is left is scored exactly.

Anchors (the stated queries) meet all rows in blocks: data blocks are dealt once over stripes of bounded size, blocks of anchors
are repeated per stripe, and both are shuffled and joined on the stripe. A task holds two blocks and the best rows of a few blocks of anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.session import scratch_path

#: Quantised components are held within this, so that sums of products stay exact in 64 bits (below 131072 components).
LIMIT = 2**23
NEVER = -(2**62)
#: Blocks of anchors whose best rows a task holds at a time; the oldest is passed on when there are more.
HELD = 32

BLOCK = "block long, bucket int, dims int, n int, ids binary, labels binary, flags binary, vectors binary, means binary, deviations binary"
ANCHOR = "uid long, bucket int, dims int, id long, label long, vector binary, means binary, deviations binary"
PACK = "a_block long, a_bucket int, a_dims int, a_uids binary, a_ids binary, a_labels binary, a_vectors binary, a_means binary, a_deviations binary, a_low binary, a_high binary"
FOUND = "uid long, slot int, score long, id long"


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the share (percent) of the positive's score that a negative's lies in.

    ``levels``: segments per vector, coarse to fine; a level that a vector is too short for is left out. Vectors without structure
    are told apart by fine segments only, clustered ones by coarse ones already. ``stripe_*``: what a stripe of data holds at most, and
    the comparisons with anchors that it is made for.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    levels: tuple[int, ...] = (1, 8, 32)
    block_rows: int = 2048
    anchor_rows: int = 256
    buckets: int = 16
    stripe_rows: int = 200_000
    stripe_bytes: int = 128 << 20
    stripe_pairs: int = 150_000_000


def used_levels(dims: int, levels: tuple[int, ...]) -> list[int]:
    return [s for s in levels if s < dims]


def summaries(q: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each level, both times the root of the segment's length."""
    means, deviations = [], []
    for s in used_levels(q.shape[1], levels):
        cuts = np.arange(s) * q.shape[1] // s
        size = np.diff([*cuts, q.shape[1]])
        x = q.astype(np.float64)
        mean = np.add.reduceat(x, cuts, axis=1) / size
        rest = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts, axis=1)
        means.append(mean * np.sqrt(size))
        deviations.append(np.sqrt(rest))
    none = np.zeros((len(q), 0))
    return np.hstack([none, *means]).astype(np.float32), np.hstack([none, *deviations]).astype(np.float32)


@dataclass
class Side:
    """Vectors of one block with their summaries."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    @classmethod
    def read(cls, n: int, dims: int, ids, labels, vectors, means, deviations) -> Side:
        part = lambda x, kind: np.frombuffer(x, kind)
        return cls(
            part(ids, np.int64), part(labels, np.int64), part(vectors, np.int32).reshape(n, dims),
            part(means, np.float32).reshape(n, -1), part(deviations, np.float32).reshape(n, -1),
        )


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products; in the fastest type in which every partial sum is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = np.sqrt((a.astype(np.float64) ** 2).sum(1).max() * (b.astype(np.float64) ** 2).sum(1).max())
    for kind, bound in ((np.float32, 2**24), (np.float64, 2**53)):
        if most * 1.001 < bound:
            return a.astype(kind) @ b.astype(kind).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def scores(a: Side, b: Side, floor: np.ndarray, top: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b that still matter, their exact scores, and which pairs of them may lie in [floor, top].

    A pair that is left out has a score below ``floor`` or above ``top`` of its row of a. Vectors of other lengths are compared
    as if the shorter went on with zeros.
    """
    rows, cols = np.arange(len(a.q)), np.arange(len(b.q))
    may = np.ones((len(rows), len(cols)), bool)
    at, dims = 0, a.q.shape[1]
    for s in used_levels(dims, levels) if dims == b.q.shape[1] else []:
        part = slice(at, at := at + s)
        dev_a, dev_b, mean_a, mean_b = a.deviations[rows, part], b.deviations[cols, part], a.means[rows, part], b.means[cols, part]
        # single precision is off by less than this
        length = np.sqrt(((mean_a**2).sum(1) + (dev_a**2).sum(1)).max() * ((mean_b**2).sum(1) + (dev_b**2).sum(1)).max())
        slack = 1 + 1e-4 * length
        middle, spread = mean_a @ mean_b.T, dev_a @ dev_b.T + slack
        may &= (middle + spread >= floor[rows, None]) & (middle - spread <= top[rows, None])
        keep_row, keep_col = may.any(1), may.any(0)
        rows, cols, may = rows[keep_row], cols[keep_col], may[np.ix_(keep_row, keep_col)]
        if not len(rows):
            break
    short = min(dims, b.q.shape[1])
    return rows, cols, exact_products(a.q[rows, :short], b.q[cols, :short]), may


class Best:
    """The k best (score, then smaller id) of each of n queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), NEVER, np.int64), np.full((n, k), 2**63 - 1, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, ok: np.ndarray) -> None:
        """score, ok: a line for each of ``rows``, a column for each of ``ids``."""
        ok = ok & (score >= self.score[rows, -1][:, None])
        if len(ids) > self.k and ok.sum() > 4 * self.k * len(rows):
            held = np.where(ok, score, NEVER)
            kth = np.partition(held, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            ok &= score >= kth[:, None]
        r, c = np.nonzero(ok)
        if not len(r):
            return
        lines = np.unique(r)
        old = np.repeat(rows[lines], self.k)
        line = np.concatenate([old, rows[r]])
        value = np.concatenate([self.score[rows[lines]].ravel(), score[r, c].astype(np.int64)])
        name = np.concatenate([self.id[rows[lines]].ravel(), ids[c]])
        order = np.lexsort((name, -value, line))
        line = line[order]
        nth = np.arange(len(line)) - np.searchsorted(line, line, "left")
        keep = order[nth < self.k]
        line, nth = line[nth < self.k], nth[nth < self.k]
        self.score[line, nth], self.id[line, nth] = value[keep], name[keep]


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _indexer(rules: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, made = _arrow(BLOCK), {}, 0
        first = TaskContext.get().partitionId() << 22

        def emit(key: tuple[int, int], parts: list) -> pa.RecordBatch:
            ids, labels, flags, q = (np.concatenate([p[i] for p in parts]) for i in range(4))
            means, deviations = summaries(q, rules.levels)
            raw = [x.tobytes() for x in (ids, labels, flags, q, means, deviations)]
            return _batch(schema, [[first + made], [key[0]], [key[1]], [len(ids)], *[[x] for x in raw]])

        for batch in batches:
            ids, labels, flags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vectors = batch.column(3)
            offsets = vectors.offsets.to_numpy()
            x = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            sizes = np.diff(offsets)
            good = np.flatnonzero(wrong[offsets[1:]] == wrong[offsets[:-1]])
            bucket = labels % rules.buckets
            for key in {(int(k), int(d)) for k, d in zip(bucket[good], sizes[good])}:
                mine = good[(bucket[good] == key[0]) & (sizes[good] == key[1])]
                values = x[offsets[mine][:, None] + np.arange(key[1])]
                q = np.clip(np.floor(values * rules.scale), -LIMIT, LIMIT).astype(np.int32)
                for at in range(0, len(mine), rules.block_rows):
                    cut = slice(at, at + rules.block_rows)
                    parts = held.setdefault(key, [])
                    parts.append((ids[mine[cut]], labels[mine[cut]], flags[mine[cut]].astype(np.uint8), q[cut]))
                    if sum(len(p[0]) for p in parts) >= rules.block_rows:
                        yield emit(key, held.pop(key))
                        made += 1
        for key in sorted(held):
            yield emit(key, held[key])
            made += 1

    return index


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of the blocks, one row each."""
    schema = _arrow(ANCHOR)
    for batch in batches:
        for r in batch.to_pylist():
            n, dims = r["n"], r["dims"]
            side = Side.read(n, dims, *(r[c] for c in ("ids", "labels", "vectors", "means", "deviations")))
            at = np.flatnonzero(np.frombuffer(r["flags"], np.uint8))
            yield _batch(
                schema,
                [(r["block"] << 16) + at, [r["bucket"]] * len(at), [dims] * len(at), side.ids[at], side.labels[at]]
                + [[x[i].tobytes() for i in at] for x in (side.q, side.means, side.deviations)],
            )


def _packer(rules: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of anchors to blocks; ``found`` (scores of the positives), where it is there, gives the windows of the negatives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, made = _arrow(PACK), {}, 0
        first = TaskContext.get().partitionId() << 22

        def emit(key: tuple[int, int], rows: list) -> pa.RecordBatch:
            low, high = np.ones((len(rows), rules.positives), np.int64), np.zeros((len(rows), rules.positives), np.int64)
            for i, r in enumerate(rows):
                for j, score in enumerate(r.get("scores") or []):
                    low[i, j], high[i, j] = -(-rules.low * score // 100), rules.high * score // 100
            ints = [np.array([r[c] for r in rows], np.int64).tobytes() for c in ("uid", "id", "label")]
            raw = [b"".join(r[c] for r in rows) for c in ("vector", "means", "deviations")]
            return _batch(schema, [[first + made], [key[0]], [key[1]], *[[x] for x in (*ints, *raw, low.tobytes(), high.tobytes())]])

        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(key := (r["bucket"], r["dims"]), []).append(r)
                if len(held[key]) == rules.anchor_rows:
                    yield emit(key, held.pop(key))
                    made += 1
        for key in sorted(held):
            yield emit(key, held[key])
            made += 1

    return pack


def _searcher(rules: Mining, negatives: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the join of blocks of anchors with blocks of data to the best rows of each anchor (and positive)."""
    k = rules.negatives if negatives else rules.positives
    slots = rules.positives if negatives else 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = _arrow(FOUND), {}

        def emit(uids: np.ndarray, best: list[Best]) -> pa.RecordBatch:
            columns = [[], [], [], []]
            for slot, b in enumerate(best):
                r, c = np.nonzero(b.score > NEVER)
                for column, x in zip(columns, (uids[r], np.full(len(r), slot), b.score[r, c], b.id[r, c]), strict=True):
                    column.append(x)
            return _batch(schema, [np.concatenate(c) for c in columns])

        for batch in batches:
            column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                number, raw = lambda c: column[c][i].as_py(), lambda c: column[c][i].as_buffer()  # noqa: B023, E731
                uids = np.frombuffer(raw("a_uids"), np.int64)
                a = Side.read(len(uids), number("a_dims"), *(raw(f"a_{c}") for c in ("ids", "labels", "vectors", "means", "deviations")))
                b = Side.read(number("n"), number("dims"), *(raw(c) for c in ("ids", "labels", "vectors", "means", "deviations")))
                if (name := number("a_block")) not in held:
                    if len(held) == HELD:
                        yield emit(*held.pop(next(iter(held))))
                    held[name] = uids, [Best(len(uids), k) for _ in range(slots)]
                best = held[name][1]
                if negatives:
                    low, high = (np.frombuffer(raw(c), np.int64).reshape(len(uids), slots) for c in ("a_low", "a_high"))
                    least = np.maximum(low, np.stack([x.score[:, -1] for x in best], axis=1))
                    floor, top = np.where(low > high, 2**62, least).min(1), np.where(low > high, NEVER, high).max(1)
                else:
                    floor, top = best[0].score[:, -1], np.full(len(uids), 2**62)
                rows, cols, exact, may = scores(a, b, floor, top, rules.levels)
                same = a.labels[rows][:, None] == b.labels[cols]
                for slot, x in enumerate(best):
                    if negatives:
                        ok = may & ~same & (exact >= low[rows, slot][:, None]) & (exact <= high[rows, slot][:, None])
                    else:
                        ok = may & same & (a.ids[rows][:, None] != b.ids[cols])
                    x.add(rows, b.ids[cols], exact, ok)
        for uids, best in held.values():
            yield emit(uids, best)

    return search


def vector_index(df: DataFrame, anchors: Column, rules: Mining, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Blocks (``BLOCK``) of the usable rows of ``df``, rows that ``anchors`` holds for marked in them; stored."""
    rows = df.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vector).alias("vector"),
    ).dropna(subset=["id", "label", "vector"])
    path = scratch_path(df.sparkSession, "vectors")
    rows.mapInArrow(_indexer(rules), BLOCK).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _stripes(spark: SparkSession, rows: int, size: int, n: int, rules: Mining) -> int:
    """How many stripes of data meet the ``n`` anchors: as the comparisons need, but not so many that the repeated anchors outgrow the
    data, and never so few that a stripe is more than its bound in rows or bytes."""
    fair = max(2 * spark.sparkContext.defaultParallelism, rows // max(1, n))
    return max(1, -(-rows // rules.stripe_rows), -(-size // rules.stripe_bytes), min(fair, -(-rows * n // rules.stripe_pairs)))


def search(index: DataFrame, anchors: DataFrame, rules: Mining, negatives: bool) -> DataFrame:
    """uid, slot, found: array of (score, id), best first. anchors: rows ``ANCHOR``, with ``scores`` for negatives.

    Both sides are shuffled by stripe, whatever their size: Spark's guess of it knows nothing of the repeats, and a broadcast of
    them would be the driver's to hold. A task buffers one stripe of data while the blocks of anchors pass by.
    """
    spark = index.sparkSession
    size = F.sum(F.octet_length("vectors") + F.octet_length("means") + F.octet_length("deviations"))
    (rows, total), n = index.agg(F.sum("n"), size).first(), anchors.count()
    stripes = _stripes(spark, rows or 0, total or 0, n, rules)
    packed = anchors.repartition(max(1, -(-n // (16 * rules.anchor_rows)))).mapInArrow(_packer(rules), PACK)
    packed = packed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    # the blocks of a task of the index go round the stripes, each task's from another one on
    first = F.pmod(F.xxhash64(F.shiftright("block", 22)), F.lit(stripes))
    data = index.drop("flags").withColumn("stripe", F.pmod(first + F.col("block"), F.lit(stripes)).cast("int"))
    # a task for each stripe: dealt by hash, several would fall to one
    packed = packed.withColumnRenamed("stripe", "a_stripe").repartitionById(stripes, "a_stripe")
    data = data.repartitionById(stripes, "stripe").hint("merge")
    on = packed["a_stripe"] == data["stripe"]
    pairs = packed.join(data, on if negatives else on & (packed["a_bucket"] == data["bucket"])).drop("a_stripe", "stripe")
    k = rules.negatives if negatives else rules.positives
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "id")))
    found = pairs.mapInArrow(_searcher(rules, negatives), FOUND).groupBy("uid", "slot").agg(F.slice(best, 1, k).alias("best"))
    return found.select("uid", "slot", F.transform("best", lambda x: F.struct((-x["below"]).alias("score"), x["id"].alias("id"))).alias("found"))


def hard_negatives(
    df: DataFrame, anchors: Column, rules: Mining = Mining(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row that ``anchors`` holds for, its ``positives`` best rows of the same label (none with its own id), and for each
    of them the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    * Rows with a null id, label, vector or component, or a component that is NaN or infinite, take no part.
    * Components become ``floor(scale * x)``, held within ``LIMIT``. A shorter vector counts as if it went on with zeros; an
      empty one scores 0 with all.
    * Ties go to the smaller id. Repeated rows count once each, as anchors too. A positive with a negative score has no
      negatives, since its window is empty. An empty table gives no rows. Other columns play no part.
    """
    spark = df.sparkSession
    index = vector_index(df, anchors, rules, vec_id, vector, label)
    path = scratch_path(spark, "anchors")
    index.mapInArrow(_anchors, ANCHOR).write.parquet(path)
    rows = spark.read.parquet(path)
    near_path = scratch_path(spark, "positives")
    search(index, rows, rules, False).select("uid", "found").write.parquet(near_path)
    near = spark.read.parquet(near_path)
    # merged by uid: a broadcast would bring a line for each anchor to the driver
    windowed = rows.join(near.select("uid", F.col("found.score").alias("scores")).hint("merge"), "uid")
    far = search(index, windowed, rules, True)
    pairs = rows.select("uid", F.col("id").alias("anchor_id")).join(near.hint("merge"), "uid").select("uid", "anchor_id", F.posexplode("found").alias("slot", "positive"))
    return pairs.join(far.hint("merge"), ["uid", "slot"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.posexplode("found").alias("nth", "negative"), F.col("positive.score").alias("positive_score")
    ).select(
        "anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score",
        F.col("negative.score").alias("negative_score"),
    )
