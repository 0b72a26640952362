"""Exact dedup through a sharded cuckoo-filter index of digests.

Texts are reduced to the SHA-256 of their content without white space, in the JVM. The digests, never the texts, are dealt
to shards by their own bits, so shards are even whatever the copies. A shard is a ``CuckooIndex``: its filter answers most
new digests with one look; a hit is verified against the full digests stored by bucket; an overflow rebuilds a filter of
twice the size from those stored keys. Copies in one batch are folded into one row before the shuffle, so a digest that
holds a third of all rows reaches its shard as one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenfunnel.llm.common import SPACES
from screenfunnel.session import scratch_path

#: Groups whose dropped copies are recognised before texts are shuffled; a broadcast of so many short rows at most.
HOT_GROUPS = 1000


class CuckooIndex:
    """Live digests (bytes) with a value each. ``put`` and ``remove`` keep filter and stored keys in step."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self.content: dict[bytes, list[list]] = {}
        self.size = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[:8], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def may_hold(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.filter[a] or mark in self.filter[b]

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, value], verified in full."""
        if not self.may_hold(digest):
            return None
        return next((e for e in self.content.get(digest[:4], ()) if e[0] == digest), None)

    def put(self, digest: bytes, value) -> None:
        """A digest that ``find`` does not know."""
        self.content.setdefault(digest[:4], []).append([digest, value])
        self.size += 1
        if not self._mark(digest):
            self.grow()

    def _mark(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for place in (a, b):
            if len(self.filter[place]) < self.SLOTS:
                self.filter[place].append(mark)
                return True
        place = b
        for kick in range(self.KICKS):
            bucket = self.filter[place]
            slot = kick % self.SLOTS
            mark, bucket[slot] = bucket[slot], mark
            place = self._other(place, mark)
            if len(self.filter[place]) < self.SLOTS:
                self.filter[place].append(mark)
                return True
        return False

    def grow(self) -> None:
        """Twice the buckets, or more if need be, filled from the stored keys."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(self._mark(d) for d, _ in self.entries()):
                return

    def remove(self, digest: bytes) -> bool:
        """Whether the digest was live; it is not any more."""
        if (entry := self.find(digest)) is None:
            return False
        same = self.content[digest[:4]]
        same.remove(entry)
        if not same:
            del self.content[digest[:4]]
        mark, a, b = self._places(digest)
        self.filter[a if mark in self.filter[a] else b].remove(mark)
        self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for same in self.content.values():
            yield from same


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without blanks and U+0009 to U+000D; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""), 256))


#: A row of the index: digest, the row that stays (most code points, then smallest id, then row number; null ids last), copies.
ENTRY = "digest binary, n_points long, doc_id long, row long, copies long"


def _key(n_points: int, doc_id: int | None, row: int) -> tuple:
    return (-n_points, doc_id is None, doc_id or 0, row)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*entries) if entries else [[] for _ in kinds]
    names = ["digest", "n_points", "doc_id", "row", "copies"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside a batch become one row; removals (copies -1) stay as they are."""
    for batch in batches:
        best: dict[bytes, tuple] = {}
        out = []
        for digest, n, doc, row, copies in _rows(batch):
            if copies < 0:
                out.append((digest, n, doc, row, copies))
                continue
            old = best.get(digest)
            if old is None or _key(n, doc, row) < _key(*old[1:4]):
                best[digest] = (digest, n, doc, row, copies + (old[4] if old else 0))
            else:
                best[digest] = (*old[:4], old[4] + copies)
        yield _batch([*best.values(), *out])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: insertions first to last, then removals; yields the live entries."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, n, doc, row, copies in _rows(batch):
            if copies < 0:
                gone.append(digest)
            elif (entry := index.find(digest)) is None:
                index.put(digest, (n, doc, row, copies))
            else:
                old = entry[1]
                first = (n, doc, row) if _key(n, doc, row) < _key(*old[:3]) else old[:3]
                entry[1] = (*first, old[3] + copies)
    for digest in gone:
        index.remove(digest)
    out = []
    for digest, value in index.entries():
        out.append((digest, *value))
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def build_index(rows: DataFrame, live: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The live entries (``ENTRY``) of ``live`` (an earlier index) after adding ``rows`` and then deleting ``gone``.

    rows: digest, n_points, doc_id, row. gone: a column ``digest``; unknown digests are ignored. An empty input gives an
    empty index.
    """
    changes = rows.select("digest", "n_points", "doc_id", "row", F.lit(1).cast("long").alias("copies"))
    if live is not None:
        changes = changes.unionByName(live)
    if gone is not None:
        none = F.lit(0).cast("long")
        changes = changes.unionByName(
            gone.select("digest", none.alias("n_points"), none.alias("doc_id"), none.alias("row"), F.lit(-1).cast("long").alias("copies"))
        )
    return changes.mapInArrow(_fold, ENTRY).repartition("digest").mapInArrow(_index, ENTRY)


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    * Of rows with the same text, exactly one is kept: most code points in the original text, then smallest id (null ids
      last), then first row of the table. Null texts are one group with empty and blank ones.
    * Repeated rows are members like any other; an empty table gives no rows; other columns play no part.
    """
    spark = df.sparkSession
    narrow = df.select(
        digest_of(F.col(text)).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
    )
    # stored once: row numbers stay the same, and texts are read once
    path = scratch_path(spark, "digests")
    narrow.write.parquet(path)
    rows = spark.read.parquet(path)
    best = build_index(rows).select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "copies")
    return rows.join(best, "digest").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with its columns; same rules as ``exact_duplicates``.

    Rows are found again by digest, length and id, so texts are shuffled once. Dropped copies of the ``HOT_GROUPS`` largest
    groups leave before that.
    """
    columns = [F.col(f"`{c}`").alias(c) for c in df.columns]
    whole = df.select(
        F.struct(*columns).alias("whole"),
        digest_of(F.col(text)).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        F.col(doc_id).cast("long").alias("doc_id"),
    )
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "copies")
    build_index(whole.select("digest", "n_points", "doc_id", F.lit(0).cast("long").alias("row"))).write.parquet(path)
    index = spark.read.parquet(path).select("digest", F.col("n_points").alias("k_points"), F.col("doc_id").alias("k_id"), "copies")
    same = (F.col("n_points") == F.col("k_points")) & F.col("doc_id").eqNullSafe(F.col("k_id"))
    hot = index.where("copies > 1").orderBy(F.desc("copies"), "digest").limit(HOT_GROUPS).drop("copies")
    left = whole.join(F.broadcast(hot), "digest", "left").where(F.col("k_points").isNull() | same).drop("k_points", "k_id")
    stays = left.join(index.drop("copies"), "digest").where(same)
    once = W.partitionBy("digest").orderBy("n_points")
    return stays.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("whole.*")
