"""Token ids as binary shards in training order.

Documents are tokenised in the order of their table and cut into sequences of a fixed number of ids. A keyed Feistel network
with cycle-walking permutes the numbers 0 to n-1 of the sequences, so each one's place in training order is computed, not
drawn, and no list of places exists anywhere. Places are dealt to shards by range; a task sorts its shards and writes them as
records of one stride, so a reader finds any place by arithmetic and goes on from there.

The sequences are stored once in table order, compressed one by one, because their number must be known before the first
place is; they stay compressed in the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.llm.packing import END_ID, WINDOW
from screenfunnel.llm.wordbpe import WordBpe
from screenfunnel.session import scratch_path

#: Sequences of a shard.
SHARD = 4096
STORED = "part long, local long, n_ids long, ids_crc32 long, packed binary"
RECORD = "slot long, sequence long, n_ids long, ids_crc32 long, packed binary"
ROW = "slot long, sequence long, shard long, byte_offset long, n_ids long, ids_crc32 long"


class Feistel:
    """A permutation of 0 to n-1 from a key. Four rounds on halves of the bits; numbers beyond n-1 walk on until inside."""

    ROUNDS = 4

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(self.ROUNDS)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in self.keys:
            h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << bits) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        x = self._once(numbers.astype(np.uint64))
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out])
        return x.astype(np.int64)


_TOKENIZERS: dict[str, WordBpe] = {}


def _sequences(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[np.ndarray]:
    """The ids of a partition's documents, each ended by ``END_ID``, in windows; the last one may be shorter."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordBpe(path)
    bpe = _TOKENIZERS[path]
    rest = np.empty(0, np.uint16)
    for batch in batches:
        for text in batch.column(0):
            bpe.tidy()
            rest = np.concatenate([rest, bpe.ids(bpe.chunks(text.as_py() or "")), [np.uint16(END_ID)]])
            full = len(rest) // window * window
            yield from rest[:full].reshape(-1, window)
            rest = rest[full:]
    if len(rest):
        yield rest


def _stored(path: str, window: int):
    """The sequences of a partition by their number in it, each compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, tool = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        held: list[bytes] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in held]
            return pa.RecordBatch.from_pydict(
                {"part": [part] * n, "local": range(done - n, done), "n_ids": [len(x) // 2 for x in held], "ids_crc32": crc,
                 "packed": pa.array([tool.compress(x) for x in held], pa.binary())}
            )

        for ids in _sequences(batches, path, window):
            held.append(ids.astype("<u2").tobytes())
            done += 1
            if len(held) == 1024:
                yield batch()
                held = []
        if held:
            yield batch()

    return run


def _placed(starts: dict[int, int], place: Feistel):
    """Numbers in the whole table and slots instead of numbers in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([starts[p] for p in batch.column(0).to_pylist()], np.int64)
            numbers = first + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place(numbers)), pa.array(numbers), *batch.columns[2:]], [c.split()[0] for c in RECORD.split(", ")])

    return run


def stride(window: int = WINDOW) -> int:
    """Bytes of a record: the number of ids, then the ids, two bytes each, padded with zeros."""
    return 4 + 2 * window


def _written(folder: str, window: int, per_shard: int):
    """Write the shards of a partition that is sorted by slot. A shard appears under its name when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        size, tool = stride(window), zstandard.ZstdDecompressor()
        out, now, draft = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(draft, f"{root}/{shard_name(now)}")

        for batch in batches:
            slots = batch.column(0).to_pylist()
            for slot, n, packed in zip(slots, batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if slot // per_shard != now:
                    close()
                    now = slot // per_shard
                    draft = f"{root}/.{shard_name(now)}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                out.write(n.to_bytes(4, "little") + tool.decompress(packed).ljust(2 * window, b"\0"))
            slot = np.array(slots, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(slot // per_shard), pa.array(slot % per_shard * size), batch.column(2), batch.column(3)],
                ["slot", "sequence", "shard", "byte_offset", "n_ids", "ids_crc32"],
            )
        close()

    return run


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def whole_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark itself would use, so that shards and manifest lie on the same file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def materialise(df: DataFrame, folder: str, tokenizer: str | None = None, key: str = "order", window: int = WINDOW,
                per_shard: int = SHARD, text: str = "text") -> DataFrame:
    """Write the shards into ``folder`` (shared by all executors) and return the manifest, which is stored there too.

    Manifest: one row per sequence with its slot, number in table order, shard, byte offset there, ids and their CRC-32.
    Slots are 0 to n-1, each once. A null or empty text is one end id; repeated rows are sequences like any other; an empty
    table writes no shard; document ids and other columns play no part.
    """
    spark = df.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = whole_uri(spark, folder)
    path = scratch_path(spark, "sequences")
    texts = df.select(F.col(text).alias("text"))
    texts.mapInArrow(_stored(tokenizer, window), STORED).write.option("compression", "none").parquet(path)
    stored = spark.read.parquet(path)
    # one count per partition of the table
    starts, total = {}, 0
    for row in sorted(stored.groupBy("part").count().collect()):
        starts[row["part"]] = total
        total += row["count"]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    records = stored.mapInArrow(_placed(starts, Feistel(total, key)), RECORD)
    shard = F.expr(f"slot div {per_shard}")
    dealt = records.repartition(shard).sortWithinPartitions("slot")
    dealt.mapInArrow(_written(folder, window, per_shard), ROW).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_slots(folder: str, first: int = 0, window: int = WINDOW, per_shard: int = SHARD) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on, in training order: one seek, then straight through the shards.

    ``folder`` is a URI as :func:`whole_uri` gives it, or a local path.
    """
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    slot = first
    while store.get_file_info(path := f"{root}/{shard_name(slot // per_shard)}").type == fs.FileType.File:
        with store.open_input_file(path) as f:
            f.seek(slot % per_shard * stride(window))
            while record := f.read(stride(window)):
                n = int.from_bytes(record[:4], "little")
                yield slot, np.frombuffer(record, "<u2", n, 4)
                slot += 1
        if slot % per_shard:
            return
