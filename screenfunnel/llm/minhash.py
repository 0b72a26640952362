"""Near-duplicate classes by min-max hashing.

Every hash function is evaluated once per shingle and gives two signature values, the smallest and the largest hash; each
agrees for two sets with the probability of their Jaccard similarity. Bands of signature values propose candidates, and a
candidate pair becomes a link only if the full shingle sets confirm it.

Equal sets are one class from the start, so exact copies never meet. Inside a bucket, classes are first compared with one
centre, for a few turns with another centre each. Whatever these links join needs no more comparison: only classes of one
bucket that are still in different components are compared with each other at the end. So a large group of near copies costs
a few comparisons per class, and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.common import free_name
from screenfunnel.llm.graph import connected_components
from screenfunnel.session import scratch_path

#: Ids of texts to compare are broadcast up to this many (16 MB), and joined by a shuffle beyond.
SENT_IDS = 2_000_000
#: Turns in which the members of a bucket are compared with one centre, before the rest is compared in full.
TURNS = 2


@dataclass(frozen=True)
class NearDup:
    """Shingle length in words, similarity in percent, and the shape of the signature: bands * rows = 2 * hash functions.

    With 24 bands of 5 rows, two sets of similarity 0.8 share a band with probability 0.9999.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    seed: int = 20261


class _Words(dict):
    """Hash of a word, worked out once; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lowered, words between ASCII white space.

    A text with fewer words is one shingle; none for a text without words.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    s = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        s = _mixed(s * _MIX[0] + h[k : k + n])
    return np.unique(s)


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray, block: int = 2048) -> np.ndarray:
    """Smallest and largest value of each hash function, one evaluation for both; blocks bound the memory."""
    low, high = None, None
    for i in range(0, len(shingles), block):
        y = shingles[None, i : i + block] * factors[:, None] + terms[:, None]
        a, b = y.min(axis=1), y.max(axis=1)
        low = a if low is None else np.minimum(low, a)
        high = b if high is None else np.maximum(high, b)
    return np.concatenate([low, high])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def _pieces(batch: pa.RecordBatch, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def _signed(spec: NearDup):
    rng = np.random.default_rng(spec.seed)
    n = spec.bands * spec.rows // 2
    factors = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, n, np.uint64)
    # rows of a band come from different functions; minima and maxima are mixed
    order = rng.permutation(2 * n)[: spec.bands * spec.rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            keys, counts, bands = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), spec.words, hashes)
                counts.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(s)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s, factors, terms)[order].reshape(spec.bands, spec.rows)
                bands.append(np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(sig)], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), _lists(bands)],
                ["doc_id", "key", "n_shingles", "bands"],
            )

    return run


def _sets(spec: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            for part in _pieces(batch):
                sets = [shingle_set(t.as_py(), spec.words, hashes) for t in part.column(1).cast(pa.binary())]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = pa.array([np.unique(s.astype(np.uint32).view(np.int32)) for s in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets), halves], ["key", "shingles", "halves"])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def signatures(df: DataFrame, spec: NearDup, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (of the shingle set; null for an empty one), n_shingles, bands."""
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_signed(spec), "doc_id long, key binary, n_shingles long, bands array<long>")


def shingle_sets(keys: DataFrame, classes: DataFrame, texts: DataFrame, spec: NearDup) -> DataFrame:
    """(key, shingles, halves) of the classes ``keys``; halves are the distinct lower 32 bits of the shingle hashes.

    classes: key, first_id. texts: doc_id, text, the whole table. Sets are made again only of texts whose id is the first of a wanted class, and each is matched to its class by its own
    key, so null and repeated ids do no harm.
    """
    ids = _stored(keys.join(classes, "key").select(F.col("first_id").alias("id")).distinct(), "ids")
    few = ids.count() <= SENT_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    made = wanted.mapInArrow(_sets(spec), "key binary, shingles array<long>, halves array<int>")
    return _stored(made.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, spec: NearDup) -> DataFrame:
    """The pairs (a, b) of set keys whose full shingle sets reach the similarity. A set travels to a pair, not to a group."""
    with_b = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    counted = both.select("a", "b", common.alias("n"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return counted.where(100 * F.col("n") >= spec.percent * (F.col("total") - F.col("n"))).select("a", "b")


def _close(spec: NearDup, x: str, y: str):
    """Sizes that allow the similarity at all."""
    return 100 * F.least(x, y) >= spec.percent * F.greatest(x, y)


def near_duplicates(df: DataFrame, spec: NearDup | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    * Null, empty and blank texts have no shingles and are linked with nothing: their component is their own id.
    * Repeated rows and equal texts are linked. ``kept`` is doc_id = component_id, null like null; a component
      of null ids only has a null component_id. An empty table gives no rows; other columns play no part.
    """
    spec = spec or NearDup()
    rows, component = near_duplicate_classes(df, spec, text, doc_id)
    joined = rows.join(component, "key", "left")
    whole = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (key, component) after joining the components that ``links`` (a, b) connect."""
    ends = links.join(labels.select(F.col("key").alias("a"), F.col("component").alias("ca")), "a")
    ends = ends.join(labels.select(F.col("key").alias("b"), F.col("component").alias("cb")), "b")
    joined = connected_components(ends.where("ca != cb").select("ca", "cb"), "ca", "cb").select("id", F.col("component").alias("now"))
    moved = labels.join(joined, labels["component"] == joined["id"], "left")
    return _stored(moved.select("key", F.coalesce("now", "component").alias("component")), "labels")


def _with_centres(named: DataFrame, spec: NearDup, turn: int) -> DataFrame:
    """Pairs of a bucket's centre and its members outside the centre's component.

    The centre belongs to the component with most members there. At first it is the class that meets most others, so that
    the middle of a group is tried first; later turns take any other one, which differs from bucket to bucket.
    """
    prefer = F.col("degree") if turn == 0 else F.xxhash64(F.lit(turn), "key", "band")
    one = F.struct(prefer.alias("order"), "key", "n")
    parts = named.groupBy("band", "component").agg(F.count("*").alias("members"), F.max(one).alias("centre"))
    hubs = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("members", "centre", "component")).alias("hub")).where("parts > 1")
    hubs = hubs.select("band", F.col("hub.centre.key").alias("a"), F.col("hub.centre.n").alias("an"), F.col("hub.component").alias("ac"))
    pairs = named.join(hubs, "band").where((F.col("component") != F.col("ac")) & _close(spec, "n", "an"))
    return _stored(pairs.select("a", F.col("key").alias("b")).distinct(), "pairs")


def near_duplicate_classes(df: DataFrame, spec: NearDup, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, key, n_shingles) and ``component`` (key, component_id): membership and class graph, both stored."""
    rows = _stored(signatures(df, spec, text, doc_id), "signatures")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = _stored(classes, "classes")
    banded = classes.select("key", "n", F.posexplode("bands").alias("i", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("others")).where("others > 1")
    met = banded.join(shared, "band")
    degree = met.groupBy("key").agg(F.sum("others").alias("degree"))
    buckets = _stored(met.join(degree, "key").select("band", "i", "key", "n", "degree"), "buckets")
    keys = _stored(buckets.select("key").distinct(), "keys")
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = shingle_sets(keys, classes, texts, spec)
    labels = keys.withColumn("component", F.col("key"))
    for turn in range(TURNS):
        links = _stored(confirm(_with_centres(buckets.join(labels, "key"), spec, turn), sets, spec), "links")
        if links.isEmpty():
            break
        labels = _merged(labels, links)
    # what is still apart in a bucket is compared inside the join, in the first bucket of a pair and on halves of the hashes
    # with a margin, so that only pairs that are links, or all but, leave it; those are confirmed in full like the others
    named = buckets.join(labels, "key")
    apart = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
    open_ = named.join(apart, "band").join(classes.select("key", "bands"), "key").join(sets.select("key", "halves"), "key")
    open_ = _stored(open_.select("band", "key", "n", "component", F.slice("bands", 1, F.col("i")).alias("earlier"), "halves"), "open")
    names = ["band", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "component", "earlier", "halves")]]
    common = F.size(F.array_intersect("halves", "halves_b"))
    near = 100 * common >= (spec.percent - 1) * (F.size("halves") + F.size("halves_b") - common)
    fits = (F.col("component") < F.col("component_b")) & _close(spec, "n", "n_b") & ~F.arrays_overlap("earlier", "earlier_b") & near
    cross = _stored(open_.join(open_.select(*names), "band").where(fits).select(F.col("key").alias("a"), F.col("key_b").alias("b")), "pairs")
    more = _stored(confirm(cross, sets, spec), "links")
    if not more.isEmpty():
        labels = _merged(labels, more)
    label = classes.select("key", "first_id").join(labels, "key", "left")
    label = label.select("key", "first_id", F.coalesce("component", "key").alias("component"))
    least = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    component = _stored(label.join(least, "component").select("key", "component_id"), "components")
    return rows.select("doc_id", "key", "n_shingles"), component


def keep_one_of_each(df: DataFrame, spec: NearDup | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, with its columns: the smallest id of each component.

    Rows are named by their ids: rows that share an id go if one of them goes, and rows with a null id stay. Dropped ids are
    sent to the rows up to ``SENT_IDS``, so that texts need not be shuffled, and joined by a shuffle beyond.
    """
    spec = spec or NearDup()
    rows, component = near_duplicate_classes(df, spec, text, doc_id)
    name = free_name(df, "gone")
    judged = rows.join(component, "key", "left")
    gone = judged.where("key is not null and doc_id != component_id").select(F.col("doc_id").alias(name))
    gone = _stored(gone.distinct(), "gone")
    id_ = df[f"`{doc_id}`"].cast("long")
    few = gone.count() <= SENT_IDS
    return df.join(F.broadcast(gone) if few else gone, id_ == gone[name], "left_anti")
