"""A Merkle manifest of a table: a tree of fan-out 8 per group, a tree over the groups' roots, and versions for changed leaves.

Leaves are hashed where the rows lie; from then on only digests move. Leaves are numbered in their group by a range sort, and
every FAN ** depth consecutive ones are a block: one row that one task folds. Blocks' roots are the
leaves of the next storey, and so on, until each group has one root; the groups' roots are a tree of their own. A changed leaf
gives a version of its tree that copies only its ancestors and shares all other nodes: within the block these are few hashes,
and above it the version continues with the siblings that the block's row got from the storeys above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenfunnel.operators.order import null_safe_join
from screenfunnel.session import scratch_path

FAN = 2**3
#: Levels that one block folds by default; a block has at most FAN ** DEPTH leaves.
DEPTH = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What stands beside a node on its way up, one entry a level.
PATH = "array<struct<left: string, right: string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def node(children: Sequence[str]) -> str:
    """Digests are hashed as their hex text."""
    return sha256("".join(children).encode()).hexdigest()


class PersistentTree:
    """A tree over some digests whose versions share all nodes that a change does not reach."""

    def __init__(self, leaves: Sequence[str], levels: int | None = None) -> None:
        """Folds until one node remains, or exactly ``levels`` times (a run of one node becomes a node as well)."""
        self.levels = [list(leaves)]
        while (len(self.levels[-1]) > 1) if levels is None else len(self.levels) <= levels:
            last = self.levels[-1]
            self.levels.append([node(last[at : at + FAN]) for at in range(0, len(last), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Digests left and right of the node in its run, level by level."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % FAN
            out.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
            at //= FAN
        return out

    def version(self, at: int, leaf: str) -> dict[tuple[int, int], str]:
        """The copied nodes of the version with another leaf, by (level, place): the path to the root and nothing else."""
        copied = {(0, at): leaf}
        for k, (left, right) in enumerate(self.siblings(at)):
            leaf, at = node((left, leaf, right)), at // FAN
            copied[k + 1, at] = leaf
        return copied


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``place``: the row's number (from 0) in its group in the order of ``order``, nulls first; stored.

    The order must be total. A group may hold most rows: they are range-sorted over all tasks, and only one line for each group
    and task is windowed.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    path = scratch_path(spark, "sorted")
    at = F.monotonically_increasing_id()
    df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", at).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    starts = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = null_safe_join(rows, starts, [group, "_part"])
    return placed.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def block_tree(block: int, digests: Sequence[str], depth: int) -> PersistentTree:
    """The tree of a block: ``depth`` levels unless it is all its group has (the first block, and not full)."""
    return PersistentTree(digests, depth if block or len(digests) == FAN**depth else None)


def _roots(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group, block, digests = batch.columns
        roots = [block_tree(b, x.as_py(), depth).root for b, x in zip(block.to_pylist(), digests, strict=True)]
        yield pa.RecordBatch.from_arrays([group, block, pa.array(roots, pa.string())], names=["group", "place", "digest"])


def _paths(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them to their leaves with the path above each."""
    for batch in batches:
        group, block, digests, upper = (c.to_pylist() for c in batch.columns)
        out = ([], [], [])
        for i in range(batch.num_rows):
            tree = block_tree(block[i], digests[i], depth)
            for k in range(len(digests[i])):
                out[0].append(group[i])
                out[1].append(block[i] * FAN**depth + k)
                out[2].append([{"left": x, "right": y} for x, y in tree.siblings(k)] + (upper[i] or []))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], PATH_TYPE)], names=["group", "place", "path"]
        )


def blocks(leaves: DataFrame, depth: int, *payload: str) -> DataFrame:
    """group, block, ``leaves``: the block's leaves and payload by place; stored."""
    spark = leaves.sparkSession
    path = scratch_path(spark, "blocks")
    rows = leaves.withColumn("block", F.shiftright("place", 3 * depth))
    packed = rows.groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("place", "digest", *payload))).alias("leaves"))
    packed.write.parquet(path)
    return spark.read.parquet(path)


def storey(packed: DataFrame, depth: int) -> DataFrame:
    """group, place (the block's number), digest (its root)."""
    schema = "group string, place long, digest string"
    return packed.select("group", "block", "leaves.digest").mapInArrow(lambda rows: _roots(rows, depth), schema)


def leaf_paths(packed: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """group, place, path of the leaves of blocks, from those of the blocks (``upper``: group, place, path)."""
    over = upper.select("group", F.col("place").alias("block"), F.col("path").alias("above"))
    rows = null_safe_join(packed.select("group", "block", "leaves.digest"), over, ["group", "block"])
    return rows.select("group", "block", "digest", "above").mapInArrow(lambda x: _paths(x, depth), f"group string, place long, path {PATH}")


def above(roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(group, digest) of every group's root, and (group, place, path) of every given root, whose path is empty if it is the
    group's only one.

    Storeys are added until no group has more than one block: each has FAN ** depth times fewer rows than the one below.
    """
    spark = roots.sparkSession
    single, floors = [], []
    while True:
        path = scratch_path(spark, "roots")
        roots.write.parquet(path)
        stored = spark.read.parquet(path)
        several = stored.where("place = 1").select("group", F.lit(True).alias("several"))
        marked = null_safe_join(stored, several, ["group"], "left")
        single.append(marked.where("several IS NULL").drop("several"))
        more = marked.where("several").drop("several")
        if not more.head(1):
            break
        floors.append(blocks(more, depth))
        roots = storey(floors[-1], depth)
    tops = [x.select("group", "place", F.array().cast(PATH).alias("path")) for x in single]
    paths = tops[-1]
    for packed, alone in zip(reversed(floors), reversed(tops[:-1]), strict=True):
        paths = leaf_paths(packed, paths, depth).unionByName(alone)
    return reduce(DataFrame.unionByName, single).select("group", "digest"), paths


def _prover(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Blocks of leaves with the path above them to one row per leaf."""
    kinds = [("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("copied", pa.int32())]
    for batch in batches:
        block, leaves, path, subroot, root = batch.columns
        for i in range(batch.num_rows):
            rows, upper, top = leaves[i].as_py(), [(p["left"], p["right"]) for p in path[i].as_py()], root[i].as_py()
            tree = block_tree(block[i].as_py(), [r["digest"] for r in rows], depth)
            tail = "".join(chain.from_iterable(upper)).encode()
            columns = tuple([] for _ in kinds)
            for k, r in enumerate(rows):
                own = tree.siblings(k)
                proof = sha256("".join(chain.from_iterable(own)).encode())
                proof.update(tail)
                # a leaf that was not changed is folded up through its proof like any other: only that verifies it
                version = tree.version(k, r["digest"] if r["changed"] is None else r["changed"])
                folded, copied = version[len(tree.levels) - 1, 0], len(version) - 1 + len(upper)
                for left, right in upper:
                    folded = node((left, folded, right))
                for column, x in zip(columns, (r["id"], r["digest"], subroot[i].as_py(), top, proof.hexdigest(), folded, 0 if r["changed"] is None else copied), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def manifest(
    df: DataFrame, group: str, order: str, leaf: Callable[[dict[str, Column]], Column], changed: Callable[[dict[str, Column]], Column],
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row of ``df``: id (the ``order`` column), leaf, subroot, root, proof_sha256, folded_root, copied, verified.

    leaf, changed: from the columns of ``df`` to the leaf's digest and to that of the changed row (null: not changed).
    folded_root: made of the changed leaf (else the leaf) and its proof, so the root of the version that has it; copied: the nodes that this version does not share.

    * Leaves of a group stand in the order of ``order`` (a whole number), nulls first, ties by digest; null is a group of its
      own, before the others. Equal rows are leaves of their own, next to each other.
    * An empty table gives no rows; other columns play no part.
    """
    spark = df.sparkSession
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    rows = df.select(
        columns[group].cast("string").alias("group"), columns[order].cast("long").alias("id"), leaf(columns).alias("digest"),
        changed(columns).alias("changed"), F.monotonically_increasing_id().alias("_row"),
    )
    path = scratch_path(spark, "leaves")
    rows.write.parquet(path)
    packed = blocks(numbered(spark.read.parquet(path), "group", ["id", "digest", "_row"]), depth, "id", "changed")
    tops, paths = above(storey(packed, depth), depth)

    # the groups' roots are the leaves of one more tree
    top_path = scratch_path(spark, "subroots")
    tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest").write.parquet(top_path)
    crown = numbered(spark.read.parquet(top_path), "group", ["name"])
    crown_path = scratch_path(spark, "crown")
    crown.write.parquet(crown_path)
    crown = spark.read.parquet(crown_path)
    crown_blocks = blocks(crown.select("group", "place", "digest"), depth)
    root, upper = above(storey(crown_blocks, depth), depth)
    crown_paths = leaf_paths(crown_blocks, upper, depth)
    named = crown.join(crown_paths.select("place", F.col("path").alias("crown")), "place")
    named = named.join(root.select("group", F.col("digest").alias("root")), "group").select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "crown", "root")

    # one line for each block; only the last join moves leaves
    lines = null_safe_join(paths, named, ["group"]).select("group", F.col("place").alias("block"), F.concat("path", "crown").alias("path"), "subroot", "root")
    whole = null_safe_join(packed, lines, ["group", "block"]).select("block", "leaves", "path", "subroot", "root")
    out = whole.mapInArrow(lambda rows: _prover(rows, depth), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied int")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaf(c: dict[str, Column]) -> Column:
    return leaf_digest(*[c[x] for x in ("doc_id", "source", "lang", "n_chars", "text")])


def tampered_leaf(c: dict[str, Column]) -> Column:
    """Where 3 divides the CRC of the id: the leaf with A-Z of the text in lower case. A null id is not tampered with."""
    tampered = leaf_digest(*[c[x] for x in ("doc_id", "source", "lang", "n_chars")], F.translate(c["text"], UPPER, UPPER.lower()))
    return F.when(F.crc32(c["doc_id"].cast("string").cast("binary")) % 3 == 0, tampered)
