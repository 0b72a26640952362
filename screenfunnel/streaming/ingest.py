"""New files are picked up once; what they say of a unit (a log, a product code) replaces what older files said of it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from screenfunnel.sources import text_records as tr
from screenfunnel.sources.sinks import UNFINISHED, read_manifest, write_manifest

#: Columns that a stream carries for the upsert: when its file was changed, and the file's path.
ORIGIN = ("_modified", "_file")
BUCKET = "_bucket"
#: Folders of the target. It is fixed when a table is made; at 100 TB take some thousands.
BUCKETS = 64
#: Rows that one task of a merge sorts.
TASK_ROWS = 500_000
#: How many files a task writes side by side; rows for more are sorted first.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def origin() -> list:
    """The columns of :data:`ORIGIN`, for streams of files."""
    return [F.col("_metadata.file_modification_time").alias(ORIGIN[0]), F.col("_metadata.file_path").alias(ORIGIN[1])]


def append_new(target: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds only rows whose keys the table does not hold yet, whatever newer files say.

    A batch that is run again after a failure therefore adds nothing twice, and no state grows with
    the stream: the keys are read from the table itself, columns pruned.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        try:
            stored = batch.sparkSession.read.parquet(target).select(*keys)
            fresh = fresh.join(stored, list(keys), "left_anti")
        except AnalysisException as error:
            # Only the first batch has no table yet.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("append").parquet(target)

    return write


def newest_per_unit(rows: DataFrame, unit: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The rows of each unit's newest file, one per key.

    Newer is the later change, then the greater path. Units are told apart null-safe. Rows are moved once, to the task of their
    unit, and sorted once for both steps; the sort, and a unit of many rows in it, may go to disk.
    """
    of_key = Window.partitionBy(*unit, *keys).orderBy(*[F.desc(c) for c in ORIGIN])
    of_unit = Window.partitionBy(*unit)
    last = rows.withColumn("_place", F.row_number().over(of_key)).where("_place = 1").drop("_place")
    marked = last.withColumn("_latest", F.max(F.struct(*ORIGIN)).over(of_unit))
    return marked.where(F.struct(*ORIGIN).eqNullSafe(F.col("_latest"))).drop("_latest")


def stored_rows(spark: SparkSession, target: str, buckets: Sequence[int]) -> DataFrame | None:
    """The rows of some buckets of a table; other folders are not read. None if there is no table yet."""
    try:
        return spark.read.parquet(target).where(F.col(BUCKET).isin(list(buckets)))
    except AnalysisException as error:
        # a first batch that was cut off leaves a folder without files
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def _replace_folders(rows: DataFrame, target: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(
        BUCKET
    ).parquet(target)


def upsert_newest(
    target: str, checkpoint: str, unit: Sequence[str], keys: Sequence[str] = (), buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """A batch writer after which the table holds, per ``unit``, the rows of its newest file and no others.

    The table is cut into folders by a hash of the unit. Only folders that the batch reaches are read, merged and written
    again, so a batch costs what it touches and not the whole table. The merged rows are complete in ``checkpoint`` before the
    first folder is replaced: a run that is cut off while it replaces them repeats that step from there, and one cut
    off earlier has changed nothing. Where there is no table yet nothing can be lost, and the rows go to the folders at once.
    Files that give no rows replace nothing. Batches need the columns of :func:`origin`. A batch is read twice, to count its rows
    and to merge them; it is not kept.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    merged, marks = f"{checkpoint.rstrip('/')}/merged/data", f"{checkpoint.rstrip('/')}/merged/manifest"
    bucket = F.pmod(F.hash(*unit), F.lit(buckets))

    def merge(batch: DataFrame, batch_id: int) -> bool:
        """True if the merged rows are in ``checkpoint``, to be put into their folders."""
        spark = batch.sparkSession
        # at most ``buckets`` numbers
        reached = {r[0]: r[1] for r in batch.groupBy(bucket).count().collect()}
        if not reached:
            return False
        old, n_rows = stored_rows(spark, target, list(reached)), sum(reached.values())
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        n_rows += 0 if old is None else old.count()
        # A multiple of the buckets: a task's units then mostly are of one folder.
        tasks = buckets * math.ceil(n_rows / buckets / TASK_ROWS)
        newest = newest_per_unit(rows.repartition(tasks, *unit), unit, keys).withColumn(BUCKET, bucket)
        if old is None:
            _replace_folders(newest, target)
            return False
        write_manifest(spark, marks, UNFINISHED)
        newest.write.mode("overwrite").option("compression", "zstd").parquet(merged)
        write_manifest(spark, marks, {"batch": batch_id})
        return True

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = read_manifest(spark, marks)
        if (found or {}).get("batch") != batch_id and not merge(batch, batch_id):
            return
        # A merged file is of one folder, so a task has few files open, and its rows need no sort by folder.
        before = spark.conf.get(OPEN_FILES, None)
        spark.conf.set(OPEN_FILES, "64")
        try:
            _replace_folders(spark.read.parquet(merged), target)
        finally:
            spark.conf.unset(OPEN_FILES) if before is None else spark.conf.set(OPEN_FILES, before)

    return write


def read_newest(spark: SparkSession, target: str) -> DataFrame:
    """A table of :func:`upsert_newest` without its helper columns."""
    return spark.read.parquet(target).drop(BUCKET, *ORIGIN)


def ingest(
    rows: DataFrame, target: str, checkpoint: str, unit: Sequence[str], keys: Sequence[str] = (), buckets: int = BUCKETS
) -> StreamingQuery:
    """Process all files that are there now, then stop; started again, it takes only new ones. See :func:`upsert_newest`."""
    return (
        rows.writeStream.foreachBatch(upsert_newest(target, checkpoint, unit, keys, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dock_logs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.readStream.option("pathGlobFilter", "*.log").text(path, wholetext=True)
    named = files.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"), "value", *origin())
    return tr.parse_dock_logs(named, ORIGIN)


def stream_offers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    responses = spark.readStream.schema(tr.OFFER_SCHEMA).option("multiLine", multi_line).json(path)
    return tr.explode_offers(responses.select("*", *origin()), ORIGIN)


def ingest_logs(spark: SparkSession, path: str, target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Poses of docking logs; a corrected log in another folder below ``path`` replaces all poses of the older one."""
    return ingest(stream_dock_logs(spark, path), target, checkpoint, ["ligand_id", "receptor_id"], ["pose_no"], buckets)


def ingest_offers(
    spark: SparkSession, path: str, target: str, checkpoint: str, multi_line: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """Packs of price responses; a newer response of a code replaces all its packs."""
    return ingest(stream_offers(spark, path, multi_line), target, checkpoint, ["code"], ["pack_no"], buckets)
