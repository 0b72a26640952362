"""Writers. Counts go to a small manifest next to the data, taken while writing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from screenfunnel.functions.scalars import keep_existing


#: Manifest of a stage whose data is being replaced; it matches no parameters.
UNFINISHED = {"params_hash": None}


def params_hash(params: dict[str, Any]) -> str:
    text = json.dumps(params, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    """A one-row JSON file on the same file system as the data."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(row.value) if row else None


def write_split(accepted: DataFrame, rejected: DataFrame, path: str, fmt: str = "parquet") -> dict[str, int]:
    """Both sides of a filter as one table partitioned by ``decision``; returns the row counts."""
    seen = Observation()
    both = accepted.withColumn("decision", F.lit("accepted")).unionByName(
        rejected.withColumn("decision", F.lit("rejected")), allowMissingColumns=True
    )
    counted = both.observe(
        seen,
        F.count_if(F.col("decision") == "accepted").alias("accepted"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"),
    )
    counted.write.mode("overwrite").partitionBy("decision").format(fmt).save(path)
    return {k: int(v) for k, v in seen.get.items()}


def read_split(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    df = spark.read.format(fmt).load(path)
    return (
        df.filter(F.col("decision") == "accepted").drop("decision"),
        df.filter(F.col("decision") == "rejected").drop("decision"),
    )


def write_decided(df: DataFrame, path: str, decisions: Sequence[str], column: str = "decision", fmt: str = "parquet") -> dict[str, int]:
    """A table with a decision per row, written once, one folder per decision; returns the rows of each of ``decisions``.

    The decision and all it depends on are evaluated once; a side is a read of its folder. Counts come with the write.
    """
    seen = Observation()
    counts = [F.count_if(F.col(column) == d).alias(d) for d in decisions]
    df.observe(seen, *counts).write.mode("overwrite").partitionBy(column).format(fmt).save(path)
    return {k: int(v) for k, v in seen.get.items()}


def materialise(
    spark: SparkSession,
    path: str,
    params: dict[str, Any],
    compute: Callable[[], DataFrame],
    force: bool = False,
    watch: Observation | None = None,
) -> DataFrame:
    """A stage's stored output if it was made with the same parameters, else made and stored now.

    The manifest is voided before the data is overwritten and written last, so a stage that was cut
    off is made again; reading the stored table also cuts the lineage. The parameter hash is kept
    on a forced run too. ``watch`` is an observation that ``compute`` takes on the way; its counts stand in the manifest.
    """
    wanted = params_hash(params)
    found = None if force else read_manifest(spark, f"{path}/manifest")
    if found is None or found.get("params_hash") != wanted:
        write_manifest(spark, f"{path}/manifest", UNFINISHED)
        seen = Observation()
        compute().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/data")
        counts = {k: int(v) for k, v in watch.get.items()} if watch is not None else {}
        write_manifest(spark, f"{path}/manifest", {"params_hash": wanted, "rows": int(seen.get["rows"]), **counts})
    return spark.read.parquet(f"{path}/data")


def materialise_decided(
    spark: SparkSession, path: str, params: dict[str, Any], compute: Callable[[], DataFrame], decisions: Sequence[str]
) -> DataFrame:
    """The same for a decided table, by :func:`write_decided`; the rows of each decision stand in the manifest, and the
    columns too, since a table without rows has no file to tell them."""
    wanted = params_hash(params)
    found = read_manifest(spark, f"{path}/manifest")
    if found is None or found.get("params_hash") != wanted:
        write_manifest(spark, f"{path}/manifest", UNFINISHED)
        made = compute()
        counts = write_decided(made, f"{path}/data", decisions)
        found = {"params_hash": wanted, "schema": made.schema.json(), **counts}
        write_manifest(spark, f"{path}/manifest", found)
    return spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(f"{path}/data")


def stage_counts(spark: SparkSession, store: str, stages: Sequence[str]) -> DataFrame:
    """stage, counter, n: what the manifests of stored stages have counted on their way; stages without one are left out."""
    found = {stage: read_manifest(spark, f"{store}/{stage}/manifest") or {} for stage in stages}
    rows = [(stage, k, v) for stage, counts in found.items() for k, v in counts.items() if isinstance(v, int)]
    return spark.createDataFrame(rows, "stage string, counter string, n long")


def materialise_split(
    spark: SparkSession,
    path: str,
    params: dict[str, Any],
    compute: Callable[[], tuple[DataFrame, DataFrame]],
    rows_in: int | None = None,
    force: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The same for a filter; a stored pair is only reused if accepted + rejected = ``rows_in``."""
    wanted = params_hash(params)
    found = None if force else read_manifest(spark, f"{path}/manifest")
    usable = (
        found is not None
        and found.get("params_hash") == wanted
        and (rows_in is None or found["accepted"] + found["rejected"] == rows_in)
    )
    if not usable:
        write_manifest(spark, f"{path}/manifest", UNFINISHED)
        counts = write_split(*compute(), f"{path}/data")
        write_manifest(spark, f"{path}/manifest", {"params_hash": wanted, **counts})
    return read_split(spark, f"{path}/data")


def write_by_key(df: DataFrame, key: str, path: str, sep: str = ";") -> None:
    """One folder of ``;`` CSV files per key value, each with a header."""
    df.withColumn("_part", F.col(key)).write.mode("overwrite").partitionBy("_part").csv(path, sep=sep, header=True)


def write_counted(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    rename: dict[str, str] | None = None,
    fmt: str = "parquet",
) -> int:
    """Select, rename and write; the row count goes to the manifest and is returned."""
    out = df.select(*columns) if columns is not None else df
    out = out.withColumnsRenamed(rename) if rename else out
    seen = Observation()
    writer = out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer.csv(f"{path}/data", header=True)
    else:
        writer.format(fmt).save(f"{path}/data")
    rows = int(seen.get["rows"])
    write_manifest(df.sparkSession, f"{path}/manifest", {"rows": rows, "columns": out.columns})
    return rows


# The columns of a clustering run that the samples table leaves out.
HELPER_COLUMNS = ("ALMOS_ID", "Cluster", "Point selected", "PC1", "PC2", "PC3", "RepresentativeRule")


def write_cluster_bundle(
    path: str,
    name: str,
    clustered: DataFrame,
    representatives: DataFrame,
    shortlist: DataFrame,
    summary: DataFrame,
    group: str = "Cluster",
    top_n: int = 3,
    metadata: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """clustered, representatives, samples (without helper columns), shortlist, summary, metadata."""
    spark = clustered.sparkSession
    samples = keep_existing(representatives, [c for c in representatives.columns if c not in (*HELPER_COLUMNS, group)])
    tables = {
        "clustered": clustered,
        "representatives": representatives,
        "samples": samples,
        "shortlist": shortlist,
        "summary": summary,
    }
    rows = {k: write_counted(df, f"{path}/{name}/{k}") for k, df in tables.items()}
    content = {
        **(metadata or {}),
        "series_name": name,
        "cluster_col": group,
        "n_rows": rows["clustered"],
        "n_clusters": clustered.agg(F.count_distinct(F.col(group))).first()[0],
        "top_n": top_n,
        "outputs": {k: f"{name}/{k}" for k in tables},
    }
    write_manifest(spark, f"{path}/{name}/metadata", content)
    return content


def export_ranked(ranked: DataFrame, poses: DataFrame, path: str, key: str = "ligand_id") -> None:
    """The ranked table as CSV and the pose rows of the ranked ligands."""
    ranked.write.mode("overwrite").csv(f"{path}/docking_scores", header=True)
    poses.join(ranked.select(key).distinct(), key, "left_semi").write.mode("overwrite").parquet(f"{path}/poses")


def save_rescores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_candidates(ids: DataFrame, path: str, id_col: str = "ligand_id") -> None:
    """One id per line."""
    ids.select(F.col(id_col).cast("string")).write.mode("overwrite").text(path)
