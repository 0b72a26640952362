"""Readers: files in, DataFrames out."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenfunnel.operators.order import prefix_ids
from screenfunnel.sources import text_records as tr


def texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One row per file: ``stem`` (name without extension) and the whole text as ``value``."""
    # wholetext must be an argument of text(): as an option it is reset by it.
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"), "value")


def scan_sdf(
    spark: SparkSession,
    path: str,
    prefix: str,
    id_prop: str = "Catalog_ID",
    properties: Sequence[str] = tr.SDF_PROPERTIES,
) -> DataFrame:
    """Building blocks of an SDF: ID (prefix and number in record order), the properties, the mol
    block and atom counts. Records that do not parse or lack the id are skipped, the first record
    of an id counts, in order of file names and places; no record left is an error. Files are split
    between tasks at record ends; lines may end with or without a carriage return."""
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    raw = spark.read.text(path, lineSep="$$$$").select("value", block.alias("_block"), F.monotonically_increasing_id().alias("_row"))
    # Blocks are read in any order; their ranks and the places inside them give the record numbers.
    ranks = raw.select("_block").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_block")))
    numbered = raw.join(ranks, "_block").withColumn(
        "record_no", F.col("_rank").cast("long") * (1 << 33) + F.col("_row") % (1 << 33)
    )
    # The rest of the last record's end line is dropped; the title line of a record may be empty, and
    # then only the place of the counts line tells the two apart.
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"^\n(?=(?:[^\n]*\n){3}[^\n]*V[23]000)", "")
    records = numbered.select(text.alias("value"), "record_no")
    return number_sdf(tr.parse_sdf(records, "value", tuple(dict.fromkeys([*properties, id_prop]))), prefix, id_prop)


def number_sdf(parsed: DataFrame, prefix: str, id_prop: str = "Catalog_ID", order: str = "record_no") -> DataFrame:
    """First record per id, numbered ``A1, A2 …`` in record order."""
    if not re.fullmatch("[A-Za-z]+", prefix):
        raise ValueError("the prefix must be letters only, such as 'A'")
    named = parsed.drop("ID").filter(F.col(id_prop).isNotNull())
    if named.limit(1).isEmpty():
        raise ValueError("no usable record found")
    # Only ids and record numbers are grouped; the texts are joined back by record number.
    first = named.groupBy(id_prop).agg(F.min(order).alias(order)).select(order)
    return named.join(prefix_ids(first, order, prefix), order).select("ID", *named.drop(order).columns)


def scan_offers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Packs of all price responses below a path (one JSON document per file, or one per line)."""
    return tr.explode_offers(spark.read.schema(tr.OFFER_SCHEMA).option("multiLine", multi_line).json(path))


#: Files with a header of their own whose paths are broadcast at most (about 20 MB); beyond, lines are joined to them by a shuffle.
SENT_FILES = 100_000


def scan_assays(spark: SparkSession, path: str) -> DataFrame:
    """All ``;`` CSV files of a folder as text columns with trimmed names, in the order of the files that have them first.

    A file without a header line takes the header of the first file that has one; of several headers in a file the first counts.
    Headers are found and given to the lines in the executors: the driver gets one row per distinct header, and no paths.
    """
    raw = spark.read.option("pathGlobFilter", "*.csv").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    lines = raw.select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at"))
    is_header = F.col("value").contains("Target ChEMBL ID") & F.col("value").contains("Standard Type")
    heads = lines.filter(is_header).groupBy("_file").agg(F.min_by("value", "_at").alias("head"))
    bare = lambda x: F.regexp_replace(x, r'^[\s"]+|[\s"]+$', "")
    heads = heads.select("_file", F.transform(F.split("head", ";"), bare).alias("names"))
    kinds = heads.groupBy("names").agg(F.min("_file").alias("first"), F.count("*").alias("n_files")).orderBy("first").collect()
    if not kinds:
        raise ValueError(f"no header line found in {path}")
    if len(kinds) == 1:
        names = kinds[0].names
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = spark.read.option("pathGlobFilter", "*.csv").csv(path, sep=";", schema=schema, header=False)
        first = F.col(f"`{names[0]}`")
        return rows.filter(first.isNull() | (F.trim(first) != names[0]))
    # A line is cut into cells as the CSV reader does it, and each column finds its cell by the file's header.
    cells = ", ".join(f"c{i} string" for i in range(max(len(k.names) for k in kinds)))
    known = F.broadcast(heads) if sum(k.n_files for k in kinds) <= SENT_FILES else heads
    cut = (
        lines.filter(F.trim("value") != "")
        .join(known, "_file", "left")
        .withColumn("names", F.coalesce("names", F.array(*map(F.lit, kinds[0].names))))
        .withColumn("cells", F.from_csv("value", F.lit(cells), {"sep": ";"}))
        .withColumn("cells", F.array("cells.*"))
    )
    first = F.get("cells", F.lit(0))
    cut = cut.filter(first.isNull() | (F.trim(first) != F.get("names", F.lit(0))))
    columns = dict.fromkeys(n for k in kinds for n in k.names)
    place = lambda n: F.array_position("names", n).cast("int")
    return cut.select(*[F.when(place(n) > 0, F.get("cells", place(n) - 1)).alias(n) for n in columns])


def scan_assay_summary(spark: SparkSession, path: str) -> DataFrame:
    """A ``;`` CSV with trimmed column names, all text."""
    df = spark.read.csv(path, sep=";", header=True)
    return df.toDF(*[c.strip() for c in df.columns])


def scan_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A product table written by :func:`screenfunnel.sources.sinks.write_counted`; a row count that
    differs from its manifest is warned about."""
    from screenfunnel.sources.sinks import read_manifest

    data = f"{path}/data"
    df = spark.read.csv(data, header=True) if fmt == "csv" else spark.read.format(fmt).load(data)
    manifest = read_manifest(spark, f"{path}/manifest")
    if manifest is not None:
        found = df.count()
        if found != manifest["rows"]:
            warnings.warn(f"{path}: the manifest says {manifest['rows']:,} rows, found {found:,}", stacklevel=2)
    return df


def load_ligands(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several ligand CSVs with headers, as one table."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [spark.read.csv(p, header=True) for p in paths],
    )


def scan_dock_logs(spark: SparkSession, path: str) -> DataFrame:
    return tr.parse_dock_logs(texts(spark, path, "*.log"))


def scan_log_summary(spark: SparkSession, path: str) -> DataFrame:
    return tr.log_summary(texts(spark, path, "*.log"))


def scan_pose_files(spark: SparkSession, path: str) -> DataFrame:
    return tr.pose_file_summary(texts(spark, path, "*.pdbqt"))


def scan_pose_atoms(spark: SparkSession, path: str) -> DataFrame:
    return tr.parse_pose_atoms(texts(spark, path, "*.pdbqt"))


def scan_structure_atoms(spark: SparkSession, path: str) -> DataFrame:
    return tr.parse_structure_atoms(texts(spark, path, "*.pdb"))


def scan_rescores(spark: SparkSession, path: str) -> DataFrame:
    """complex_id, delta_G_bind_kcal_mol and std_kcal_mol of all ``*_mmgbsa.csv``.

    Every file is read by its own header; a file without complex_id is named after the file, rows
    with a value that is no number are left out.
    """
    return rescore_rows(texts(spark, path, "*_mmgbsa.csv"))


def rescore_rows(files: DataFrame) -> DataFrame:
    """:func:`scan_rescores` of file texts: stem (the name without its ending) and value."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")

    def parts(held):
        names = F.transform(F.split(F.get(held, F.lit(0)), ","), lambda x: F.trim(x))
        return F.struct(names.alias("names"), F.slice(held, 2, F.size(held)).alias("rest"))

    # Two generators: the text is cut once per file, not again for each of its lines.
    heads = files.select("stem", F.inline(F.transform(F.array(lines), parts)))
    rows = heads.select("stem", "names", F.explode("rest").alias("line")).withColumn("cells", F.split("line", ","))

    def cell(name: str):
        at = F.array_position("names", name)
        return F.when(at > 0, F.get("cells", at.cast("int") - 1))

    own = F.regexp_replace("stem", "_mmgbsa$", "")
    value = {c: cell(c) for c in ("delta_G_bind_kcal_mol", "std_kcal_mol")}
    readable = [v.isNull() | (F.trim(v) == "") | v.try_cast("double").isNotNull() for v in value.values()]
    return rows.filter(readable[0] & readable[1]).select(
        F.coalesce(cell("complex_id"), own).alias("complex_id"), *[v.try_cast("double").alias(c) for c, v in value.items()]
    )


def scan_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """An alert catalogue CSV: tier, ord, family, name, pattern."""
    schema = "tier int, ord int, family string, name string, pattern string"
    return spark.read.csv(path, header=True, schema=schema, escape='"')
