"""File formats, geometry, poses and sinks on data that Spark derives from the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.operators import assays, contacts, poses
from screenfunnel.queries.base import COMPACT, query, settle, spread, table
from screenfunnel.queries.library import OFFERS_SQL, best_offers
from screenfunnel.session import scratch_path
from screenfunnel.sources import files, sinks
from screenfunnel.sources import text_records as tr
from screenfunnel.streaming.ingest import ingest_offers

# --- texts and files --------------------------------------------------------------------------


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as an SDF record of p_size atoms: the first is O, the second H, the others C.

    Parts of the same name and brand share their catalogue id, so only the first one counts."""
    part = spread(table(spark, sf, "part"))
    symbol = lambda i: F.when(i == 1, "O").when(i == 2, "H").otherwise("C")
    atom = lambda i: F.concat(F.lit("    0.0000    0.0000    0.0000 "), symbol(i), F.lit("   0  0"))
    block = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.col("p_size")), atom))
    text = F.concat(
        F.lit("\n  made\n\n"), F.lpad(F.col("p_size").cast("string"), 3, " "), F.lit("  0  0  0  0  0            999 V2000\n"),
        block, F.lit("\nM  END\n>  <Mw>\n"), F.col("p_retailprice").cast("string"),
        F.lit("\n\n>  <Catalog_ID>\n"), F.col("p_name"), F.lit("/"), F.col("p_brand"),
        F.lit("\n\n>  <Class>  (1)\n"), F.col("p_type"), F.lit("\r\n\n"),
    )
    return part.select(F.col("p_partkey").alias("record_no"), text.alias("value"))


@query(
    "sdf_records",
    """WITH k AS (SELECT *, p_name || '/' || p_brand AS cid FROM part),
            f AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p_partkey) AS rn FROM k)
       SELECT 'A' || row_number() OVER (ORDER BY p_partkey) AS "ID", cid AS "Catalog_ID", CAST(p_retailprice AS VARCHAR) AS "Mw",
              p_type AS "Class", greatest(p_size - 2, 0) AS "CAtm", least(p_size, 1) AS "HetAtm",
              CASE WHEN p_size >= 2 THEN p_size - 1 ELSE p_size END AS "HvyAtm" FROM f WHERE rn = 1""",
)
def sdf_records(spark: SparkSession, sf: str) -> DataFrame:
    parsed = tr.parse_sdf(part_records(spark, sf), "value", ("Mw", "Catalog_ID", "Class", "URL"))
    return files.number_sdf(parsed, "A").select("ID", "Catalog_ID", "Mw", "Class", "CAtm", "HetAtm", "HvyAtm")


@query(
    "sdf_scan",
    """SELECT count(*) AS n_records, CAST(sum(CASE WHEN p_size >= 2 THEN p_size - 1 ELSE p_size END) AS BIGINT) AS n_heavy,
              count(DISTINCT p_type) AS n_classes, floor((sum(p_retailprice)) * 1e4 + 0.5001) / 1e4 AS total FROM part""",
)
def sdf_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Written as SDF text files and read back with the reader."""
    path = scratch_path(spark, "sdf")
    key = F.concat(F.lit(">  <Key>\n"), F.col("record_no").cast("string"), F.lit("\n\n>  <Class>"))
    records = part_records(spark, sf).select(F.regexp_replace("value", ">  <Class>", key).alias("value"))
    records.write.option("lineSep", "$$$$\n").text(path)
    found = files.scan_sdf(spark, path, "A", id_prop="Key", properties=("Mw", "Class"))
    return found.agg(
        F.count("*").alias("n_records"),
        F.sum("HvyAtm").alias("n_heavy"),
        F.count_distinct("Class").alias("n_classes"),
        settle(F.sum(F.col("Mw").cast("double")), 4).alias("total"),
    )


def offer_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as a price response with a good pack and one in an unknown unit."""
    li = table(spark, sf, "lineitem")
    unit = F.when(F.col("l_returnflag") == "A", "mg").when(F.col("l_returnflag") == "R", "kg").otherwise("g")
    code = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")])

    def pack(measure):
        weight = F.struct(F.col("l_quantity").alias("amount"), measure.alias("measure"))
        return F.struct(F.col("l_extendedprice").alias("price"), weight.alias("weight"))

    packs = F.array(pack(F.lit("ml")), pack(unit)).alias("all")
    entry = F.struct(
        F.struct(code.alias("code")).alias("product"), F.struct(F.struct(packs).alias("g")).alias("prices")
    )
    return li.select(F.array(entry).alias("results"))


RESPONSE_SQL = """
    SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_extendedprice AS code, 1 AS pack_no,
           floor((l_extendedprice / (CASE l_returnflag WHEN 'A' THEN l_quantity / 1000.0 WHEN 'R' THEN l_quantity * 1000.0
                                     ELSE l_quantity END)) * 1e4 + 0.5001) / 1e4 AS price_per_gram
    FROM lineitem
"""


def _offer_columns(df: DataFrame) -> DataFrame:
    return df.select("code", "pack_no", settle("price_per_gram", 4).alias("price_per_gram"))


@query("offers_scan", RESPONSE_SQL)
def offers_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "offers")
    offer_responses(spark, sf).write.json(path)
    return _offer_columns(files.scan_offers(spark, path, multi_line=False))


@query("offers_ingest", RESPONSE_SQL)
def offers_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same files picked up by a stream; the second run finds nothing new."""
    path, target, marks = (scratch_path(spark, n) for n in ("offers", "offers-table", "offers-marks"))
    offer_responses(spark, sf).write.options(**COMPACT).json(path)
    for _ in range(2):
        ingest_offers(spark, path, target, marks, multi_line=False).awaitTermination()
    return _offer_columns(spark.read.parquet(target))


@query(
    "assays_scan",
    """SELECT event_type AS target, count(*) AS n, floor((sum(value)) * 1e2 + 0.5001) / 1e2 AS total FROM events
       WHERE event_type IN ('click', 'view') AND value > 10 AND value <= 40 GROUP BY event_type""",
)
def assays_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as ``;`` exports, read back, filtered by target, then by unit and relation."""
    path = scratch_path(spark, "assays")
    v = F.col("value")
    exports = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("Molecule ChEMBL ID"),
        F.col("props").alias("Smiles"),
        F.lit("IC50").alias("Standard Type"),
        v.cast("string").alias("Standard Value"),
        F.when(v > 10, "nM").otherwise("ug.mL-1").alias("Standard Units"),
        F.when(v > 40, "<").otherwise(">=").alias("Standard Relation"),
        F.lit("cell-based format").alias("BAO Label"),
        F.col("event_type").alias("Target ChEMBL ID"),
    )
    exports.write.csv(path, sep=";", header=True)
    read = files.scan_assays(spark, path)
    wanted = assays.target_filter(read, ["click", "view"], "Target ChEMBL ID", "Standard Type", "Standard Value")
    rows = assays.assay_filter(wanted)
    return rows.groupBy(F.col("Target ChEMBL ID").alias("target")).agg(
        F.count("*").alias("n"), settle(F.sum("Standard Value"), 2).alias("total")
    )


# --- docking texts ----------------------------------------------------------------------------


def line_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as a docking log: two poses and an unreadable line; without a separator (and
    so without poses) for return flag N."""
    li = table(spark, sf, "lineitem")
    stem = F.concat_ws("_", F.concat(F.lit("L_"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_linenumber"), F.concat(F.lit("R"), "l_suppkey"))
    text = F.concat(
        F.lit("Some docking program\nmode |   affinity | dist from best mode\n"),
        F.when(F.col("l_returnflag") != "N", "-----+------------+----------+----------\n").otherwise(""),
        F.lit("   1   -"), F.col("l_quantity").cast("string"), F.lit("   0.0   0\n"),
        F.lit("   x   -1.0   0   0\n"),
        F.lit("   2 | "), F.col("l_extendedprice").cast("string"), F.lit(" | "), F.col("l_discount").cast("string"),
        F.lit("  "), F.col("l_tax").cast("string"), F.lit("\n\nWriting output ... done.\n"),
    )
    return li.select(stem.alias("stem"), text.alias("value"))


@query(
    "dock_log_poses",
    """WITH k AS (SELECT 'L_' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS ligand_id, 'R' || l_suppkey AS receptor_id, *
                  FROM lineitem WHERE l_returnflag <> 'N')
       SELECT ligand_id, receptor_id, 1 AS pose_no, 1 AS rank, -l_quantity AS score, 0.0::DOUBLE AS rmsd_lb, 0.0::DOUBLE AS rmsd_ub FROM k
       UNION ALL
       SELECT ligand_id, receptor_id, 2, 2, l_extendedprice, l_discount, l_tax FROM k""",
)
def dock_log_poses(spark: SparkSession, sf: str) -> DataFrame:
    return tr.parse_dock_logs(line_logs(spark, sf))


@query(
    "dock_log_summary",
    """SELECT 'L_' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS ligand_id, 'R' || l_suppkey AS receptor_id,
              CASE WHEN l_returnflag = 'N' THEN 0 ELSE 2 END AS n_poses FROM lineitem""",
)
def dock_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tr.log_summary(line_logs(spark, sf))


def coordinate(i, scale: float = 10.0):
    """Element ``i`` (from 0) of the embedding, as a coordinate."""
    return F.get("embedding", i if not isinstance(i, int) else F.lit(i)).cast("double") * F.lit(scale)


def pose_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as a pose file of two models of ten atoms; odd lines and a bad atom between."""
    e = table(spark, sf, "embeddings")

    def atom(i):
        at = (i - 1) * 3
        return F.format_string(
            "ATOM  %5d  C   UNL     1    %8.3f%8.3f%8.3f  1.00  0.00", i, coordinate(at), coordinate(at + 1), coordinate(at + 2)
        )

    def block(first: int, last: int):
        return F.concat_ws("\n", F.transform(F.sequence(F.lit(first), F.lit(last)), atom))

    text = F.concat(
        F.lit("MODEL 1\nREMARK VINA RESULT:    -9.362      0.000      0.000\nROOT\n"), block(1, 10),
        F.lit("\nATOM     99  C   UNL     1        none    none    none\nENDMDL\nMODEL 2\n"), block(11, 20), F.lit("\nENDMDL\n"),
    )
    stem = F.concat(F.lit("lig_"), "vec_id", F.lit("_6COX_out"))
    return e.select(stem.alias("stem"), text.alias("value"))


@query(
    "pose_atoms",
    """WITH i AS (SELECT unnest(range(1, 21)) AS i)
       SELECT 'lig_' || vec_id AS ligand_id, '6COX' AS receptor_id, CASE WHEN i <= 10 THEN 1 ELSE 2 END AS model,
              round(embedding[i * 3 - 2]::DOUBLE * 10, 3) AS x, round(embedding[i * 3 - 1]::DOUBLE * 10, 3) AS y,
              round(embedding[i * 3]::DOUBLE * 10, 3) AS z FROM embeddings, i""",
)
def pose_atoms(spark: SparkSession, sf: str) -> DataFrame:
    # Adding 0 turns a written "-0.000" into 0.
    xyz = [(F.col(c) + F.lit(0.0)).alias(c) for c in ("x", "y", "z")]
    return tr.parse_pose_atoms(pose_texts(spark, sf)).select("ligand_id", "receptor_id", "model", *xyz)


@query(
    "pose_files",
    """SELECT 'lig_' || vec_id AS ligand_id, '6COX' AS receptor_id, true AS has_marker,
              20 * 66 + 162 AS n_bytes FROM embeddings""",
)
def pose_files(spark: SparkSession, sf: str) -> DataFrame:
    return tr.pose_file_summary(pose_texts(spark, sf)).withColumn("n_bytes", F.col("n_bytes").cast("int"))


STRUCTURE_ATOMS = (
    ("ATOM  ", "NH1", "ARG", "A", 120), ("ATOM  ", "NH2", "ARG", "A", 120), ("ATOM  ", "OH", "TYR", "A", 355),
    ("ATOM  ", "CA", "ALA", "B", 7), ("HETATM", "C1", "S58", "A", 701), ("HETATM", "O", "HOH", "A", 801),
    ("ATOM  ", "CA", "MSE", "B", 8),
)


def structure_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as a small structure: a few residues, a ligand, water, a modified residue."""
    lines = [
        F.format_string(
            f"{record}{i:5d} {atom:<4s} {residue:>3s} {chain}{number:4d}    %8.3f%8.3f%8.3f  1.00",
            coordinate(i), coordinate(i + 10), coordinate(i + 20),
        )
        for i, (record, atom, residue, chain, number) in enumerate(STRUCTURE_ATOMS)
    ]
    text = F.concat_ws("\n", F.lit("HEADER    made"), *lines, F.lit("END"))
    return table(spark, sf, "embeddings").select(F.concat(F.lit("s"), "vec_id").alias("stem"), text.alias("value"))


@query(
    "structure_atoms",
    """WITH a(i, record, atom, residue, chain, resnum) AS (VALUES
         (0, 'ATOM', 'NH1', 'ARG', 'A', 120), (1, 'ATOM', 'NH2', 'ARG', 'A', 120), (2, 'ATOM', 'OH', 'TYR', 'A', 355),
         (3, 'ATOM', 'CA', 'ALA', 'B', 7), (4, 'HETATM', 'C1', 'S58', 'A', 701), (5, 'HETATM', 'O', 'HOH', 'A', 801),
         (6, 'ATOM', 'CA', 'MSE', 'B', 8))
       SELECT 's' || vec_id AS structure_id, record, atom, residue, chain, resnum,
              round(embedding[i + 1]::DOUBLE * 10, 3) AS x, round(embedding[i + 11]::DOUBLE * 10, 3) AS y,
              round(embedding[i + 21]::DOUBLE * 10, 3) AS z,
              CASE WHEN record = 'ATOM' AND residue IN ('ARG', 'TYR', 'ALA') THEN true ELSE false END AS is_protein
       FROM embeddings, a""",
)
def structure_atoms(spark: SparkSession, sf: str) -> DataFrame:
    atoms = tr.parse_structure_atoms(structure_texts(spark, sf))
    protein = tr.clean_structure(atoms).select("structure_id", "atom_no", F.lit(True).alias("is_protein"))
    xyz = [(F.col(c) + F.lit(0.0)).alias(c) for c in ("x", "y", "z")]
    return (
        atoms.join(protein, ["structure_id", "atom_no"], "left")
        .fillna(False, ["is_protein"])
        .select("structure_id", "record", "atom", "residue", "chain", "resnum", *xyz, "is_protein")
    )


@query(
    "nonstandard_residues",
    """SELECT 's' || vec_id AS structure_id, r AS residue_key FROM embeddings, (VALUES ('A:701'), ('B:8')) t(r)""",
)
def nonstandard_residues(spark: SparkSession, sf: str) -> DataFrame:
    return tr.nonstandard_residues(tr.parse_structure_atoms(structure_texts(spark, sf)))


# --- geometry ---------------------------------------------------------------------------------


def points(spark: SparkSession, sf: str, first: int, scale: float = 1.0) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[coordinate(first + i, scale).alias(c) for i, c in enumerate(("x", "y", "z"))])


POINTS_SQL = """
    a AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    b AS (SELECT label AS b_label, embedding[4]::DOUBLE AS b_x, embedding[5]::DOUBLE AS b_y, embedding[6]::DOUBLE AS b_z FROM embeddings)
"""


@query(
    "contacts",
    f"""WITH {POINTS_SQL},
    d AS (SELECT vec_id, label, sqrt((x - b_x) * (x - b_x) + (y - b_y) * (y - b_y) + (z - b_z) * (z - b_z)) AS d
          FROM a JOIN b ON label = b_label)
    SELECT vec_id, floor((min(d)) * 1e6 + 0.5001) / 1e6 AS nearest, count(*) AS n_close FROM d WHERE d < 0.1 GROUP BY vec_id""",
)
def contact_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = points(spark, sf, 3).select("label", *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "z")])
    found = contacts.nearest_within(points(spark, sf, 0), b, 0.1, ["label"], ["vec_id"], "vec_id")
    return found.select("vec_id", settle("nearest", 6).alias("nearest"), "n_close")


@query(
    "centroid",
    f"""WITH {POINTS_SQL} SELECT label, floor((avg(x)) * 1e6 + 0.5001) / 1e6 AS center_x, floor((avg(y)) * 1e6 + 0.5001) / 1e6 AS center_y, floor((avg(z)) * 1e6 + 0.5001) / 1e6 AS center_z,
    count(*) AS n_atoms FROM a GROUP BY label""",
)
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    found = contacts.centroid(points(spark, sf, 0), "label")
    return found.withColumns({f"center_{c}": settle(f"center_{c}", 6) for c in ("x", "y", "z")})


@query(
    "search_box",
    f"""WITH {POINTS_SQL},
    own AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a WHERE x > 0.3 GROUP BY label),
    g AS (SELECT DISTINCT label FROM a)
    SELECT g.label, CASE WHEN g.label = 2 THEN 1.5 ELSE round(coalesce(own.x, 73.0), 3) END AS center_x,
           CASE WHEN g.label = 2 THEN 2.5 ELSE round(coalesce(own.y, 52.0), 3) END AS center_y,
           CASE WHEN g.label = 2 THEN 3.5 ELSE round(coalesce(own.z, 28.0), 3) END AS center_z,
           CASE WHEN g.label = 2 THEN 22.0 ELSE 24.0 END::DOUBLE AS size_x, CASE WHEN g.label = 2 THEN 22.0 ELSE 24.0 END::DOUBLE AS size_y,
           CASE WHEN g.label = 2 THEN 22.0 ELSE 24.0 END::DOUBLE AS size_z
    FROM g LEFT JOIN own ON g.label = own.label""",
)
def search_box(spark: SparkSession, sf: str) -> DataFrame:
    atoms = points(spark, sf, 0)
    centres = contacts.ligand_centre(atoms, atoms, "label", F.col("x") > 0.3)
    fixed = spark.createDataFrame(
        [(2, 1.5, 2.5, 3.5, 22.0, 22.0, 22.0)],
        "label int, center_x double, center_y double, center_z double, size_x double, size_y double, size_z double",
    )
    return contacts.search_box(centres, "label", 24.0, fixed)


# Structure 1 is the reference. The others are its residues turned about z by a known angle and shifted; every third has a ligand
# of its own, every fifth too few residues.
SITE_SQL = """
    WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey = 1 THEN 1.0 WHEN c_custkey % 2 = 0 THEN 0.6 ELSE 0 END AS co,
      CASE WHEN c_custkey = 1 THEN 0 WHEN c_custkey % 2 = 0 THEN 0.8 ELSE 1 END AS si, CASE WHEN c_custkey = 1 THEN 0 ELSE c_nationkey END AS tx,
      CASE WHEN c_custkey = 1 THEN 0 ELSE c_custkey % 50 END AS ty, CASE WHEN c_custkey = 1 THEN 0 ELSE 3 END AS tz FROM customer),
    m AS (SELECT *, CASE WHEN k = 1 OR k % 3 = 0 THEN 'ligand' WHEN k % 5 = 1 THEN 'fallback' ELSE 'transferred' END AS source FROM s)
    SELECT 'S' || k AS structure_id, source,
      round(CASE WHEN k = 1 THEN 10 WHEN source = 'ligand' THEN k + 1 WHEN source = 'fallback' THEN 73
        ELSE co * (10 - tx) + si * (20 - ty) END, 3)::DOUBLE AS center_x,
      round(CASE WHEN k = 1 THEN 20 WHEN source = 'ligand' THEN k + 1 WHEN source = 'fallback' THEN 52
        ELSE co * (20 - ty) - si * (10 - tx) END, 3)::DOUBLE AS center_y,
      round(CASE WHEN k = 1 THEN 30 WHEN source = 'ligand' THEN 6 WHEN source = 'fallback' THEN 28 ELSE 30 - tz END, 3)::DOUBLE AS center_z,
      24.0::DOUBLE AS size_x, 24.0::DOUBLE AS size_y, 24.0::DOUBLE AS size_z FROM m
"""


def turned_structures(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("c_custkey"), F.col("i")
    first = k == 1
    co = F.when(first, 1.0).when(k % 2 == 0, 0.6).otherwise(0.0)
    si = F.when(first, 0.0).when(k % 2 == 0, 0.8).otherwise(1.0)
    at = [((i * step) % over).cast("double") for step, over in ((7, 11), (5, 13), (3, 17))]
    shift = [F.when(first, 0).otherwise(v) for v in (F.col("c_nationkey"), k % 50, F.lit(3))]
    rows = spread(table(spark, sf, "customer", "c_custkey", "c_nationkey")).withColumn("structure_id", F.concat(F.lit("S"), k))
    residues = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(~first & (k % 5 == 1), 2).otherwise(12)))).select(
        "structure_id", F.lit("ATOM").alias("record"), F.lit("CA").alias("atom"), F.lit("ALA").alias("residue"), F.lit("A").alias("chain"),
        (i + F.when(first, 100).otherwise(300)).alias("resnum"), i.alias("atom_no"), (co * at[0] - si * at[1] + shift[0]).alias("x"),
        (si * at[0] + co * at[1] + shift[1]).alias("y"), (at[2] + shift[2]).alias("z"),
    )
    ligands = rows.filter(first | (k % 3 == 0)).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "structure_id", F.lit("HETATM").alias("record"), F.lit("C1").alias("atom"), F.lit("LIG").alias("residue"), F.lit("A").alias("chain"),
        F.lit(900).alias("resnum"), (i + 13).alias("atom_no"), *[F.when(first, one + 2 * i - 1).otherwise(other).cast("double").alias(c)
        for c, one, other in (("x", 10, k + 2 * i), ("y", 20, k + 2 - 2 * i), ("z", 30, 5 + 2 * i))],
    )
    return residues.unionByName(ligands)


@query("site_boxes", SITE_SQL)
def site_boxes(spark: SparkSession, sf: str) -> DataFrame:
    atoms = turned_structures(spark, sf)
    residues = spark.range(1, 13).select((F.col("id") + 100).alias("ref_resnum"), (F.col("id") + 300).alias("mob_resnum"))
    path = scratch_path(spark, "sites")
    contacts.binding_sites(atoms, "structure_id", F.col("residue") == "LIG", "S1", residues).write.parquet(path)
    sites = spark.read.parquet(path)
    return contacts.search_box(sites, "structure_id").join(sites.select("structure_id", "source"), "structure_id")


@query(
    "geometric_score",
    """WITH n AS (SELECT unnest(range(1, 11)) AS i),
       a AS (SELECT vec_id, CASE WHEN label < 8 THEN '6COX' ELSE '3KK6' END AS receptor_id, i,
               embedding[i * 3 - 2]::DOUBLE * 20 AS x, embedding[i * 3 - 1]::DOUBLE * 20 AS y, embedding[i * 3]::DOUBLE * 20 AS z
             FROM embeddings, n),
       r AS (SELECT label, embedding[61]::DOUBLE * 60 AS bx, embedding[62]::DOUBLE * 60 AS bw, embedding[63]::DOUBLE * 60 AS bz
             FROM embeddings),
       d AS (SELECT vec_id, i, label, sqrt((x - bx) * (x - bx) + (y - bw) * (y - bw) + (z - bz) * (z - bz)) AS d
             FROM a, r WHERE receptor_id = '6COX'),
       per_atom AS (SELECT vec_id, i, max((label = 0)::INT) AS arg, max((label = 1)::INT) AS tyr, max((d < 2)::INT) AS clash
             FROM d WHERE d < 3.5 GROUP BY vec_id, i),
       c AS (SELECT vec_id, max(arg) AS arg, max(tyr) AS tyr, sum(clash) AS clashes FROM per_atom GROUP BY vec_id),
       m AS (SELECT vec_id, receptor_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM a GROUP BY ALL),
       p AS (SELECT a.vec_id, a.receptor_id,
               avg(CASE WHEN sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) < 5 THEN 1.0 ELSE 0.0 END) AS share
             FROM a JOIN m ON a.vec_id = m.vec_id GROUP BY ALL)
       SELECT CAST(p.vec_id AS VARCHAR) AS ligand_id, receptor_id, 1 AS model,
              CAST(CASE WHEN receptor_id <> '6COX' THEN 0 ELSE coalesce(arg, 0) * 2 + coalesce(tyr, 0) * 2
                + (share > 0.3)::INT + CASE WHEN coalesce(clashes, 0) = 0 THEN 1 WHEN clashes <= 2 THEN 0 ELSE -2 END END AS DOUBLE) AS geometric_score
       FROM p LEFT JOIN c ON p.vec_id = c.vec_id""",
)
def geometric_score(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    atoms = e.select(
        F.col("vec_id").cast("string").alias("ligand_id"),
        F.when(F.col("label") < 8, "6COX").otherwise("3KK6").alias("receptor_id"),
        F.lit(1).alias("model"),
        "embedding",
        F.explode(F.sequence(F.lit(1), F.lit(10))).alias("atom_no"),
    ).select(
        "ligand_id", "receptor_id", "model", "atom_no",
        *[coordinate((F.col("atom_no") - 1) * 3 + i, 20.0).alias(c) for i, c in enumerate(("x", "y", "z"))],
    )
    site = F.col("label")
    receptor = e.select(
        F.lit("6COX").alias("receptor_id"),
        F.when(site == 0, "NH1").when(site == 1, "OH").otherwise("CA").alias("atom"),
        F.when(site == 0, "ARG").when(site == 1, "TYR").otherwise("ALA").alias("residue"),
        F.when(site == 0, 120).when(site == 1, 355).otherwise(1).alias("resnum"),
        *[coordinate(60 + i, 60.0).alias(c) for i, c in enumerate(("x", "y", "z"))],
    )
    return contacts.geometric_score(atoms, receptor, poses.RECEPTOR_LABELS)


@query("superpose")
def superpose(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding's first ten points onto its last ten, with the fitted position of the first."""
    at = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")
    pairs = table(spark, sf, "embeddings").select("vec_id", "embedding", at).select(
        "vec_id",
        *[coordinate(F.col("i") * 3 + j).alias(f"mob_{c}") for j, c in enumerate(("x", "y", "z"))],
        *[coordinate(F.col("i") * 3 + 30 + j).alias(f"ref_{c}") for j, c in enumerate(("x", "y", "z"))],
    )
    return contacts.superpose(pairs, "vec_id", check=False)


# --- poses ------------------------------------------------------------------------------------


def line_poses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_partkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("pose_no"),
    )


CAPPED_SQL = """
    c AS (SELECT * FROM (SELECT *, l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS pose_no,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT) AS rn FROM lineitem) WHERE rn <= 3)
"""


@query("cap_poses", f"WITH {CAPPED_SQL} SELECT l_orderkey, pose_no, l_quantity FROM c")
def cap_poses(spark: SparkSession, sf: str) -> DataFrame:
    return poses.cap_poses(line_poses(spark, sf), ["l_orderkey"], "pose_no", 3).select("l_orderkey", "pose_no", "l_quantity")


@query(
    "pose_spread",
    f"""WITH {CAPPED_SQL}
    SELECT l_orderkey, round(CASE WHEN count(*) >= 2 THEN greatest(max(l_quantity) - min(l_quantity), max(l_tax * 1000) - min(l_discount * 100))
                             ELSE 0 END, 3) AS pose_spread FROM c GROUP BY l_orderkey""",
)
def pose_spread(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_poses(spark, sf).withColumns({"low": F.col("l_discount") * 100, "high": F.col("l_tax") * 1000})
    return poses.pose_spread(lines, ["l_orderkey"], "pose_no", "l_quantity", "low", "high")


@query(
    "best_score",
    """SELECT l_orderkey, round(arg_min(l_extendedprice, l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT), 2) AS docking_score
       FROM lineitem GROUP BY l_orderkey""",
)
def best_score(spark: SparkSession, sf: str) -> DataFrame:
    return poses.best_score(line_poses(spark, sf), ["l_orderkey"], "pose_no", "l_extendedprice")


@query(
    "best_pose",
    """SELECT l_orderkey, pose_no, l_quantity, l_extendedprice FROM (
         SELECT *, l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS pose_no,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def best_pose(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_poses(spark, sf).select("l_orderkey", "pose_no", "l_quantity", "l_extendedprice")
    return poses.best_pose(lines, ["l_orderkey"], "l_quantity", "pose_no")


@query(
    "pivot_scores",
    """SELECT l_suppkey, min(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS score_a,
              min(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS score_n,
              min(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS score_r FROM lineitem GROUP BY l_suppkey""",
)
def pivot_scores(spark: SparkSession, sf: str) -> DataFrame:
    return poses.pivot_scores(line_poses(spark, sf), "l_suppkey", "l_returnflag", "l_extendedprice", ("A", "N", "R"))


@query(
    "docking_analysis",
    """SELECT CAST(l_suppkey AS VARCHAR) AS ligand_id, min(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS score_cox2,
              min(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS score_cox1,
              max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS instability_cox2,
              max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS instability_cox1,
              greatest(max(l_quantity) FILTER (WHERE l_returnflag = 'A'), max(l_quantity) FILTER (WHERE l_returnflag = 'R')) AS instability
       FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_suppkey""",
)
def docking_analysis(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_poses(spark, sf).filter("l_returnflag <> 'N'").select(
        F.col("l_suppkey").cast("string").alias("ligand_id"),
        F.when(F.col("l_returnflag") == "A", "6COX").otherwise("3KK6").alias("receptor_id"),
        F.col("l_extendedprice").alias("docking_score"),
        F.col("l_quantity").alias("pose_spread"),
    )
    labelled = poses.with_label(lines)
    return poses.docking_analysis(labelled, labelled)


FINAL_SQL = """
    b AS (SELECT CAST(l_partkey AS VARCHAR) AS ligand_id, min(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS score_cox2,
            min(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS score_cox1,
            max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS geo_score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey),
    t AS (SELECT b.*, p_retailprice AS "QSAR_score" FROM b LEFT JOIN part ON ligand_id = CAST(p_partkey AS VARCHAR))
"""


def _norm(column: str, invert: bool) -> str:
    from screenfunnel.queries.ranking import norm_sql

    return norm_sql(column, invert)


@query(
    "final_ranking",
    f"""WITH {FINAL_SQL},
    n AS (SELECT *, {_norm('"QSAR_score"', True)} AS q, {_norm("geo_score", False)} AS g, {_norm("score_cox2", True)} AS v FROM t)
    SELECT ligand_id, score_cox2, score_cox1, geo_score, floor((q) * 1e6 + 0.5001) / 1e6 AS qsar_norm, floor((g) * 1e6 + 0.5001) / 1e6 AS geo_norm, floor((v) * 1e6 + 0.5001) / 1e6 AS vina_norm,
           round(0.5 * q + 0.4 * g + 0.1 * v, 4) AS final_score FROM n""",
)
def final_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from screenfunnel.plans.grading import final_ranking as rank

    best = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag <> 'N'")
        .groupBy(
            F.col("l_partkey").cast("string").alias("ligand_id"),
            F.when(F.col("l_returnflag") == "A", "COX2").otherwise("COX1").alias("cox_label"),
        )
        .agg(F.min("l_extendedprice").alias("docking_score"), F.max("l_quantity").alias("geometric_score"))
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ID"), F.col("p_retailprice").alias("QSAR_score"))
    ranked = rank(best, part)
    return ranked.select(
        "ligand_id", "score_cox2", "score_cox1", "geo_score",
        *[settle(c, 6).alias(c) for c in ("qsar_norm", "geo_norm", "vina_norm")], "final_score",
    )


# --- sinks ------------------------------------------------------------------------------------


@query(
    "write_split",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'rejected' ELSE 'accepted' END AS decision FROM supplier""",
)
def write_split(spark: SparkSession, sf: str) -> DataFrame:
    """Stored with its parameters, then read from the store without computing again."""
    path = scratch_path(spark, "split")
    supplier = table(spark, sf, "supplier")

    def compute():
        return supplier.filter("s_acctbal <= 5000"), supplier.filter("s_acctbal > 5000")

    for _ in range(2):
        accepted, rejected = sinks.materialise_split(spark, path, {"cap": 5000}, compute)
    return (
        accepted.select("s_suppkey", F.lit("accepted").alias("decision"))
        .unionByName(rejected.select("s_suppkey", F.lit("rejected").alias("decision")))
    )


@query(
    "rescores_scan",
    """SELECT 'X' || l_orderkey || '_' || l_linenumber AS complex_id, -l_quantity AS "delta_G_bind_kcal_mol",
              CASE WHEN l_discount >= 0.02 THEN l_discount END AS "std_kcal_mol" FROM lineitem WHERE l_returnflag = 'R' AND l_tax < 0.08""",
)
def rescores_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rescores saved as CSV, gathered under the names of result files, and read back; words in place of numbers drop out."""
    saved, found = scratch_path(spark, "rescores"), scratch_path(spark, "results")
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("X"), "l_orderkey", F.lit("_"), "l_linenumber").alias("complex_id"),
        F.when(F.col("l_tax") < 0.08, (-F.col("l_quantity")).cast("string")).otherwise("failed").alias("delta_G_bind_kcal_mol"),
        F.when(F.col("l_discount") >= 0.02, F.col("l_discount").cast("string")).alias("std_kcal_mol"),
    )
    sinks.save_rescores(lines, saved)
    # the parts of the export as result files of their own
    texts = spark.read.text(saved, wholetext=True, pathGlobFilter="*.csv").select("value", F.md5(F.input_file_name()).alias("name"))
    texts.select(F.regexp_replace("value", r"\n$", "").alias("value"), F.concat("name", F.lit("_mmgbsa.csv")).alias("name")).write.partitionBy("name").text(found)
    rows = files.rescore_rows(
        spark.read.text(found, wholetext=True).select(F.regexp_replace("name", r"\.csv$", "").alias("stem"), "value")
    )
    return rows


@query(
    "candidates_saved",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_totalprice > 300000",
)
def candidates_saved(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "candidates")
    ids = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("ligand_id")).distinct()
    sinks.save_candidates(ids, path)
    return spark.read.text(path)


@query(
    "assay_summary_scan",
    """SELECT CAST(l_partkey AS VARCHAR) AS "ChEMBL_ID", CAST(count(*) AS VARCHAR) AS "IC50_COX1_median",
              CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS "IC50_COX2_median" FROM lineitem GROUP BY l_partkey""",
)
def assay_summary_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A ``;`` table with blanks around its column names."""
    path = scratch_path(spark, "summary")
    table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias(" ChEMBL_ID")).agg(
        F.count("*").alias("IC50_COX1_median "), F.max("l_quantity").cast("long").alias(" IC50_COX2_median ")
    ).write.csv(path, sep=";", header=True)
    return files.scan_assay_summary(spark, path)


@query(
    "cluster_bundle",
    """SELECT 'clustered' AS part, count(*) AS n, floor(sum(s_acctbal) * 1e2 + 0.5001) / 1e2 AS total FROM supplier
       UNION ALL SELECT 'representatives', count(*), floor(sum(s_acctbal) * 1e2 + 0.5001) / 1e2 FROM supplier WHERE s_suppkey % 5 = 0
       UNION ALL SELECT 'samples', count(*), floor(sum(s_acctbal) * 1e2 + 0.5001) / 1e2 FROM supplier WHERE s_suppkey % 5 = 0
       UNION ALL SELECT 'shortlist', count(*), floor(sum(s_acctbal) * 1e2 + 0.5001) / 1e2 FROM supplier WHERE s_suppkey % 2 = 0
       UNION ALL SELECT 'summary', count(*), floor(sum(t) * 1e2 + 0.5001) / 1e2 FROM (SELECT sum(s_acctbal) AS t FROM supplier GROUP BY s_nationkey)
       UNION ALL SELECT 'metadata', count(*), count(DISTINCT s_nationkey)::DOUBLE FROM supplier""",
)
def cluster_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Each table of the bundle read back; the samples lack the helper columns, the metadata holds rows and clusters."""
    path = scratch_path(spark, "bundle")
    rows = table(spark, sf, "supplier", "s_suppkey", "s_acctbal", F.col("s_nationkey").alias("Cluster")).withColumn("PC1", F.lit(0.5))
    chosen = rows.filter("s_suppkey % 5 = 0")
    summary = rows.groupBy("Cluster").agg(F.sum("s_acctbal").alias("s_acctbal"))
    content = sinks.write_cluster_bundle(path, "series", rows, chosen, rows.filter("s_suppkey % 2 = 0"), summary)
    parts = [
        spark.read.parquet(f"{path}/{folder}/data").agg(F.count("*").alias("n"), settle(F.sum("s_acctbal"), 2).alias("total")).select(F.lit(part).alias("part"), "n", "total")
        for part, folder in content["outputs"].items()
    ]
    if set(spark.read.parquet(f"{path}/{content['outputs']['samples']}/data").columns) & {"Cluster", "PC1"}:
        raise ValueError("the samples hold helper columns")
    stored = sinks.read_manifest(spark, f"{path}/series/metadata")
    parts.append(spark.createDataFrame([("metadata", stored["n_rows"], float(stored["n_clusters"]))], "part string, n long, total double"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "write_by_key",
    "SELECT event_type AS target, count(*) AS n, floor((sum(value)) * 1e2 + 0.5001) / 1e2 AS total FROM events GROUP BY event_type",
)
def write_by_key(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "by-key")
    sinks.write_by_key(table(spark, sf, "events", "event_id", "event_type", "value"), "event_type", path)
    back = spark.read.csv(path, sep=";", header=True)
    return back.groupBy(F.col("_part").alias("target")).agg(
        F.count("*").alias("n"), settle(F.sum(F.col("value").cast("double")), 2).alias("total")
    )


@query(
    "write_counted",
    """SELECT p_partkey AS part, p_retailprice AS price FROM part""",
)
def write_counted(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "counted")
    sinks.write_counted(
        table(spark, sf, "part"), path, ["p_partkey", "p_retailprice"], {"p_partkey": "part", "p_retailprice": "price"}
    )
    return files.scan_products(spark, path)


@query(
    "export_ranked",
    """SELECT count(*) AS n_poses, count(DISTINCT l_orderkey) AS n_ranked FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""",
)
def export_ranked(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "export")
    ranked = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("ligand_id"), "o_totalprice")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "ligand_id")
    sinks.export_ranked(ranked, lines, path)
    return spark.read.parquet(f"{path}/poses").agg(
        F.count("*").alias("n_poses"), F.count_distinct("ligand_id").alias("n_ranked")
    )


@query(
    "union_series",
    """SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def union_series(spark: SparkSession, sf: str) -> DataFrame:
    """Two series written as CSV and loaded as one table."""
    path = scratch_path(spark, "series")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.csv(f"{path}/a", header=True)
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    ).write.csv(f"{path}/b", header=True)
    loaded = files.load_ligands(spark, [f"{path}/a", f"{path}/b"])
    return loaded.select(F.col("id").cast("long").alias("id"), "name", "segment")


@query("materialise", f"WITH {OFFERS_SQL} SELECT code, floor((price) * 1e2 + 0.5001) / 1e2 AS price FROM best")
def materialise(spark: SparkSession, sf: str) -> DataFrame:
    """A stage kept as a table and read back."""
    path = scratch_path(spark, "stage")
    for _ in range(2):
        kept = sinks.materialise(spark, path, {"stage": "offers"}, lambda: best_offers(spark, sf))
    return kept.select("code", settle("price", 2).alias("price"))
