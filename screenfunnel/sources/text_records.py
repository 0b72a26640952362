"""Parsers of the text formats. Each takes a DataFrame of texts, so any source of text can feed it,
and cuts records and lines apart with array functions: no window, no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import price_per_gram, stem_parts

# The 20 standard residues and the names of water.
STANDARD_RESIDUES = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY",
    "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER",
    "THR", "TRP", "TYR", "VAL",
)
WATER = ("HOH", "WAT")
# The properties of a building-block record.
SDF_PROPERTIES = ("Mw", "Catalog_ID", "IUPAC Name", "URL", "Stock_weight_G", "Class", "Subclass")

OFFER_SCHEMA = (
    "results array<struct<product: struct<code: string>, prices: struct<g: struct<all: "
    "array<struct<price: double, weight: struct<amount: double, measure: string>>>>>>>"
)


def _lines(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\r?\n")


def sdf_property(text: str, name: str) -> Column:
    """The line after ``>  <name>``; null when the record has no such property."""
    found = F.regexp_extract(F.col(text), rf"(?m)^>[^\n]*<{name}>[^\n]*\n([^\r\n]*)", 1)
    has = F.col(text).rlike(rf"(?m)^>[^\n]*<{name}>")
    return F.when(has, found)


# An atom line of a mol block: three coordinates and the symbol, or the newer numbered form.
_ATOM_LINE = r"(?m)^(?:(?:[ \t]*-?\d+\.\d+){3}|M  V30 \d+) %s(?![A-Za-z])"


def parse_sdf(records: DataFrame, text: str = "value", properties: Sequence[str] = SDF_PROPERTIES) -> DataFrame:
    """Mol block, atom counts and properties per record. Records are dropped if their fourth line
    is no counts line, or announces another number of atoms than there are.

    CAtm, HetAtm (neither C nor H), HvyAtm and Atoms (explicit hydrogens not counted).
    """
    block = F.regexp_extract(F.col(text), r"(?s)^(.*?\nM  END)", 1)
    counts = F.regexp_extract(F.col(text), r"^[^\n]*\n[^\n]*\n[^\n]*\n([^\n]*V[23]000)", 1)
    # The generator keeps the optimiser from evaluating the block once per use.
    rows = records.filter(F.col(text).contains("M  END")).select("*", F.explode(F.array(block)).alias("mol_block"))

    def tally(symbol: str) -> Column:
        return F.regexp_count("mol_block", F.lit(_ATOM_LINE % symbol))

    rows = rows.withColumns(
        {"_counts": counts, "_all": tally("[A-Za-z*#]+"), "_c": tally("C"), "_h": tally("H")}
    )
    announced = F.trim(F.substring("_counts", 1, 3)).try_cast("int")
    parsed = F.col("_counts").contains("V3000") | (announced == F.col("_all"))
    heavy = F.col("_all") - F.col("_h")
    return rows.filter((F.col("_counts") != "") & F.coalesce(parsed, F.lit(False))).select(
        *[c for c in records.columns if c != text],
        *[sdf_property(text, p).alias(p) for p in properties],
        "mol_block",
        F.col("_c").alias("CAtm"),
        (heavy - F.col("_c")).alias("HetAtm"),
        heavy.alias("HvyAtm"),
        heavy.alias("Atoms"),
    )


def explode_offers(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per usable pack of a price response: code, pack_no, price, amount, measure,
    price_per_gram. Packs with a missing field, unknown unit or no weight are skipped. ``keep``: columns of the response
    that its packs carry on."""
    entries = responses.select(F.explode("results").alias("r"), *keep).select(
        F.col("r.product.code").alias("code"), F.posexplode("r.prices.g.all").alias("pack_no", "pack"), *keep
    )
    packs = entries.select(
        "code",
        "pack_no",
        F.col("pack.price").alias("price"),
        F.col("pack.weight.amount").alias("amount"),
        F.col("pack.weight.measure").alias("measure"),
        *keep,
    ).filter(F.coalesce(F.col("code"), F.lit("")) != "")
    return packs.withColumn("price_per_gram", price_per_gram("price", "amount", "measure")).filter(
        F.col("price_per_gram").isNotNull()
    )


# Everything from the first separator line on, of a text with a line end put before it: a search for one character is quicker than
# one for the start or a line end.
_AFTER_SEPARATOR = r"(?s)\n[ \t]*(?:-----|Refine)[^\n]*(\n.*)$"
# A pose line: one whole number and three numbers, bars counting as blanks, maybe more behind. Lines
# that name the columns are no poses; the names are looked for behind the numbers only, which hold no letters but e.
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_POSE_LINE = (
    r"(?m)^[ \t|]*[+-]?\d+"
    rf"(?:[ \t|]+{_NUMBER}){{3}}(?=[ \t|\r]|$)(?![^\n]*(?i:mode|affinity))"
)


def _pose_lines(text: str) -> Column:
    behind = F.regexp_extract(F.concat(F.lit("\n"), F.col(text)), _AFTER_SEPARATOR, 1)
    return F.regexp_extract_all(behind, F.lit(_POSE_LINE), F.lit(0))


def parse_dock_logs(logs: DataFrame, keep: Sequence[str] = (), stem: str = "stem", text: str = "value") -> DataFrame:
    """Poses per log: ligand_id, receptor_id, pose_no (order in the log), rank, score, rmsd_lb,
    rmsd_ub. Only lines behind the first separator count. ``keep``: columns of the log that its poses carry on."""
    ligand, receptor = stem_parts(stem)
    lines = logs.filter(F.col(stem).contains("_")).select(
        ligand.alias("ligand_id"), receptor.alias("receptor_id"), F.posexplode(_pose_lines(text)).alias("pos", "line"), *keep
    )
    part = F.regexp_extract_all("line", F.lit(r"[^ \t|]+"), F.lit(0))
    return lines.select(
        "ligand_id",
        "receptor_id",
        (F.col("pos") + 1).alias("pose_no"),
        F.get(part, F.lit(0)).try_cast("int").alias("rank"),
        *[F.get(part, F.lit(i)).try_cast("double").alias(c) for i, c in ((1, "score"), (2, "rmsd_lb"), (3, "rmsd_ub"))],
        *keep,
    )


def log_summary(logs: DataFrame, stem: str = "stem", text: str = "value") -> DataFrame:
    """One row per log with its number of poses, 0 included."""
    ligand, receptor = stem_parts(stem)
    return logs.filter(F.col(stem).contains("_")).select(
        ligand.alias("ligand_id"), receptor.alias("receptor_id"), F.size(_pose_lines(text)).alias("n_poses")
    )


def pose_file_summary(files: DataFrame, stem: str = "stem", text: str = "value") -> DataFrame:
    """One row per pose file: size in bytes and whether it holds a docking marker."""
    ligand, receptor = stem_parts(F.regexp_replace(F.col(stem), "_out$", ""))
    marked = F.col(text).contains("MODEL 1") | F.col(text).contains("REMARK VINA RESULT")
    return files.select(
        ligand.alias("ligand_id"),
        receptor.alias("receptor_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        marked.alias("has_marker"),
    )


def _coordinates(line: Column) -> list[Column]:
    """x, y, z of the fixed columns 31-38, 39-46 and 47-54."""
    return [
        F.trim(F.substring(line, at, 8)).try_cast("double").alias(name) for name, at in (("x", 31), ("y", 39), ("z", 47))
    ]


def _atom_lines(df: DataFrame, carried: Sequence[Column | str], block: Column) -> DataFrame:
    rows = df.select(*carried, F.posexplode(_lines(block)).alias("_pos", "_line"))
    rows = rows.filter(F.col("_line").startswith("ATOM") | F.col("_line").startswith("HETATM"))
    placed = rows.select("*", (F.col("_pos") + 1).alias("atom_no"), *_coordinates(F.col("_line")))
    return placed.filter("x is not null and y is not null and z is not null")


def parse_pose_atoms(files: DataFrame, stem: str = "stem", text: str = "value") -> DataFrame:
    """Atoms per pose: ligand_id, receptor_id, model, atom_no, x, y, z. The model number counts the
    MODEL lines; 0 stands for text before the first one. Unreadable lines are skipped."""
    ligand, receptor = stem_parts(F.regexp_replace(F.col(stem), "_out$", ""))
    models = files.select(
        ligand.alias("ligand_id"),
        receptor.alias("receptor_id"),
        F.posexplode(F.split(F.col(text), r"(?m)^MODEL[^\n]*$")).alias("model", "_block"),
    )
    return _atom_lines(models, ["ligand_id", "receptor_id", "model"], F.col("_block")).drop("_pos", "_line")


def parse_structure_atoms(files: DataFrame, stem: str = "stem", text: str = "value") -> DataFrame:
    """Atoms per structure: structure_id, atom_no, record, atom, residue, chain, resnum, x, y, z."""
    line = F.col("_line")
    rows = _atom_lines(files, [F.col(stem).alias("structure_id")], F.col(text))
    return rows.select(
        "structure_id",
        "atom_no",
        F.when(line.startswith("ATOM"), "ATOM").otherwise("HETATM").alias("record"),
        F.trim(F.substring(line, 13, 4)).alias("atom"),
        F.trim(F.substring(line, 18, 3)).alias("residue"),
        F.substring(line, 22, 1).alias("chain"),
        F.trim(F.substring(line, 23, 4)).try_cast("int").alias("resnum"),
        "x",
        "y",
        "z",
    ).filter("resnum is not null")


def clean_structure(atoms: DataFrame) -> DataFrame:
    """Protein only: ATOM records of standard residues, all chains."""
    return atoms.filter((F.col("record") == "ATOM") & F.col("residue").isin(*STANDARD_RESIDUES))


def nonstandard_residues(atoms: DataFrame) -> DataFrame:
    """Distinct ``chain:resnum`` of residues that are neither standard nor water."""
    return (
        atoms.filter(~F.col("residue").isin(*STANDARD_RESIDUES, *WATER))
        .select("structure_id", F.concat_ws(":", "chain", F.col("resnum").cast("string")).alias("residue_key"))
        .distinct()
    )
