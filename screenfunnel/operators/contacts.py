"""Geometry on atom tables: contacts, centres, superposition, pose scores.

An atom table has one row per atom with ``x``, ``y``, ``z``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import require_columns
from screenfunnel.session import scratch_path

XYZ = ("x", "y", "z")
# Distances in Å and the share of atoms in the pocket of the pose score.
CONTACT, CLASH, POCKET, POCKET_SHARE = 3.5, 2.0, 5.0, 0.3
#: Cα atoms that one task groups by structure.
TASK_ATOMS = 200_000
# The binding-site centre used when nothing better is known.
FALLBACK_CENTRE = (73.0, 52.0, 28.0)


def _cells(radius: float, shift: Sequence[int] = (0, 0, 0), prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / F.lit(radius)) + F.lit(s) for c, s in zip(XYZ, shift)]


def close_pairs(
    a: DataFrame, b: DataFrame, radius: float, on: Sequence[str], a_id: str, hot_rows: int = 100_000
) -> DataFrame:
    """Pairs of points nearer than ``radius`` among rows with equal ``on`` columns.

    Points of b carry columns named ``b_…`` (coordinates ``b_x``, ``b_y``, ``b_z``). Space is cut
    into cubes of edge ``radius``; b is put into its 27 neighbour cubes and the join is on the
    cube. A cube that holds more than ``hot_rows`` points of a (and more than 0.1 % of them, so
    there are at most 1000 such cubes to broadcast) is spread over salted copies.
    """
    cells = ["_cx", "_cy", "_cz"]
    keys = [*on, *cells]
    left = a.withColumns(dict(zip(cells, _cells(radius))))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    cubes = F.array(
        *[F.struct(*[c.alias(n) for c, n in zip(_cells(radius, s, "b_"), cells)]) for s in steps]
    )
    right = b.withColumn("_cube", F.explode(cubes)).select("*", "_cube.*").drop("_cube")

    total = a.count()
    crowded = (
        left.groupBy(*keys)
        .count()
        .filter(F.col("count") > max(hot_rows, total / 1000))
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_copies"))
    )
    left = left.join(F.broadcast(crowded), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(a_id), F.coalesce("_copies", F.lit(1))).cast("int")
    )
    right = right.join(F.broadcast(crowded), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    )
    gap = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in XYZ), F.lit(0.0)))
    return (
        left.drop("_copies")
        .join(right.drop("_copies"), [*keys, "_salt"])
        .withColumn("distance", gap)
        .filter(F.col("distance") < F.lit(radius))
        .drop(*cells, "_salt")
    )


def nearest_within(
    a: DataFrame, b: DataFrame, radius: float, on: Sequence[str], a_keys: Sequence[str], a_id: str
) -> DataFrame:
    """Per point of a that has one: the distance to the nearest point of b within the radius, and
    how many there are. The pairs flow straight into the aggregate's partial step."""
    return (
        close_pairs(a, b, radius, on, a_id)
        .groupBy(*a_keys)
        .agg(F.min("distance").alias("nearest"), F.count(F.lit(1)).alias("n_close"))
    )


def centroid(atoms: DataFrame, group: str) -> DataFrame:
    """Mean position per group."""
    return atoms.groupBy(group).agg(*[F.avg(c).alias(f"center_{c}") for c in XYZ], F.count("*").alias("n_atoms"))


def ligand_centre(
    structures: DataFrame,
    atoms: DataFrame,
    group: str,
    residue: Column,
    transferred: DataFrame | None = None,
    fallback: Sequence[float] = FALLBACK_CENTRE,
) -> DataFrame:
    """Binding-site centre per structure: the mean of the ligand residue's atoms, else the centre
    transferred from a reference structure, else the fixed fallback; ``source`` says which."""
    names = [f"center_{c}" for c in XYZ]
    own = centroid(atoms.filter(residue), group).select(group, *[F.col(n).alias(f"_own_{n}") for n in names])
    return _chosen_centre(structures.select(group).distinct().join(own, group, "left"), group, transferred, fallback)


def _chosen_centre(out: DataFrame, group: str, transferred: DataFrame | None, fallback: Sequence[float]) -> DataFrame:
    """One of the three centres for every row of ``out``, which has a structure's own centre, or null, as ``_own_center_…``."""
    names = [f"center_{c}" for c in XYZ]
    if transferred is not None:
        # Both sides have a row per structure, however small the tables that they were made of.
        found = transferred.select(group, *[F.col(n).alias(f"_tr_{n}") for n in names]).hint("merge")
        out = out.join(found, group, "left")
    else:
        out = out.withColumns({f"_tr_{n}": F.lit(None).cast("double") for n in names})
    source = (
        F.when(F.col("_own_center_x").isNotNull(), "ligand")
        .when(F.col("_tr_center_x").isNotNull(), "transferred")
        .otherwise("fallback")
    )
    picks = [
        F.coalesce(F.col(f"_own_{n}"), F.col(f"_tr_{n}"), F.lit(v)).alias(n) for n, v in zip(names, fallback)
    ]
    return out.select(group, *picks, source.alias("source"))


def search_box(centres: DataFrame, group: str, size: float = 24.0, override: DataFrame | None = None) -> DataFrame:
    """Cube around each centre, the centre rounded to 3 decimals. A row of ``override`` (six box
    columns) replaces the computed box of its group."""
    centre = [f"center_{c}" for c in XYZ]
    sizes = [f"size_{c}" for c in XYZ]
    box = centres.select(
        group, *[F.round(F.col(c), 3).alias(c) for c in centre], *[F.lit(float(size)).alias(s) for s in sizes]
    )
    if override is None:
        return box
    missing = [c for c in (*centre, *sizes) if c not in override.columns]
    if missing:
        raise ValueError(f"override box: missing {', '.join(missing)}")
    given = override.select(group, *[F.col(c).alias(f"_o_{c}") for c in (*centre, *sizes)])
    return box.join(given, group, "left").select(
        group, *[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) for c in (*centre, *sizes)]
    )


ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
SHIFT = ["tx", "ty", "tz"]


def _rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best rotation from each row's 3×3 covariance sums; all rows of a batch at once."""
    for pdf in batches:
        if pdf.empty:
            continue
        cross = pdf[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(cross)
        v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
        flip = np.ones((len(pdf), 3))
        flip[:, 2] = np.linalg.det(v @ ut)
        rotation = (v * flip[:, None, :]) @ ut
        target = pdf[["rx", "ry", "rz"]].to_numpy()
        moved = np.einsum("nij,nj->ni", rotation, pdf[["mx", "my", "mz"]].to_numpy())
        yield pd.concat(
            [
                pdf[["structure", "n_pairs"]].reset_index(drop=True),
                pd.DataFrame(rotation.reshape(-1, 9), columns=ROTATION),
                pd.DataFrame(target - moved, columns=SHIFT),
            ],
            axis=1,
        )


def superpose(pairs: DataFrame, structure: str, check: bool = True) -> DataFrame:
    """Rotation and shift per structure that move its points (``mob_…``) onto the matched reference
    points (``ref_…``) with least squared distance.

    The covariances are Spark aggregates; only the 3×3 decompositions, one row per structure, run
    in Python. Fewer than 3 pairs are an error, or are left out with ``check=False``.
    """
    cross = [
        (F.covar_pop(f"mob_{p}", f"ref_{q}") * F.count("*")).alias(f"c{i}{j}")
        for i, p in enumerate(XYZ)
        for j, q in enumerate(XYZ)
    ]
    sums = pairs.groupBy(F.col(structure).cast("string").alias("structure")).agg(
        F.count("*").alias("n_pairs"),
        *[F.avg(f"mob_{c}").alias(f"m{c}") for c in XYZ],
        *[F.avg(f"ref_{c}").alias(f"r{c}") for c in XYZ],
        *cross,
    )
    if check and not sums.filter("n_pairs < 3").limit(1).isEmpty():
        raise ValueError("superpose: a structure has fewer than 3 matched pairs")
    schema = "structure string, n_pairs long, " + ", ".join(f"{c} double" for c in [*ROTATION, *SHIFT])
    return sums.filter("n_pairs >= 3").mapInPandas(_rotations, schema)


def matched_ca(reference: DataFrame, mobile: DataFrame, residue_map: DataFrame, structure: str) -> DataFrame:
    """Matched Cα atoms (chain A) of every mobile structure and the one reference.

    ``residue_map`` has ref_resnum and mob_resnum. Of repeated residues the last one counts. The Cα atoms are counted, and dealt
    to tasks by structure, so that what is grouped of them by residue and then by structure is bounded per task; the reference's
    residues, a few hundred rows, are broadcast.
    """
    ca = (F.col("record") == "ATOM") & (F.col("atom") == "CA") & (F.col("chain") == "A")
    ref = (
        reference.filter(ca)
        .groupBy(F.col("resnum").alias("ref_resnum"))
        .agg(*[F.max_by(c, "atom_no").alias(f"ref_{c}") for c in XYZ])
    )
    places = mobile.filter(ca).select(structure, "resnum", "atom_no", *XYZ)
    mob = (
        places.repartition(max(1, math.ceil(places.count() / TASK_ATOMS)), structure)
        .groupBy(structure, F.col("resnum").alias("mob_resnum"))
        .agg(*[F.max_by(c, "atom_no").alias(f"mob_{c}") for c in XYZ])
    )
    # Without the hint the optimiser may take the many structures for the smaller side, or move all rows by residue number.
    return mob.join(F.broadcast(residue_map.join(ref, "ref_resnum")), "mob_resnum")


def apply_transform(df: DataFrame, point: Sequence[str] = XYZ, out: Sequence[str] = XYZ) -> DataFrame:
    """Rotate and shift the point columns by the row's rotation and shift columns."""
    moved = {
        o: sum((F.col(f"r{i}{j}") * F.col(p) for j, p in enumerate(point)), F.col(t))
        for i, (o, t) in enumerate(zip(out, SHIFT))
    }
    return df.withColumns(moved)


def transferred_centres(transforms: DataFrame, structure: str, centre: Sequence[float], into_frame: bool = False) -> DataFrame:
    """The reference's site centre carried to every structure of ``transforms`` (of :func:`superpose`, one row each).

    The transforms move a structure onto the reference. By default the centre is moved by them as it stands, as the published
    workflow does; ``into_frame`` moves it the other way, into the structure's own frame.
    """
    point = [F.lit(float(v)) for v in centre]
    if into_frame:
        # the inverse of a rotation is its transpose
        moved = [sum((F.col(f"r{j}{i}") * (point[j] - F.col(SHIFT[j])) for j in range(3)), F.lit(0.0)) for i in range(3)]
    else:
        moved = [sum((F.col(f"r{i}{j}") * point[j] for j in range(3)), F.col(SHIFT[i])) for i in range(3)]
    return transforms.select(F.col("structure").alias(structure), *[m.alias(f"center_{c}") for m, c in zip(moved, XYZ)])


def binding_sites(
    atoms: DataFrame,
    structure: str,
    ligand: Column,
    reference: str,
    residue_map: DataFrame,
    centre: Sequence[float] | None = None,
    fallback: Sequence[float] = FALLBACK_CENTRE,
    into_frame: bool = False,
) -> DataFrame:
    """Site centre of every structure of an atom table, and where it comes from, in one keyed dataflow.

    The mean of the structure's own ``ligand`` atoms (source ``ligand``); else the centre of the ``reference`` structure, carried
    over by superposing the matched Cα atoms (``transferred``, with 3 matched residues or more); else ``fallback``. ``centre``:
    the reference's centre if it is known, else the mean of its own ligand atoms; without either nothing is transferred.
    ``residue_map`` has ref_resnum and mob_resnum. The reference's own row follows the same chain.
    """
    require_columns(atoms, [structure, "record", "atom", "chain", "resnum", "atom_no", *XYZ], "binding_sites")
    at_ligand = F.col(structure).isNotNull() & ligand
    own = atoms.groupBy(structure).agg(*[F.avg(F.when(at_ligand, F.col(c))).alias(f"_own_center_{c}") for c in XYZ])
    if centre is None:
        row = atoms.filter((F.col(structure) == reference) & ligand).agg(*[F.avg(c) for c in XYZ]).first()
        centre = None if row[0] is None else tuple(row)
    if centre is None:
        return _chosen_centre(own, structure, None, fallback)
    pairs = matched_ca(atoms.filter(F.col(structure) == reference), atoms, F.broadcast(residue_map), structure)
    transforms = superpose(pairs, structure, check=False)
    return _chosen_centre(own, structure, transferred_centres(transforms, structure, centre, into_frame), fallback)


#: Two points of one cube of this edge, in radii, are always nearer than the radius (its diagonal is 0.9994 of it).
INNER_EDGE = 0.577
# Filled cubes are broadcast up to this many.
SENT_CUBES = 200_000


def _near_for_sure(atoms: DataFrame, targets: DataFrame, where: Column, name: str) -> DataFrame:
    """The atoms with ``_arg``, ``_tyr`` and ``_clash``: a target of the kind lies in the atom's own cube, so it is near for sure.

    There are at most as many cubes as targets, and as many as space has, so the more targets there are, the more is settled here.
    """
    edges = {"arg": CONTACT * INNER_EDGE, "tyr": CONTACT * INNER_EDGE, "clash": CLASH * INNER_EDGE}
    cells = ["_cx", "_cy", "_cz"]
    for kind, edge in edges.items():
        found = targets.filter(F.col("_kind") == kind)
        cubes = found.select("receptor_id", *[c.alias(n) for c, n in zip(_cells(edge, prefix="b_"), cells)]).distinct()
        cubes = cubes.withColumn("_in", F.lit(True))
        cubes = F.broadcast(cubes) if cubes.count() <= SENT_CUBES else cubes
        marked = atoms.withColumns(dict(zip(cells, _cells(edge)))).join(cubes, ["receptor_id", *cells], "left")
        atoms = marked.withColumn(f"_{kind}", where & F.coalesce("_in", F.lit(False))).drop(*cells, "_in")
    path = scratch_path(atoms.sparkSession, name)
    atoms.write.parquet(path)
    return atoms.sparkSession.read.parquet(path)


def _unsettled(seen: DataFrame, pose: Sequence[str]) -> DataFrame:
    """One row per atom and kind of contact that its pose's score still depends on."""
    clashing = F.size(F.collect_set(F.when(F.col("_clash"), F.struct("_model", "atom_no"))))
    asks = seen.groupBy(*[F.col(c).alias(f"_of_{c}") for c in pose]).agg(
        (~F.max("_arg")).alias("_ask_arg"), (~F.max("_tyr")).alias("_ask_tyr"), (clashing <= 2).alias("_ask_clash")
    )
    asks = asks.filter("_ask_arg OR _ask_tyr OR _ask_clash")
    rows = seen.join(asks, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in pose])
    kinds = F.array(
        F.when(F.col("_ask_arg"), "arg"), F.when(F.col("_ask_tyr"), "tyr"), F.when(F.col("_ask_clash") & ~F.col("_clash"), "clash")
    )
    path = scratch_path(seen.sparkSession, "unsettled_atoms")
    spread = F.xxhash64("ligand_id", "_model", "atom_no").alias("_spread")
    rows = rows.select(*pose, "_model", "atom_no", *XYZ, spread, F.explode(F.array_compact(kinds)).alias("_kind"))
    rows.write.parquet(path)
    return seen.sparkSession.read.parquet(path)


def geometric_score(
    pose_atoms: DataFrame,
    receptor_atoms: DataFrame,
    labels: dict[str, str],
    scored_label: str = "COX2",
    per_model: bool = True,
    pocket_centre: Sequence[float] | None = None,
) -> DataFrame:
    """Score per pose (ligand_id, receptor_id, model).

    +2 an atom within 3.5 Å of Arg120 NH1/NH2, +2 within 3.5 Å of Tyr355 OH, +1 more than 30 % of
    the atoms within 5 Å of the pocket centre (default: the pose's own centre), +1 no clash, −2
    more than two clashing atoms (within 2 Å of any receptor atom). Receptors with another label
    score 0. ``per_model=False`` scores all models of a file as one.

    The score asks whether an atom is near, not how often: what a filled cube of space settles is not paired. The atoms, and those
    left to pair, are stored in the scratch folder.
    """
    wanted = [r for r, label in labels.items() if label == scored_label]
    pose = ["ligand_id", "receptor_id", "model"]
    atoms = pose_atoms.withColumn("_model", F.col("model"))
    if not per_model:
        atoms = atoms.withColumn("model", F.lit(1))
    site = (
        F.when((F.col("resnum") == 120) & (F.col("residue") == "ARG") & F.col("atom").isin("NH1", "NH2"), "arg")
        .when((F.col("resnum") == 355) & (F.col("residue") == "TYR") & (F.col("atom") == "OH"), "tyr")
        .otherwise("")
    )
    # Copies of an atom at the same place add nothing.
    receptor = receptor_atoms.select(
        "receptor_id", site.alias("b_site"), *[F.col(c).alias(f"b_{c}") for c in XYZ]
    ).distinct()
    kinds = F.filter(F.array(F.lit("clash"), F.col("b_site")), lambda k: k != "")
    targets = receptor.withColumn("_kind", F.explode(kinds))
    is_scored = F.col("receptor_id").isin(*wanted)
    seen = _near_for_sure(atoms, targets.filter(is_scored), is_scored, "seen_atoms")
    unsettled = _unsettled(seen.filter(is_scored), pose)
    near = close_pairs(unsettled, targets, CONTACT, ["receptor_id", "_kind"], "_spread")
    near = near.filter((F.col("_kind") != "clash") | (F.col("distance") < CLASH))
    atom = F.struct("_model", "atom_no")
    contact = near.groupBy(*pose).agg(
        F.max(F.when(F.col("_kind") == "arg", 1)).alias("arg"),
        F.max(F.when(F.col("_kind") == "tyr", 1)).alias("tyr"),
        F.collect_set(F.when(F.col("_kind") == "clash", atom)).alias("clashes"),
    )
    # One row per pose with its atoms, a few hundred at most: the pocket is a matter of the row.
    own = [F.avg(c).alias(f"_p{c}") for c in XYZ]
    given = [F.first(F.lit(float(v))).alias(f"_p{c}") for c, v in zip(XYZ, pocket_centre or ())]
    places = F.collect_list(F.when(is_scored, F.struct(*XYZ))).alias("_atoms")
    sure = [F.max("_arg").alias("_arg"), F.max("_tyr").alias("_tyr"), F.collect_set(F.when(F.col("_clash"), atom)).alias("_sure")]
    rows = seen.groupBy(*pose).agg(places, *sure, *(own if pocket_centre is None else given))

    def inside(atom: Column) -> Column:
        return F.sqrt(sum(((atom[c] - F.col(f"_p{c}")) * (atom[c] - F.col(f"_p{c}")) for c in XYZ), F.lit(0.0))) < POCKET

    share = F.size(F.filter("_atoms", inside)) / F.size("_atoms")
    clashes = F.size(F.array_union("_sure", F.coalesce(F.col("clashes"), F.array_except("_sure", "_sure"))))
    score = (
        F.when(F.col("_arg") | F.col("arg").isNotNull(), 2.0).otherwise(0.0)
        + F.when(F.col("_tyr") | F.col("tyr").isNotNull(), 2.0).otherwise(0.0)
        + F.when(share > POCKET_SHARE, 1.0).otherwise(0.0)
        + F.when(clashes == 0, 1.0).when(clashes <= 2, 0.0).otherwise(-2.0)
    )
    return rows.join(contact, pose, "left").select(*pose, F.when(is_scored, score).otherwise(0.0).alias("geometric_score"))
