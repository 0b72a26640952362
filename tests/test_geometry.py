import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfunnel.operators import contacts
from screenfunnel.plans.grading import all_poses, best_poses


@pytest.fixture(scope="module")
def clouds(spark):
    """Two point sets in two groups; a third of the first set crowds one small cube."""
    rnd = random.Random(11)

    def point(i):
        return (0.1 * rnd.random(),) * 3 if i % 3 == 0 else tuple(rnd.uniform(-3, 3) for _ in range(3))

    a = [(i, i % 2, *point(i)) for i in range(400)]
    b = [(i % 2, *point(i)) for i in range(300)]
    return (
        spark.createDataFrame(a, "a_id long, g int, x double, y double, z double").cache(),
        spark.createDataFrame(b, "g int, b_x double, b_y double, b_z double").cache(),
    )


@pytest.mark.parametrize("hot_rows", [100_000, 20])
@pytest.mark.parametrize("radius", [0.05, 0.7, 2.0])
def test_grid_equals_all_pairs(clouds, radius, hot_rows):
    a, b = clouds
    got = contacts.close_pairs(a, b, radius, ["g"], "a_id", hot_rows).groupBy("a_id").agg(F.min("distance").alias("d"), F.count("*").alias("n"))
    want = {}
    others = b.collect()
    for p in a.collect():
        ds = [math.dist((p.x, p.y, p.z), (q.b_x, q.b_y, q.b_z)) for q in others if q.g == p.g]
        ds = [d for d in ds if d < radius]
        if ds:
            want[p.a_id] = (pytest.approx(min(ds)), len(ds))
    assert {r.a_id: (r.d, r.n) for r in got.collect()} == want


def test_superpose_recovers_the_motion(spark):
    rnd = np.random.default_rng(2)
    rows, truth = [], {}
    for s in range(5):
        q, _ = np.linalg.qr(rnd.normal(size=(3, 3)))
        if np.linalg.det(q) < 0:
            q[:, 0] = -q[:, 0]
        t = rnd.normal(size=3) * 10
        truth[f"s{s}"] = (q, t)
        for _ in range(6):
            m = rnd.normal(size=3) * 5
            rows.append((f"s{s}", *map(float, m), *map(float, q @ m + t)))
    cols = ["structure", *[f"mob_{c}" for c in "xyz"], *[f"ref_{c}" for c in "xyz"]]
    df = spark.createDataFrame(rows, cols)
    found = contacts.superpose(df, "structure").collect()
    assert len(found) == 5
    for r in found:
        q, t = truth[r.structure]
        assert np.allclose([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)], q)
        assert np.allclose([r.tx, r.ty, r.tz], t)
    moved = contacts.apply_transform(
        df.join(contacts.superpose(df, "structure"), "structure"), ["mob_x", "mob_y", "mob_z"], ["x", "y", "z"]
    )
    assert moved.filter("abs(x - ref_x) + abs(y - ref_y) + abs(z - ref_z) > 1e-6").count() == 0
    with pytest.raises(ValueError):
        contacts.superpose(df.limit(2), "structure")
    assert contacts.superpose(df.limit(2), "structure", check=False).count() == 0


def test_superpose_of_a_mirror_image_is_a_rotation(spark):
    rnd = np.random.default_rng(4)
    rows = [("m", *map(float, p), float(-p[0]), float(p[1]), float(p[2])) for p in rnd.normal(size=(8, 3))]
    df = spark.createDataFrame(rows, ["structure", *[f"mob_{c}" for c in "xyz"], *[f"ref_{c}" for c in "xyz"]])
    r = contacts.superpose(df, "structure").first()
    assert np.linalg.det(np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])) == pytest.approx(1.0)


ATOM = "structure_id string, atom_no int, record string, atom string, residue string, chain string, resnum int, x double, y double, z double"


def test_matched_ca(spark):
    def rows(name, shift, resnums):
        return [(name, i, "ATOM", "CA", "ALA", "A", n, float(n), shift, 0.0) for i, n in enumerate(resnums)]

    ref = spark.createDataFrame(rows("6COX", 0.0, [93, 100, 106]), ATOM)
    mob = spark.createDataFrame(rows("3KK6", 5.0, [93, 100, 200]), ATOM)
    pairs = spark.createDataFrame([(n, n) for n in (93, 100, 106)], "ref_resnum int, mob_resnum int")
    got = contacts.matched_ca(ref, mob, pairs, "structure_id")
    assert sorted((r.mob_resnum, r.mob_y, r.ref_y) for r in got.collect()) == [(93, 5.0, 0.0), (100, 5.0, 0.0)]


def pose(ligand, receptor, model, *points):
    return [(ligand, receptor, model, i, *map(float, p)) for i, p in enumerate(points)]


POSE = "ligand_id string, receptor_id string, model int, atom_no int, x double, y double, z double"


@pytest.fixture(scope="module")
def site(spark):
    atoms = [
        ("6COX", "NH1", "ARG", 120, 0.0, 0.0, 0.0), ("6COX", "OH", "TYR", 355, 10.0, 0.0, 0.0),
        ("6COX", "NH1", "ARG", 121, 50.0, 0.0, 0.0), ("6COX", "CB", "ALA", 1, 30.0, 0.0, 0.0), ("6COX", "CB", "ALA", 1, 30.0, 0.0, 0.0),
    ]
    return spark.createDataFrame(atoms, "receptor_id string, atom string, residue string, resnum int, x double, y double, z double")


def scores(df, site, **kw):
    found = contacts.geometric_score(df, site, {"6COX": "COX2", "3KK6": "COX1"}, **kw)
    return {(r.ligand_id, r.receptor_id, r.model): r.geometric_score for r in found.collect()}


def test_geometric_score(spark, site):
    rows = (
        pose("both", "6COX", 1, (3, 0, 0), (7, 0, 0))  # +2 +2, all atoms in the pocket +1, no clash +1
        + pose("both", "3KK6", 1, (3, 0, 0))  # not scored
        + pose("far", "6COX", 1, (100, 0, 0))  # pocket +1, no clash +1
        + pose("other", "6COX", 1, (52.5, 0, 0))  # another arginine does not count
        + pose("clash2", "6COX", 1, (30, 1, 0), (30, -1, 0))  # two clashes: 0, pocket +1
        + pose("clash3", "6COX", 1, (30, 1, 0), (30, -1, 0), (30, 0, 1))  # three clashes: −2, pocket +1
        + pose("wide", "6COX", 1, (100, 0, 0), (200, 0, 0), (300, 0, 0), (400, 0, 0))  # pocket empty: +1 for no clash
        + pose("edge", "6COX", 1, (3.5, 0, 0))  # 3.5 is not below 3.5
    )
    got = scores(spark.createDataFrame(rows, POSE), site)
    assert got == {
        ("both", "6COX", 1): 6.0, ("both", "3KK6", 1): 0.0, ("far", "6COX", 1): 2.0, ("other", "6COX", 1): 2.0,
        ("clash2", "6COX", 1): 1.0, ("clash3", "6COX", 1): -1.0, ("wide", "6COX", 1): 1.0, ("edge", "6COX", 1): 2.0,
    }


def test_scores_per_model_or_per_file(spark, site):
    df = spark.createDataFrame(pose("l", "6COX", 1, (100, 0, 0)) + pose("l", "6COX", 2, (3, 0, 0)), POSE)
    assert scores(df, site) == {("l", "6COX", 1): 2.0, ("l", "6COX", 2): 4.0}
    # As one: the centre lies between the two atoms, so the pocket is empty.
    assert scores(df, site, per_model=False) == {("l", "6COX", 1): 3.0}
    assert scores(df, site, per_model=False, pocket_centre=(3.0, 0.0, 0.0)) == {("l", "6COX", 1): 4.0}


def test_best_poses(spark, site):
    atoms = spark.createDataFrame(
        pose("l", "6COX", 1, (100, 0, 0)) + pose("l", "6COX", 2, (3, 0, 0)) + pose("l", "3KK6", 1, (3, 0, 0)), POSE
    )
    logs = spark.createDataFrame(
        [("l", "6COX", 1, 1, -9.123), ("l", "6COX", 2, 2, -8.0), ("l", "6COX", 3, 3, -7.0), ("l", "6COX", 4, 4, -6.0), ("l", "3KK6", 1, 1, -5.0), ("l", "3KK6", 2, 2, -4.0)],
        "ligand_id string, receptor_id string, pose_no int, rank int, score double",
    )
    poses = all_poses(logs)
    assert poses.count() == 5  # at most three per log
    got = {r.receptor_id: (r.cox_label, r.best_pose_rank, r.docking_score, r.geometric_score) for r in best_poses(poses, atoms, site).collect()}
    assert got == {"6COX": ("COX2", 2, -8.0, 4.0), "3KK6": ("COX1", 1, -5.0, 0.0)}
    whole = {r.receptor_id: r.best_pose_rank for r in best_poses(poses, atoms, site, per_model=False).collect()}
    assert whole == {"6COX": 1, "3KK6": 1}  # all poses tie, the first wins


def turned(name, rotation, shift, n=6, ligand=None):
    base = np.array([[1, 0, 2], [4, 1, 0], [0, 5, 1], [3, 3, 3], [7, 2, 5], [1, 8, 2]], float)[:n]
    rows = [(name, "ATOM", "CA", "ALA", "A", i + 1, i, *map(float, rotation @ p + shift)) for i, p in enumerate(base)]
    return rows + [(name, "HETATM", "C1", "LIG", "A", 900, 100 + i, *map(float, p)) for i, p in enumerate(ligand or [])]


def test_binding_sites(spark):
    """Own ligand, else the reference's centre by superposition, else the fixed one; both directions of the transfer."""
    c, s = np.cos(0.7), np.sin(0.7)
    turn, move, one = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), np.array([5.0, -2.0, 9.0]), np.eye(3)
    schema = "structure_id string, record string, atom string, residue string, chain string, resnum int, atom_no int, x double, y double, z double"
    rows = turned("ref", one, 0, ligand=[(1, 2, 3), (3, 4, 5)]) + turned("own", turn, move, ligand=[(9, 9, 9)])
    rows += turned("moved", turn, move) + turned("few", turn, move, n=2) + [("none", "HETATM", "O", "HOH", "A", 1, 1, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame([(i, i) for i in range(1, 7)], "ref_resnum int, mob_resnum int")
    is_ligand = F.col("residue") == "LIG"

    def found(**kw):
        return {r.structure_id: (r.source, np.array([r.center_x, r.center_y, r.center_z])) for r in contacts.binding_sites(atoms, "structure_id", is_ligand, "ref", same, **kw).collect()}

    for into_frame, want in ((True, turn @ [2, 3, 4] + move), (False, turn.T @ ([2, 3, 4] - move))):
        got = found(into_frame=into_frame)
        assert {k: v[0] for k, v in got.items()} == {"ref": "ligand", "own": "ligand", "moved": "transferred", "few": "fallback", "none": "fallback"}
        assert np.allclose(got["moved"][1], want) and np.allclose(got["own"][1], 9) and np.allclose(got["few"][1], [73, 52, 28])
    given = found(centre=(0.0, 0.0, 0.0), into_frame=True)
    assert np.allclose(given["moved"][1], move) and np.allclose(given["ref"][1], [2, 3, 4])
    bare = contacts.binding_sites(atoms.filter(~is_ligand), "structure_id", is_ligand, "ref", same)
    assert {r.source for r in bare.collect()} == {"fallback"}


def test_pose_score_and_its_scans(spark, tmp_path):
    atoms, receptor = str(tmp_path / "a"), str(tmp_path / "r")
    spark.range(60).selectExpr(
        "concat('L', id % 3) AS ligand_id", "if(id % 3 = 2, '3KK6', '6COX') AS receptor_id", "1 AS model", "cast(id AS int) AS atom_no",
        "cast(id AS double) AS x", "cast(id % 3 AS double) AS y", "0D AS z",
    ).write.parquet(atoms)
    spark.createDataFrame(
        [("6COX", "OH", "TYR", 355, 0.0, 3.0, 0.0)], "receptor_id string, atom string, residue string, resnum int, x double, y double, z double"
    ).write.parquet(receptor)
    scored = contacts.geometric_score(spark.read.parquet(atoms), spark.read.parquet(receptor), {"6COX": "COX2", "3KK6": "COX1"})
    # L0 is 3 Å from the site; L1 and its site are nearer than that, but not so near as to clash. A fifth of the atoms lie in the pocket.
    assert {r.ligand_id: r.geometric_score for r in scored.collect()} == {"L0": 3.0, "L1": 3.0, "L2": 0.0}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    # once for the pockets, once for the contacts, and the crowded cubes for either side of the join
    assert plan.count("Relation [ligand_id") <= 4
    # in the frame of a given pocket
    wide = contacts.geometric_score(
        spark.read.parquet(atoms).where("x < 9"), spark.read.parquet(receptor), {"6COX": "COX2"}, pocket_centre=(4.0, 1.0, 0.0)
    )
    assert {r.ligand_id: r.geometric_score for r in wide.collect()} == {"L0": 4.0, "L1": 4.0, "L2": 0.0}


def test_more_receptor_atoms_leave_fewer_to_pair(spark, monkeypatch):
    """The score by brute force on a crowded receptor, where filled cubes settle nearly all contacts without a pair."""
    rng = np.random.default_rng(3)
    site = [("NH1", "ARG", 120), ("OH", "TYR", 355), ("CA", "ALA", 1), ("CA", "ALA", 1)]
    asked, whole = [], contacts.close_pairs
    monkeypatch.setattr(contacts, "close_pairs", lambda a, *args: asked.append(a.count()) or whole(a, *args))
    for n in (40, 8000):
        receptor = [("6COX", *site[i % 4], *map(float, rng.normal(0, 3, 3))) for i in range(n)]
        atoms = [(f"L{k}", "6COX", 1, i, *map(float, rng.normal(0, 2, 3))) for k in range(30) for i in range(4)]
        atoms += [("L0", "6COX", 1, 0, *atoms[1][4:])]  # an atom number twice counts once
        df = spark.createDataFrame(atoms, POSE)
        r = spark.createDataFrame(receptor, "receptor_id string, atom string, residue string, resnum int, x double, y double, z double")
        got, at = scores(df, r), np.array([x[4:] for x in receptor])
        for k in range(30):
            mine = [x for x in atoms if x[0] == f"L{k}"]
            d = np.array([np.sqrt(((at - np.array(x[4:])) ** 2).sum(1)) for x in mine])
            near = [any(d[:, j::4].min(axis=1) < 3.5) * 2.0 for j in (0, 1)]
            clashes = len({x[3] for x, row in zip(mine, d) if row.min() < 2})
            place = np.array([x[4:] for x in mine])
            share = (np.sqrt(((place - place.mean(0)) ** 2).sum(1)) < 5).mean()
            assert got[f"L{k}", "6COX", 1] == sum(near) + (share > 0.3) + (1 if clashes == 0 else 0 if clashes <= 2 else -2)
    assert asked[1] < asked[0] / 4


def test_structures_are_not_broadcast_to_the_reference(spark, monkeypatch):
    """Of the two sides of the residues only the reference's is broadcast; the structures are dealt to tasks."""
    monkeypatch.setattr(contacts, "TASK_ATOMS", 1000, raising=False)
    atoms = spark.range(500).selectExpr("id", "explode(sequence(1, 12)) AS r").selectExpr(
        "concat('S', id) AS s", "'ATOM' AS record", "'CA' AS atom", "'A' AS chain", "r AS resnum", "r AS atom_no",
        "double(r * 7 % 11 + id) AS x", "double(r * 5 % 13) AS y", "double(r * 3 % 17) AS z",
    )
    same = spark.range(1, 13).selectExpr("id AS ref_resnum", "id AS mob_resnum")
    pairs = contacts.matched_ca(atoms.filter("s = 'S1'"), atoms, same, "s")
    assert pairs.count() == 6000
    places = pairs.select("s", F.spark_partition_id().alias("p")).distinct().groupBy("s").count()
    assert places.filter("count > 1").isEmpty()
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    # the topmost join is the one with the structures
    joins = [line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join " in line]
    assert "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
