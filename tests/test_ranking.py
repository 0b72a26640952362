import pytest
from golden_ranking import COLUMNS, ROWS
from pyspark.sql import functions as F

from screenfunnel.operators import groups, order, ranking, tasks
from screenfunnel.plans import presets
from screenfunnel.plans.grading import final_ranking


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(p[0], *map(float, p[1:])) for p in (line.split() for line in ROWS.strip().splitlines())]
    return spark.createDataFrame(rows, [COLUMNS[0], *COLUMNS[1:]]).cache()


def test_published_ranking(spark, golden):
    best = golden.select(
        "ligand_id", F.lit("COX2").alias("cox_label"), F.col("score_cox2").alias("docking_score"),
        F.col("geo_score").alias("geometric_score"),
    ).unionByName(
        golden.select(
            "ligand_id", F.lit("COX1").alias("cox_label"), F.col("score_cox1").alias("docking_score"),
            F.lit(0.0).alias("geometric_score"),
        )
    )
    ranked = final_ranking(best, golden.select(F.col("ligand_id").alias("ID"), "QSAR_score"))
    want = {r.ligand_id: r for r in golden.collect()}
    rows = ranked.collect()
    assert len(rows) == 80
    for r in rows:
        w = want[r.ligand_id]
        for c in ("score_cox1", "score_cox2", "geo_score", "QSAR_score"):
            assert r[c] == w[c]
        for c in ("qsar_norm", "geo_norm", "vina_norm"):
            assert r[c] == pytest.approx(w[c], abs=1e-12)
        assert r.final_score == pytest.approx(w.final_score, abs=1e-4)
    scores = [r.final_score for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert rows[0].ligand_id == "A60C24S"


def test_rank_normalise_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(order, "HOT_ROWS", 1)
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, float("nan"))], "id int, v double")
    got = {r.id: r.n for r in ranking.rank_normalise(df, "v", "id", "n", invert=False).collect()}
    assert got == {3: 0.0, 1: 0.375, 2: 0.375, 4: None, 5: None}
    one = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert ranking.rank_normalise(one, "v", "id", "n").first().n == 1.0


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_columns_are_ranked_together(spark, monkeypatch, hot_rows):
    """Ties, missing values, repeated and missing ids; the same as one column at a time."""
    monkeypatch.setattr(order, "HOT_ROWS", hot_rows)
    rows = [(i % 50 or None, float(i % 7), None if i % 5 == 0 else i / 3, 1.0, float("nan") if i % 2 else -1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    parts = [ranking.Component(c, f"{c}_norm", invert=c == "b") for c in "abcd"]
    together = ranking.rank_columns(df, parts, "id")
    single = df
    for p in parts:
        single = ranking.rank_normalise(single, p.column, "id", p.out, p.invert)
    assert together.columns == single.columns
    assert sorted(map(str, together.collect())) == sorted(map(str, single.collect()))
    assert ranking.rank_columns(df.limit(0), parts, "id").count() == 0


def test_shuffles_do_not_grow_with_the_columns(spark):
    df = spark.range(1000).select("id", *[(F.col("id") * (i + 3) % 101).cast("double").alias(f"v{i}") for i in range(6)])

    def exchanges(n):
        parts = [ranking.Component(f"v{i}", f"n{i}") for i in range(n)]
        return ranking.composite_score(df, parts, "id")._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges(6) == exchanges(2) <= 15


def test_md_score_without_instability(spark):
    df = spark.createDataFrame([("a", -9.0, -5.0), ("b", -8.0, -7.0)], "ligand_id string, score_cox2 double, score_cox1 double")
    got = {r.ligand_id: r.md_score for r in ranking.md_score(df).collect()}
    assert got == {"a": 2.0, "b": -1.0}


@pytest.mark.parametrize(
    "total,rate,minimum,want", [(0, 0.5, 10, 0), (5, 0.5, 10, 5), (1000, 0.05, 10, 50), (1000, 0.0, 7, 7), (30, 0.01, 1, 1)]
)
def test_keep_count(total, rate, minimum, want):
    assert ranking.keep_count(total, rate, minimum) == want


def test_winnow_ties_and_missing(spark, monkeypatch):
    monkeypatch.setattr(order, "DIRECT_FETCH", 5)
    rows = [(i, 1.0 if i % 3 == 0 else (None if i % 3 == 1 else float(i % 7))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, s double")
    accepted, rejected = ranking.winnow(df, "s", "id", 0.5, 1)
    want = [i for i, s in sorted(rows, key=lambda r: (-r[1] if r[1] is not None else float("inf"), r[0]))[:45]]
    assert sorted(r.id for r in accepted.collect()) == sorted(want)
    assert rejected.count() == 45
    with pytest.raises(ValueError):
        ranking.winnow(df, "s", "id", 1.5)


def test_budget_cascade(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, 500.0), (5, None), (6, 5.0)], "id int, p double")

    def reasons(**kw):
        accepted, rejected = ranking.budget_cascade(df, "p", "id", **kw)
        return {**{r.id: None for r in accepted.collect()}, **{r.id: r.PriceCtrlRejection for r in rejected.collect()}}

    # A missing price passes max_price and is cut last.
    assert reasons(max_price=100.0) == {1: None, 2: None, 3: None, 5: None, 6: None, 4: "max_price"}
    assert reasons(max_price=100.0, strict_missing=True)[5] == "max_price"
    assert reasons(max_price=100.0, rate=0.8, max_rows=3) == {
        6: None, 1: None, 2: None, 3: "max_sample_size", 5: "acceptance_rate", 4: "max_price",
    }
    assert set(reasons(rate=0.0).values()) == {"acceptance_rate"}
    assert reasons(rate=0.01) == {6: None, **{i: "acceptance_rate" for i in (1, 2, 3, 4, 5)}}
    for bad in (dict(rate=2.0), dict(max_rows=0), dict(max_price=-1.0)):
        with pytest.raises(ValueError):
            reasons(**bad)


def test_top_n(spark, monkeypatch):
    rows = [(i, i % 2, None if i == 0 else float(i // 4), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "ID int, g int, QED double, PriceMol double")
    got = {(r.g, r.SelectionRank): r.ID for r in groups.top_n_per_group(df, "g", 3).collect()}
    monkeypatch.setattr(groups, "PRELIMITED", 2)
    salted = {(r.g, r.SelectionRank): r.ID for r in groups.top_n_per_group(df, "g", 3).collect()}
    for g in (0, 1):
        inf = float("inf")
        order_ = sorted((r for r in rows if r[1] == g), key=lambda r: (-(r[2] if r[2] is not None else -inf), r[3], r[0]))
        assert [got[g, k] for k in (1, 2, 3)] == [salted[g, k] for k in (1, 2, 3)] == [r[0] for r in order_[:3]]
    with pytest.raises(ValueError):
        groups.top_n_per_group(df, "g", 0)


def test_representatives(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, "no", 3.0, 0.9, 5.0), (2, "a", 1, "Yes", 9.0, 0.1, None), (3, "a", 1, "y", 1.0, 0.2, 7.0), (4, None, 0, "no", 2.0, 0.3, 1.0)],
        "ID int, g string, flag int, word string, d double, QED double, PriceMol double",
    )

    def pick(**kw):
        return {r.g: (r.ID, r.RepresentativeRule) for r in groups.representative_per_group(df, "g", **kw).collect()}

    assert pick(selected_col="flag") == {"a": (3, "point_selected:flag"), None: (4, "point_selected:flag")}
    assert pick(selected_col="word")["a"] == (3, "point_selected:word")
    assert pick(distance_col="d")["a"] == (3, "centroid_distance:d")
    assert pick()["a"] == (1, "qed_price_rank")


def test_attach_labels_is_one_to_one(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    full = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], ["id", "Cluster", "Point selected"])
    assert groups.attach_labels(df, full, "id", "Cluster").columns == ["id", "Cluster", "Point selected"]
    with pytest.raises(ValueError, match="1 rows have no Cluster"):
        groups.attach_labels(df, full.filter("id = 1"), "id", "Cluster")
    with pytest.raises(ValueError, match="repeated"):
        groups.attach_labels(df, full.union(full), "id", "Cluster")
    with pytest.raises(ValueError, match="repeated"):
        groups.attach_labels(df.union(df), full, "id", "Cluster")


@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_grid_of_two_tables(spark, slice_rows):
    """Receptors beyond the list's limit, as one broadcast slice and as several shuffled ones."""
    ligands = spark.range(3).select(F.concat(F.lit("L"), "id").alias("ID"), (10 - F.col("id")).alias("row_order"))
    n = 2000 if slice_rows > 7 else 20
    receptors = spark.range(n).select(F.concat(F.lit("R"), "id").alias("receptor_id"), F.col("id").alias("row_order"))
    grid = tasks.task_grid_of_tables(ligands, receptors, slice_rows=slice_rows)
    want = [(i * n + j + 1, f"L{2 - i}", f"R{j}") for i in range(3) for j in range(n)]
    assert sorted(tuple(r) for r in grid.collect()) == want
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert tasks.task_grid_of_tables(ligands, receptors.limit(0)).count() == 0


def test_task_grid_and_status(spark):
    ligands = spark.createDataFrame([("L1", 10), ("L_2", 20)], "ID string, row_order int")
    grid = tasks.task_grid(ligands, ["6COX", "3KK6"])
    assert sorted(tuple(r) for r in grid.collect()) == [
        (1, "L1", "6COX"), (2, "L1", "3KK6"), (3, "L_2", "6COX"), (4, "L_2", "3KK6"),
    ]
    logs = spark.createDataFrame(
        [("L1", "6COX", 3), ("L1", "3KK6", 0), ("L_2", "6COX", 1), ("L_2", "3KK6", 2), ("x", "6COX", 1)],
        "ligand_id string, receptor_id string, n_poses long",
    )
    poses = spark.createDataFrame(
        [("L1", "6COX", 500, True), ("L1", "3KK6", 500, True), ("L_2", "6COX", 99, True), ("L_2", "3KK6", 500, False)],
        "ligand_id string, receptor_id string, n_bytes long, has_marker boolean",
    )
    checked = tasks.check_tasks(grid, logs, poses)
    assert {(r.ligand_id, r.receptor_id): (r.outcome, r.reason) for r in checked.collect()} == {
        ("L1", "6COX"): ("complete", None), ("L1", "3KK6"): ("failed", "no Vina poses in log"),
        ("L_2", "6COX"): ("failed", "pose file too small (99 B)"),
        ("L_2", "3KK6"): ("failed", "pose file missing Vina markers"), ("x", "6COX"): ("orphaned", None),
    }
    per = tasks.roll_up(checked)
    assert {r.receptor_id: (r.total, r.complete, r.failed, r.orphaned, r.status) for r in per.collect()} == {
        "6COX": (2, 1, 1, 1, "PARTIAL"), "3KK6": (2, 0, 2, 0, "FAIL"),
    }
    assert tasks.overall_status(per).first().status == "FAIL"
    good = per.filter("status = 'PARTIAL'")
    assert tasks.overall_status(good).first().status == "PARTIAL"
    assert tasks.pending_tasks(grid, logs.filter("ligand_id = 'L1'"), poses).count() == 2
    assert tasks.pending_tasks(grid, logs, poses, force=True).count() == 4
    gone = tasks.missing_inputs(
        grid, ligands.filter("ID = 'L1'").withColumnRenamed("ID", "ligand_id"), spark.createDataFrame([("6COX",)], "receptor_id string")
    )
    assert {(r.task_id, r.reason) for r in gone.collect()} == {
        (2, "receptor file missing"), (3, "ligand file missing"), (4, "ligand file missing"),
    }
    with pytest.raises(ValueError):
        tasks.task_grid(ligands, [])
