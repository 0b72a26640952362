"""One tagged pass: decisions evaluated once, written once, counted on the way."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from screenfunnel.operators import rules, screen
from screenfunnel.operators.expansion import arrow_products
from screenfunnel.operators.rules import Limit
from screenfunnel.operators.screen import Alert
from screenfunnel.plans import library
from screenfunnel.sources import sinks

CATALOGUE = [Alert(2, "B", "second", "x"), Alert(1, "A", "first", "xy")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(1, "ab", 1.0), (2, "xy", 1.0), (3, "ax", 2.0), (4, None, 1.0), (5, "xy", 9.0), (6, "ab", None), (7, "ab", 5.0), (7, "ab", 5.0)]
    path = str(tmp_path_factory.mktemp("in") / "rows")
    spark.createDataFrame(rows, "id int, text string, v double").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_equal_the_filters(spark, stored, tmp_path):
    limits = [Limit("v", ">", 4.0)]
    decided = screen.decide(stored, limits, "text", CATALOGUE)
    assert plan(decided).count("FileScan") == 1 and plan(decided).count("RLIKE") <= 2
    counts = sinks.write_decided(decided, str(tmp_path / "d"), ("accepted", "range", "alert"))
    assert counts == {"accepted": 2, "range": 3, "alert": 3}
    read = spark.read.parquet(str(tmp_path / "d"))
    for side, want in zip(screen.sides(read), screen.filter_and_screen(stored, limits, "text", CATALOGUE)):
        assert side.columns == want.columns and sorted(map(str, side.collect())) == sorted(map(str, want.collect()))
        assert "PartitionFilters: [isnotnull(decision" in plan(side)
    none = screen.decide(stored.limit(0), limits, "text", CATALOGUE)
    assert sinks.write_decided(none, str(tmp_path / "n"), ("accepted", "range")) == {"accepted": 0, "range": 0}


def test_rule_sets_in_one_pass(stored):
    named = {"Small": F.col("v") < 4, "Letters": ~F.col("text").contains("x"), "Id": F.col("id") < 6}
    tagged = rules.tag_rule_set(stored, named)
    assert plan(tagged).count("FileScan") == 1
    got = {r.id: (r.Violation, r.decision) for r in tagged.collect()}
    assert got == {
        1: ("none", "accepted"), 2: ("Letters", "accepted"), 3: ("Letters", "accepted"), 4: ("Letters", "accepted"),
        5: ("Small, Letters", "rejected"), 6: ("Small, Id", "rejected"), 7: ("Small, Id", "rejected"),
    }
    accepted, rejected = rules.rule_set_filter(stored, named, after="id")
    assert accepted.columns == ["id", "Violation", "text", "v"] and (accepted.count(), rejected.count()) == (4, 4)


def test_counts_come_with_the_write(spark, stored, tmp_path):
    store, made = str(tmp_path), []

    def compute(watch):
        made.append(1)
        return stored.observe(watch, F.count_if(F.col("v") > 1).alias("above")).filter("v is not null")

    for _ in range(2):
        watch = Observation()
        df = sinks.materialise(spark, f"{store}/s", {"a": 1}, lambda w=watch: compute(w), watch=watch)
    assert df.count() == 7 and made == [1]
    counts = {(r.stage, r.counter): r.n for r in sinks.stage_counts(spark, store, ["s", "missing"]).collect()}
    assert counts == {("s", "above"): 4, ("s", "rows"): 7}


def test_decided_table_without_rows(spark, stored, tmp_path):
    for _ in range(2):
        read = sinks.materialise_decided(
            spark, str(tmp_path), {"a": 1}, lambda: screen.decide(stored.limit(0), [Limit("v", ">", 4.0)], "text", CATALOGUE), ("accepted", "range", "alert")
        )
        assert [side.count() for side in screen.sides(read)] == [0, 0, 0] and screen.sides(read)[0].columns == stored.columns
    counts = {r.counter: r.n for r in sinks.stage_counts(spark, str(tmp_path.parent), [tmp_path.name]).collect()}
    assert counts == {"accepted": 0, "range": 0, "alert": 0}


def test_library_counts_and_derived_limits(spark, tmp_path):
    side = lambda p, rows: spark.createDataFrame([(f"{p}{i}", t, float(v)) for i, (t, v) in enumerate(rows)], "ID string, SMILES string, PriceMol double")
    a, c, n = side("A", [("a", 1), ("b", 2), ("c", 60)]), side("C", [("x", 5), ("q", 6)]), side("N", [("n", 3)])

    def react(x, y):
        if "q" in y:
            raise ValueError(y)
        return [] if x == "b" else [x + y, x + y, None, f"{x}!{y}"]

    plan_ = library.LibraryPlan(
        arrow_products(react), arrow_products(lambda x, y: [f"{x}-{y}"]), arrow_products(lambda x: [f"{x}S"]), lambda df: df, cap=100.0,
        oxazolone_limits=[Limit("PriceMol", ">", 50.0)], product_limits=[Limit("PriceMol", ">", 40.0)], catalogue=[Alert(1, "A", "bang", "!")],
        condensation_deltas={"PriceMol": 0.0},
    )
    out = library.run_library(plan_, a, c, n, str(tmp_path))
    assert [r.ID for r in out["aldehydes_rejected"].collect()] == ["A2"] and out["acids_rejected"].count() == 0
    counts = {}
    for r in library.library_counts(spark, str(tmp_path)).collect():
        counts.setdefault(r.stage, {})[r.counter] = r.n
    assert counts["oxazolones_raw"] == {"pairs": 4, "problematic": 2, "no_product": 1, "failed_products": 1, "products": 2, "rows": 2}
    assert counts["oxazolones"] == {"accepted": 2, "range": 0, "alert": 0}
    assert counts["imidazolones"] == {"accepted": 1, "range": 0, "alert": 1} == counts["thiazolones"]
    assert out["imidazolones_rejected_alert"].count() == 1 and {r.SMILES for r in out["imidazolones"].collect()} == {"ax-n"}
