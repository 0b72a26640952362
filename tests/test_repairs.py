"""Faults that came to light in review: each test fails on the earlier code."""

import pytest
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number
from screenfunnel.operators import poses, profile, ranking, stats
from screenfunnel.sources import files, sinks

MOL = "{name}\n  made\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\nM  END\n>  <Catalog_ID>\n{name}\n\n$$$$\n"


def test_sdf_lines_may_end_in_two_ways(spark, tmp_path):
    for name, end, ids in (("z", "\r\n", ["C1", "C2", "C3", "C4", "C5"]), ("a", "\n", ["C6", "C7"])):
        text = "".join(MOL.format(name=i) for i in ids).replace(f"{ids[0]}\n  made", "\n  made")
        (tmp_path / f"{name}.sdf").write_bytes(text.replace("\n", end).encode())
    rows = files.scan_sdf(spark, str(tmp_path), "A").orderBy("ID").collect()
    # numbers follow the names of the files, not the order in which they are read
    assert [(r["ID"], r["Catalog_ID"]) for r in rows] == [(f"A{k + 1}", c) for k, c in enumerate(["C6", "C7", "C1", "C2", "C3", "C4", "C5"])]
    assert all(r["CAtm"] == 1 and "\r" not in r["mol_block"] for r in rows)


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(k % 7 if k % 5 else None, float(k % 4) if k % 3 else None) for k in range(60)]
    return spark.createDataFrame(rows, "id int, score double").cache()


def test_winnow_loses_no_row(holes):
    for rate in (0.0, 0.1, 0.5, 1.0):
        a, r = ranking.winnow(holes, "score", "id", rate, 1)
        assert a.count() + r.count() == 60 and a.count() >= 1
        assert a.unionByName(r).exceptAll(holes).isEmpty()


def test_cascade_keeps_what_was_asked(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 1.0), ("b", 1.0), (None, 2.0), ("c", 2.0)], "id string, price double")
    for n, ids in ((1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", None])):
        a, r = ranking.budget_cascade(df, "price", "id", max_rows=n)
        assert a.count() + r.count() == 5
        assert sorted((x["id"] for x in a.collect()), key=lambda i: (i is None, i)) == ids


def test_stage_that_was_cut_off_is_made_again(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert sinks.materialise(spark, path, {"v": "a"}, lambda: spark.range(3)).count() == 3
    broken = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error("cut off").cast("long")).alias("id"))
    with pytest.raises(Exception, match="cut off"):
        sinks.materialise(spark, path, {"v": "b"}, lambda: broken)
    assert sinks.materialise(spark, path, {"v": "a"}, lambda: spark.range(3)).count() == 3


def test_missing_stratum_is_split_too(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "x").alias("s"))
    got = {r["s"]: r["n"] for r in stats.stratified_split(df, "s", "id").filter("is_test").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"x": 100, None: 100}


def test_fingerprint_tells_bars_apart(spark):
    a = spark.createDataFrame([("a|b", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert profile.fingerprint(a).first()["md5_sum"] != profile.fingerprint(b).first()["md5_sum"]


def test_type_letters_are_no_numbers(spark):
    rows = [("1",), ("1d",), ("1.5f",), ("2e3",), ("inf",), ("x",), (" 7 ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(number("t")).collect()]
    assert got == [1.0, None, None, 2000.0, float("inf"), None, 7.0]


def test_first_value_needs_an_order(spark):
    df = spark.createDataFrame([("l", "A", 3.0, 2), ("l", "A", 5.0, 1), ("l", "B", 1.0, 1)], "k string, c string, v double, o int")
    assert poses.pivot_scores(df, "k", "c", "v", ["A", "B"], "first", order="o").first()["score_a"] == 5.0
    with pytest.raises(ValueError):
        poses.pivot_scores(df, "k", "c", "v", ["A", "B"], "first")
