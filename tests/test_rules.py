import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from screenfunnel.functions import scalars as fn
from screenfunnel.operators import dedupe, offers, rules, screen
from screenfunnel.operators.rules import Limit
from screenfunnel.operators.screen import Alert
from screenfunnel.plans import presets

NAN = float("nan")


def test_range_filter_missing_values_pass(spark):
    df = spark.createDataFrame(
        [("ok", 90.0, 3.0), ("high", 151.25, 3.125), ("nan", NAN, 1.0), ("null", None, 5.005)],
        "ID string, tPSA double, LogP double",
    ).withColumns({"RotB": F.lit(10), "SMILES": F.lit("x"), "PriceMol": F.lit(1.0)})
    accepted, rejected = rules.range_filter(df, presets.column_limits({"tPSA": (None, 90), "RotB": (None, 10), "LogP": (None, 3)}), rejected_columns=presets.REJECTED_COLUMNS)
    assert {r.ID for r in accepted.collect()} == {"ok", "nan"}
    assert {r.ID: r.Rejection for r in rejected.collect()} == {
        "high": "tPSA=151.2>90; LogP=3.12>3",
        "null": f"LogP={5.005:.2f}>3",
    }
    assert rejected.columns == ["ID", "SMILES", "PriceMol", "tPSA", "RotB", "LogP", "Rejection"]


def test_range_filter_bounds(spark):
    """Inclusive, but carbon and heteroatom minima must be exceeded."""
    df = spark.createDataFrame([(5, 2, 200.0), (6, 3, 200.01)], "CAtm int, HetAtm int, PriceMol double")
    limits = presets.column_limits({"CAtm": (5, None), "HetAtm": (2, None), "PriceMol": (None, 200.0)})
    _, rejected = rules.range_filter(df, limits)
    assert sorted(r.Rejection for r in rejected.collect()) == ["CAtm=5<=5; HetAtm=2<=2", "PriceMol=200.01>200.0"]


def test_every_limit_is_reported_in_order():
    limits = presets.column_limits(
        {
            "HetAtm": (15, None), "CAtm": (14, None), "PriceMol": (None, 16), "Rings": (None, 13), "HvyAtm": (10, 11), "MR": (8, 9),
            "HBA": (None, 7), "HBD": (None, 6), "MW": (None, 5), "LogP": (12, 3), "RotB": (None, 2), "tPSA": (4, 1),
        }
    )
    assert [(x.column, x.op, x.bound) for x in limits] == [
        ("tPSA", ">", 1), ("tPSA", "<", 4), ("RotB", ">", 2), ("LogP", ">", 3), ("LogP", "<", 12), ("MW", ">", 5),
        ("HBD", ">", 6), ("HBA", ">", 7), ("MR", "<", 8), ("MR", ">", 9), ("HvyAtm", "<", 10), ("HvyAtm", ">", 11),
        ("Rings", ">", 13), ("PriceMol", ">", 16), ("CAtm", "<=", 14), ("HetAtm", "<=", 15),
    ]


def test_class_limits_are_known_columns():
    assert [x.column for x in presets.class_limits("acids")] == ["tPSA", "RotB", "LogP", "MW", "HBD", "HBA"]
    with pytest.raises(ValueError):
        presets.column_limits({"colour": (1, 2)})


def test_accepted_and_rejected_are_the_input(spark):
    rnd = random.Random(1)
    pick = lambda: rnd.choice([None, NAN, rnd.uniform(0, 10)])
    df = spark.createDataFrame([(i, pick(), pick()) for i in range(300)], "id long, a double, b double")
    accepted, rejected = rules.range_filter(df, [Limit("a", ">", 5.0, 1), Limit("b", "<", 4.0, 1)])
    ids = sorted(r.id for r in accepted.collect()) + sorted(r.id for r in rejected.collect())
    assert sorted(ids) == list(range(300))


def test_fixed_formats_like_c(spark):
    rnd = random.Random(5)
    values = [0.125, 2.675, 0.375, 1.005, -0.05, 0.0, -0.0, 99.995, 1e6 + 0.005, 0.045, 1234.35, 151.25]
    values += [rnd.uniform(-1000, 1000) for _ in range(2000)]
    values += [round(rnd.uniform(0, 100), 3) for _ in range(2000)] + [i / 16 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = df.select("v", fn.fixed("v", digits).alias("s")).collect()
        assert [(r.v, r.s) for r in got if r.s != f"{r.v:.{digits}f}"] == []


# Published descriptor rows (fixed values) with their violations.
SAMPLES = [
    ("A40C14S", 406.463, 4.3217, 0, 7, 114.953, 29, 70.01, 5, 22, 7, 4, "Lipinski"),
    ("A60C24S", 392.249, 4.6579, 0, 4, 94.206, 23, 38.66, 3, 17, 6, 3, "Lipinski"),
]


def test_rule_sets(spark):
    columns = "ID MW LogP HBD HBA MR Atoms tPSA RotB CAtm HetAtm Rings want".split()
    fine = ("fine", 300.0, 2.0, 1, 3, 80.0, 25, 60.0, 3, 15, 4, 2, "none")
    missing = ("missing", None, 2.0, 1, 3, 80.0, 25, 60.0, 3, 15, 4, 2, "Lipinski, Ghose, Muegge")
    wide = ("wide", 300.0, 2.0, 1, 3, 80.0, 25, 145.0, 3, 15, 4, 2, "Egan, Veber")
    df = spark.createDataFrame([*SAMPLES, fine, missing, wide], columns).withColumn("QED", F.lit(0.5))
    accepted, rejected = rules.rule_set_filter(df, presets.drug_likeness_rules(), after="QED")
    assert accepted.columns[accepted.columns.index("QED") + 1] == "Violation"
    assert {r.ID for r in accepted.collect()} == {"A40C14S", "A60C24S", "fine"}
    assert all(r.Violation == r.want for r in accepted.unionByName(rejected).collect())


def test_derived_limits(spark):
    """Product limit 140 with a change of −15.71: partner minima 37.30 and 17.07 give the preset limits."""
    for partner, want in ((37.30, 118.41), (17.07, 138.64)):
        df = spark.createDataFrame([(partner,), (partner + 9,), (None,)], "tPSA double")
        found = rules.derive_limits({"tPSA": 140.0}, presets.REACTION_DELTAS["condensation"], df)
        assert found["tPSA"] == pytest.approx(want)


def test_clean_key(spark):
    df = spark.createDataFrame([(" a ",), ("",), (None,), ("  ",), ("bad",)], "Smiles string")
    watch = Observation("clean")
    cleaned = rules.clean_key(df, ["SMILES!", "Smiles"], "SMILES", lambda s: s != "bad", watch)
    assert [tuple(r) for r in cleaned.collect()] == [("a",)]
    assert watch.get == {"n_rows": 5, "n_missing": 1, "n_blank": 2, "n_invalid": 1, "n_kept": 1}
    with pytest.raises(ValueError):
        rules.clean_key(df, ["no"], "SMILES")


def test_alert_screen_first_match_wins(spark):
    catalogue = [
        Alert(2, "PAINS(a)", "late", "a"), Alert(1, "Brenk", "second", "b"), Alert(1, "Brenk", "third", "c"),
    ]
    df = spark.createDataFrame([("abc",), ("acb",), ("a",), ("z",), (None,), ("!",)], "t string")
    accepted, rejected = screen.alert_screen(df, "t", catalogue, valid=lambda t: t != "!")
    assert [r.t for r in accepted.collect()] == ["z"]
    assert {r.t: (r.MatchAlert, r.Substructure) for r in rejected.collect()} == {
        "abc": ("Brenk", "second"), "acb": ("Brenk", "second"), "a": ("PAINS(a)", "late"),
        None: ("invalid_smiles", ""), "!": ("invalid_smiles", ""),
    }


def test_alert_screen_with_a_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("boolean")
    def has(text: pd.Series, what: pd.Series) -> pd.Series:
        return pd.Series([w in t for t, w in zip(text, what)])

    df = spark.createDataFrame([("abc",), ("xyz",)], "t string")
    accepted, rejected = screen.alert_screen(
        df, "t", [Alert(1, "f", "n", "ab")], match=lambda t, a: has(t, F.lit(a.pattern))
    )
    assert (accepted.count(), rejected.count()) == (1, 1)


def test_best_offer_cases(spark):
    rows = [
        ("none over pack", 0, 300.0, 1.0), ("dear per gram", 0, 41.0, 41.0), ("tie", 1, 20.0, 2.0), ("tie", 0, 10.0, 2.0),
        ("mixed", 0, 250.0, 1.0), ("mixed", 1, 251.0, 0.5),
    ]
    df = spark.createDataFrame(rows, "code string, pack_no int, price double, price_per_gram double")
    best = {r.code: r.price for r in offers.best_offer(df).collect()}
    assert best == {"tie": 10.0, "mixed": 250.0}


def test_attach_price_drops_unpriced(spark):
    best = spark.createDataFrame([("c1", 2.0), ("c2", 0.0)], "code string, price_per_gram double")
    df = spark.createDataFrame([("c1", 100.0), ("c2", 50.0), ("c3", 50.0)], "Catalog_ID string, MW double")
    assert [tuple(r) for r in offers.attach_price(df, best).collect()] == [("c1", 100.0, 2.0, 200.0)]
    assert offers.attach_price(df, best, keep_unpriced=True).count() == 3


def test_cheapest_missing_price_is_last(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", NAN, 2), ("x", 7.0, 3), ("y", None, 5), ("y", None, 4)], "k string, p double, id int")
    got = {r.k: r.id for r in dedupe.cheapest_per_key(df, "k", "p", "id").collect()}
    assert got == {"x": 3, "y": 4}


def test_unique_names(spark):
    df = spark.createDataFrame([("a b", "C", 1), ("a b", "C", 2), ("", "C", 3), ("", "D", 4)], "id string, s string, no int")
    out = dedupe.unique_names(df.withColumn("unique_id", F.lit(0)), "id", "s", "no")
    got = {r.no: r.unique_id_1 for r in out.collect()}
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:12]
    assert got == {1: f"a_b__{h('a b|C')}", 2: f"a_b__{h('a b|C')}__d1", 3: f"MOL__{h('MOL|C')}", 4: f"MOL__{h('MOL|D')}"}
    single = dedupe.unique_names(df.filter("no = 1"), "id", "s", "no").first()
    assert single.unique_id == "a b"


def test_scalars(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,), (None,)], "v double")
    rows = df.select(
        fn.pic50("v").alias("p"), fn.active("v").alias("a"), fn.selectivity(F.lit(2.0), "v").alias("s"),
        fn.ic50_nm(F.lit(6.0)).alias("nm"),
    ).collect()
    assert [r.p for r in rows] == [pytest.approx(6.0), None, None]
    assert [r.a for r in rows] == [True, True, None]
    assert [r.s for r in rows] == [0.002, None, None]
    assert rows[0].nm == pytest.approx(1000.0)
    ids = spark.range(1).select(
        fn.pair_id(F.lit("A12"), F.lit("C3")).alias("pair"), fn.extend_id(F.lit("A12C3"), F.lit("N7")).alias("triple"),
        fn.suffix_id(F.lit("A12C3")).alias("s"), fn.id_head(F.lit("A12C3")).alias("head"),
        fn.id_without_tail(F.lit("A12C3N7")).alias("ox"), fn.id_without_suffix(F.lit("A12C3S")).alias("ox2"),
        fn.content_key(F.lit("a"), F.lit("b")).alias("key"),
    ).first()
    assert tuple(ids)[:6] == ("A12C3", "A12C3N7", "A12C3S", "A12", "A12C3", "A12C3")
    import hashlib

    assert ids.key == hashlib.sha256(b"a|b").hexdigest()[:16]
