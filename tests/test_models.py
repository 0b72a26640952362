import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from screenfunnel.operators import forests, models, profile, stats
from screenfunnel.plans import library, presets, prioritise
from screenfunnel.operators.rules import Limit
from screenfunnel.operators.screen import Alert


def pandas_bins(values, n_bins=10, minimum=2):
    s = pd.Series(values)
    for k in range(min(n_bins, s.nunique()), 1, -1):
        cut = pd.cut(s, bins=np.linspace(s.min(), s.max(), k + 1), include_lowest=True)
        if cut.value_counts().min() >= minimum:
            return k, sorted(cut.value_counts().tolist())
    return None


@pytest.mark.parametrize("seed", range(6))
def test_stratify_bins_equals_pandas(spark, seed):
    rnd = random.Random(seed)
    values = [round(rnd.gauss(5, 1 + seed), 2) for _ in range(60)] + [5.0] * 40
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v double")
    want = pandas_bins(values)
    if want is None:
        with pytest.raises(ValueError):
            stats.stratify_bins(df, "v")
        return
    counts = stats.stratify_bins(df, "v").groupBy("stratum").count().collect()
    found = [r["count"] for r in counts if r.stratum is not None]
    assert (len(found), sorted(found)) == want
    assert [r["count"] for r in counts if r.stratum is None] == [1]


def test_stratify_bins_errors(spark):
    with pytest.raises(ValueError):
        stats.stratify_bins(spark.createDataFrame([(None,)], "v double"), "v")
    with pytest.raises(ValueError):
        stats.stratify_bins(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v")


def test_split_keeps_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(2).alias("stratum"))
    split = stats.stratified_split(df, "stratum", "id", 0.2).cache()
    got = {(r.stratum, r.is_test): r["count"] for r in split.groupBy("stratum", "is_test").count().collect()}
    assert got == {(1, True): 140, (1, False): 560, (2, True): 60, (2, False): 240}
    again = stats.stratified_split(df.repartition(7), "stratum", "id", 0.2)
    assert again.filter("is_test").select("id").exceptAll(split.filter("is_test").select("id")).count() == 0


def test_domain_equals_numpy(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 3)) * [1, 10, 100]
    x[:, 2] = 7.0  # constant column
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    domain = stats.fit_domain(df, ["a", "b", "c"])
    std = x.std(axis=0)
    std[std == 0] = 1
    z = (x - x.mean(axis=0)) / std
    d = np.linalg.norm(z - z.mean(axis=0), axis=1)
    assert domain.cutoff == pytest.approx(np.quantile(d, 0.95))
    rows = domain.transform(df).collect()
    assert np.allclose(sorted(r.AD_Distance for r in rows), sorted(d))
    assert sum(r.In_AD for r in rows) == (d <= np.quantile(d, 0.95)).sum()


@pytest.fixture(scope="module")
def assays(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(240):
        f = [rnd.uniform(0, 10) for _ in range(3)]
        rows.append((f"M{i}", *f, 10 ** (f[0] / 2), 10 ** (f[1] / 2) if i % 4 else None))
    rows += [("bad", None, 1.0, 1.0, 10.0, 10.0), ("zero", 1.0, 1.0, 1.0, 0.0, -1.0)]
    return spark.createDataFrame(rows, "ChEMBL_ID string, a double, b double, c double, IC50_COX2_median double, IC50_COX1_median double").cache()


def test_targets(assays):
    got = {r.ChEMBL_ID: r for r in models.add_targets(assays).filter("ChEMBL_ID in ('zero', 'M0')").collect()}
    assert (got["zero"].pIC50_COX2, got["zero"].pIC50_COX1, got["zero"].active_COX2) == (None, None, True)
    assert got["M0"].pIC50_COX1 is None


def test_fit_score_save_load(spark, assays, tmp_path):
    profile.observed(spark.range(1), {"any": F.col("id") >= 0}, "before")[0].count()
    fitted = models.fit_activity_models(models.add_targets(assays), ("a", "b", "c"), trees=8, depth=6, lot=3)
    assert [m.getNumTrees for m in fitted.target.lots] == [3, 3, 2] and not any(m.hasSummary for m in fitted.target_class.lots)
    assert fitted.metrics["r2"] > 0.5 and fitted.metrics["accuracy"] > 0.8
    scored = models.score_activity(assays, fitted).cache()
    assert scored.count() == 241  # the row without a descriptor is dropped
    wrong = scored.filter(
        "abs(QSAR_score - (2 * pIC50_COX2_pred - pIC50_COX1_pred)) > 1e-9 or abs(log10(IC50_COX2_pred_nM) - 9 + pIC50_COX2_pred) > 1e-9"
        " or abs(SI_pred - IC50_COX1_pred_nM / IC50_COX2_pred_nM) > 1e-6 * SI_pred"
    )
    assert wrong.count() == 0
    fitted.save(spark, str(tmp_path / "m"))
    again = models.score_activity(assays, models.ActivityModels.load(spark, str(tmp_path / "m")))
    assert again.select("ChEMBL_ID", "QSAR_score", "In_AD").exceptAll(scored.select("ChEMBL_ID", "QSAR_score", "In_AD")).count() == 0
    accepted, rejected = prioritise.qsar_winnow(assays, fitted, str(tmp_path / "w"), "ChEMBL_ID", 0.1, 5)
    assert (accepted.count(), rejected.count()) == (24, 217)
    assert accepted.agg(F.min("QSAR_score")).first()[0] >= rejected.agg(F.max("QSAR_score")).first()[0]


def test_lots_predict_as_one_forest(spark, assays, tmp_path):
    """Mean and votes over all trees; a cut-off run goes on with the lot that is missing, other rows start anew."""
    rows = models.add_targets(assays).withColumn("kind", F.floor(F.col("a") / 3.4))
    shape = {"trees": 7, "depth": 4, "lot": 3, "store": str(tmp_path)}
    forest = forests.fit_forest(rows, ("a", "b", "c"), "pIC50_COX2", **shape)
    votes = forests.fit_forest(rows, ("a", "b", "c"), "kind", True, **shape)
    usable = rows.dropna(subset=["a", "b", "c"])
    got = {r.ChEMBL_ID: r for r in votes.transform(forest.transform(usable, "mean"), "voted").collect()}
    for i in ("M0", "M7", "M100"):
        r = got[i]
        x = Vectors.dense(r.a, r.b, r.c)
        assert r["mean"] == pytest.approx(np.mean([t.predict(x) for m in forest.lots for t in m.trees]))
        raw = sum(m.predictRaw(x).toArray() for m in votes.lots)
        assert r.voted == int(np.argmax(raw)) and raw.sum() == pytest.approx(7)
    assert forest.trees == 7 and forest.join(forest).trees == 14
    with pytest.raises(ValueError):
        forest.join(votes)

    lots = sorted(p for p in tmp_path.glob("*/lot-*"))
    assert len(lots) == 6
    first = sorted(lots[0].parent.glob("lot-*"))
    kept = [(p / "manifest").stat().st_mtime_ns for p in first]
    (first[1] / "manifest").rename(tmp_path / "lost")
    again = forests.fit_forest(rows, ("a", "b", "c"), *(("kind", True) if "classification" in str(next((first[0] / "trees").glob("metadata/part*")).read_text()) else ("pIC50_COX2",)), **shape)
    now = [(p / "manifest").stat().st_mtime_ns for p in first]
    assert now[0] == kept[0] and now[2] == kept[2] and now[1] != kept[1]
    before = votes if again.classifies else forest
    same = before.transform(again.transform(usable, "x"), "y")
    assert same.filter("x <> y").count() == 0
    forests.fit_forest(rows.filter("a > 1"), ("a", "b", "c"), "pIC50_COX2", **shape)
    assert len(list(tmp_path.glob("*/lot-*"))) == 9


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(90):
        g = i % 3
        rows.append((f"m{i}", "C" * (i + 1), *[g * 10 + rnd.random() for _ in range(4)], rnd.random(), float(i)))
    return spark.createDataFrame(rows, "ID string, SMILES string, f1 double, f2 double, f3 double, f4 double, QED double, PriceMol double").cache()


@pytest.mark.parametrize("k", [3, None])
def test_clusters(blobs, k):
    out = models.cluster(blobs, "ID", ["f1", "f2", "f3", "f4"], k=k, candidates=(2, 3, 5)).cache()
    assert out.count() == 90
    groups = {}
    for r in out.collect():
        groups.setdefault(r.Cluster, set()).add(int(r.ID[1:]) % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]
    assert out.filter("`Point selected` = 1").count() == 3
    nearest = out.groupBy("Cluster").agg(F.min("CentroidDistance").alias("m"))
    assert out.join(nearest, "Cluster").filter("`Point selected` = 1 and CentroidDistance > m").count() == 0
    assert {"PC1", "PC2", "PC3"} <= set(out.columns)


def test_shortlist_bundle(spark, blobs, tmp_path):
    from screenfunnel.sources.sinks import read_manifest

    other = blobs.filter("PriceMol < 60")
    found = prioritise.shortlist_series({"one": blobs, "two": other}, str(tmp_path), {"one": 3, "two": 3})
    assert found["one"].shortlist.count() == 9 and found["one"].representatives.count() == 3
    meta = read_manifest(spark, f"{tmp_path}/one/metadata")
    assert (meta["n_rows"], meta["n_clusters"], meta["top_n"]) == (90, 3, 3)
    samples = spark.read.parquet(f"{tmp_path}/one/samples/data")
    assert "Cluster" not in samples.columns and "PC1" not in samples.columns and samples.count() == 3
    with pytest.raises(ValueError, match="identical"):
        prioritise.shortlist_series({"one": blobs, "two": blobs}, str(tmp_path / "x"))


def test_validate_features(spark, blobs):
    good, repeats = profile.validate_features(blobs, "ID", "SMILES", ["SMILES"])
    assert (good, repeats) == (["f1", "f2", "f3", "f4", "QED", "PriceMol"], 0)
    assert profile.validate_features(blobs.union(blobs.limit(4)), "ID", "SMILES", ["SMILES"])[1] == 4
    for bad in (blobs.withColumn("batch", F.lit(1)), blobs.select("ID", "SMILES", "f1"), blobs.drop("SMILES")):
        with pytest.raises(ValueError):
            profile.validate_features(bad, "ID", "SMILES", ["SMILES"])


def test_histogram_equals_numpy(spark):
    rnd = np.random.default_rng(3)
    v = rnd.uniform(0, 1, 500)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "QED double")
    got = {r.bin: r.n for r in profile.histogram({"all": df}, "QED", 50).collect()}
    want = np.histogram(v, 50)[0]
    assert [got.get(i, 0) for i in range(50)] == want.tolist()
    same = spark.createDataFrame([(0.5,), (0.5,)], "QED double")
    assert sum(r.n for r in profile.histogram({"a": same, "b": df}, "QED").collect()) == 502


def test_fingerprint_is_order_free(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    assert profile.fingerprint(df).first() == profile.fingerprint(df.orderBy(F.rand())).first()
    assert profile.fingerprint(df).first() != profile.fingerprint(df.withColumn("t", F.lit("x"))).first()


def test_observed_counters(spark):
    df, watch = profile.observed(spark.range(10), {"big": F.col("id") > 6}, "w")
    assert df.count() == 10
    assert watch.get == {"n_rows": 10, "big": 3}


def blocks(spark, letter, n, prices):
    rows = [(f"{letter}{i + 1}", f"{letter.lower()}{i % 5}", prices[i % len(prices)]) for i in range(n)]
    return spark.createDataFrame(rows, "ID string, SMILES string, PriceMol double")


@pytest.mark.parametrize("stored", [False, True])
def test_library_equals_loops(spark, tmp_path, stored):
    a, c, n = blocks(spark, "A", 12, [20.0, 90.0, 150.0]), blocks(spark, "C", 10, [15.0, 60.0]), blocks(spark, "N", 8, [10.0, 30.0, 120.0])
    plan = library.LibraryPlan(
        condensation=lambda x, y: F.array(F.concat(x, F.lit("."), y)),
        aminolysis=lambda x, y: F.array(F.concat(x, F.lit("-"), y)),
        sulphur_exchange=lambda x: F.array(F.concat(x, F.lit("=S"))),
        describe=lambda df: df.withColumn("size", F.length("SMILES")),
        cap=200.0,
        oxazolone_limits=[Limit("PriceMol", ">", 170.0, 2)],
        product_limits=[Limit("size", ">", 9)],
        catalogue=[Alert(1, "Brenk", "a1", "a1"), Alert(2, "PAINS(a)", "c2", "c2")],
    )
    out = library.run_library(plan, a, c, n, str(tmp_path) if stored else None)

    def cheapest(rows):
        best = {}
        for i, s, p in rows:
            if s not in best or (p, i) < best[s]:
                best[s] = (p, i)
        return {(i, s, p) for s, (p, i) in best.items()}

    A, C, N = ([tuple(r) for r in x.collect()] for x in (a, c, n))
    ox = cheapest((i + j, f"{s}.{t}", p + q) for i, s, p in A for j, t, q in C if p + q <= 200)
    assert {tuple(r) for r in out["oxazolones_raw"].collect()} == ox
    kept = [r for r in ox if r[2] <= 170]
    im = cheapest((i + j, f"{s}-{t}", p + q) for i, s, p in kept for j, t, q in N if q <= 200 - p)
    th = cheapest((i + "S", s + "=S", p + 10) for i, s, p in kept if p + 10 <= 200)
    for name, rows in (("imidazolones", im), ("thiazolones", th)):
        want = {r for r in rows if len(r[1]) <= 9 and "a1" not in r[1] and "c2" not in r[1]}
        assert {(r.ID, r.SMILES, r.PriceMol) for r in out[name].collect()} == want
        alerts = {(r.ID, r.MatchAlert) for r in out[f"{name}_rejected_alert"].collect()}
        assert alerts == {
            (r[0], "Brenk" if "a1" in r[1] else "PAINS(a)") for r in rows if len(r[1]) <= 9 and ("a1" in r[1] or "c2" in r[1])
        }
    assert out["oxazolones_rejected"].count() == len(ox) - len(kept)


def test_priced_blocks(spark):
    offers = spark.createDataFrame([("E1", 0, 10.0, 2.0), ("E2", 0, 10.0, 2.0)], "code string, pack_no int, price double, price_per_gram double")
    rows = spark.createDataFrame([("A1", "E1", "x", 80.0), ("A2", "E2", "y", 150.0), ("A3", "E3", "z", 1.0)], "ID string, Catalog_ID string, SMILES string, MW double")
    accepted, rejected = library.priced_blocks(rows, offers, presets.column_limits({"PriceMol": (None, 200.0)}))
    assert [(r.ID, r.PriceMol) for r in accepted.collect()] == [("A1", 160.0)]
    assert [(r.ID, r.Rejection) for r in rejected.collect()] == [("A2", "PriceMol=300.00>200.0")]


def test_the_split_is_made_once(spark, monkeypatch):
    """Forests, domain and metrics read one kept split, which is given back."""
    rows = spark.range(300).selectExpr("id", "double(id % 17) AS a", "double(id % 5) AS b", "double(50 + id * 7 % 400) AS IC50_COX2_median", "double(9 + id % 90) AS IC50_COX1_median")
    seen, domain = [], models.fit_domain

    def watched(df, columns):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return domain(df, columns)

    monkeypatch.setattr(models, "fit_domain", watched)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    fitted = models.fit_activity_models(models.add_targets(rows), ("a", "b"), "id", trees=2, depth=2, lot=2)
    assert len(seen) == 1 and "InMemoryRelation" in seen[0] and "sha2" not in seen[0].split("InMemoryRelation")[0]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    assert fitted.metrics["n_rows"] == 60
