"""Order statistics against their one-partition or in-memory counterparts, skew included."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenfunnel.operators import order


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value; some keys and values are null."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        value = 5.0 if rnd.random() < 0.34 else rnd.choice([None, round(rnd.uniform(-50, 50), 1)])
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, key string, value double").repartition(6).cache()


def test_running_sum_equals_window(skewed):
    rows = skewed.filter("value is not null")
    got = order.running_sum(rows, "value", "id", keys=["key"], ties=["id"], out="got")
    w = W.partitionBy("key").orderBy("value", "id").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("want", F.sum("id").over(w))
    joined = got.join(want, "id")
    assert joined.count() == rows.count()
    assert joined.filter("got <> want").count() == 0


def test_number_rows_is_dense(skewed):
    got = order.number_rows(skewed, "id", out="no").select("id", "no").collect()
    assert sorted((r.id, r.no) for r in got) == [(i, i + 1) for i in range(3000)]


def test_value_ranks(skewed):
    values = sorted(r.value for r in skewed.filter("value is not null").collect())
    for r in order.value_ranks(skewed, "value").collect():
        assert r.n == values.count(r.value)
        assert r.below == sum(v < r.value for v in values)


def test_group_quantiles_equal_percentile(skewed):
    got = order.group_quantiles(skewed, ["key"], "value", {"q10": 0.1, "median": 0.5, "q95": 0.95})
    want = skewed.groupBy("key").agg(
        F.count("value").alias("wn"),
        F.sum("value").alias("wt"),
        *[F.percentile("value", q).alias(f"w{i}") for i, q in enumerate((0.1, 0.5, 0.95))],
    )
    joined = order.null_safe_join(got, want, ["key"]).collect()
    assert len(joined) == 5
    for r in joined:
        assert (r.n, r.total) == (r.wn, pytest.approx(r.wt))
        assert (r.q10, r.median, r.q95) == pytest.approx((r.w0, r.w1, r.w2))


def test_quantile_of_a_single_row(spark):
    one = spark.createDataFrame([(3.5,)], "v double")
    r = order.group_quantiles(one, [], "v", {"q": 0.95}).first()
    assert (r.n, r.q) == (1, 3.5)


@pytest.mark.parametrize("k", [1, 7, 999, 1500, 2000, 3000])
def test_order_cutoff(skewed, monkeypatch, k):
    monkeypatch.setattr(order, "DIRECT_FETCH", 20)
    keys = [F.coalesce("value", F.lit(float("inf"))), F.col("id")]
    want = sorted((r.value if r.value is not None else float("inf"), r.id) for r in skewed.collect())[k - 1]
    got = order.order_cutoff(skewed, keys, k)
    assert got == want
    assert skewed.filter(order.up_to(keys, got)).count() == k


def test_order_cutoff_beyond_the_end(skewed):
    assert order.order_cutoff(skewed, [F.col("id")], 3001) is None
    assert order.order_cutoff(skewed, [F.col("id")], 0) is None


def test_lookup_salts_hot_values(skewed, monkeypatch):
    monkeypatch.setattr(order, "HOT_ROWS", 100)
    ranks = order.value_ranks(skewed, "value").withColumnsRenamed({"n": "_n", "below": "_below"})
    got = order.lookup_counted(skewed, ranks, "value", "id", 3000)
    assert got.count() == 3000
    plain = skewed.join(ranks, "value", "left")
    assert got.select("id", "_below").exceptAll(plain.select("id", "_below")).count() == 0


def test_no_window_without_partition_over_rows(skewed):
    """The only unpartitioned window runs over one line per band."""
    plan = order.number_rows(skewed, "id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_band" in line for line in windows)
