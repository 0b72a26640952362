import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from screenfunnel.operators import expansion, pairing


def made_here():
    """Defined inside a function, so that it is sent to the workers by value."""

    def halves(a, b):
        """No product, one, several with repeats and failures, or an unreadable reactant."""
        if a == "bad":
            raise ValueError(a)
        return [None if x == "?" else f"{x}{b}" for x in a]

    return halves


halves = made_here()


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, "ab", "x"), (2, "aba", "x"), (3, "", "x"), (4, "bad", "x"), (5, None, "x"), (6, "a?b?", "y"), (7, "?", "y"), (8, "ab", "x")]
    return spark.createDataFrame(rows, "id int, a string, b string")


WANT = sorted([(1, "ax"), (1, "bx"), (2, "ax"), (2, "bx"), (6, "ay"), (6, "by"), (8, "ax"), (8, "bx")])


def test_both_forms_and_counts(spark, pairs):
    counts = Observation()
    made = expansion.expand(pairs, expansion.arrow_products(halves)(F.col("a"), F.col("b")), "product", counts)
    assert sorted((r.id, r["product"]) for r in made.collect()) == WANT
    assert counts.get == {"pairs": 8, "problematic": 2, "no_product": 2, "failed_products": 3, "products": 8}
    lateral = expansion.expand_lateral(pairs, expansion.product_table(halves), ["a", "b"], "product")
    assert lateral.columns == ["id", "a", "b", "product"] and sorted((r.id, r["product"]) for r in lateral.collect()) == WANT


def test_table_function_in_sql(spark, pairs):
    spark.udtf.register("halves", expansion.product_table(halves))
    pairs.createOrReplaceTempView("pairs_of_texts")
    rows = spark.sql("SELECT id, product, nth FROM pairs_of_texts, LATERAL halves(a, b) WHERE id = 2 ORDER BY nth").collect()
    assert [tuple(r) for r in rows] == [(2, "ax", 1), (2, "bx", 2)]


def test_plans_run_over_arrow_batches(pairs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan(expansion.expand(pairs, expansion.arrow_products(halves)(F.col("a"), F.col("b"))))
    lateral = plan(expansion.expand_lateral(pairs, expansion.product_table(halves), ["a", "b"]))
    assert "ArrowEvalPythonUDTF" in lateral and "Exchange" not in lateral


def test_an_unexpected_error_is_not_hidden(pairs):
    made = expansion.expand(pairs, expansion.arrow_products(lambda a, b: [a[9]])(F.col("a"), F.col("b")))
    with pytest.raises(Exception, match="IndexError"):
        made.count()


def test_reactions_in_a_pairing(spark):
    side = lambda p: spark.createDataFrame([(f"{p}{i}", t, float(i)) for i, t in enumerate(["ab", "?", "bad"])], "ID string, SMILES string, PriceMol double")
    counts = Observation()
    made = pairing.condense(side("A"), side("C"), 2.0, expansion.arrow_products(halves), counts=counts)
    assert sorted(tuple(r) for r in made.collect()) == [
        ("A0C0", "aab", 0.0), ("A0C0", "bab", 0.0), ("A0C1", "a?", 1.0), ("A0C1", "b?", 1.0), ("A0C2", "abad", 2.0), ("A0C2", "bbad", 2.0),
    ]
    assert counts.get == {"pairs": 6, "problematic": 1, "no_product": 2, "failed_products": 2, "products": 6}
    reagent = pairing.map_with_reagent(side("A"), 1.0, 5.0, expansion.arrow_products(lambda a: [a, a + "S"]))
    assert reagent.count() == 6
