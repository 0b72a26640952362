"""Several products per pair: reactions in Python, run over Arrow batches or as a table function.

A reaction takes the texts of one pair (or row) and gives its products in order; ``None`` among them is a product that could
not be made, and ``ValueError`` says that a reactant cannot be read. Both forms below give the same rows: the array form
(:func:`arrow_products`) runs a batch at a time and suits the large pairings, the table function (:func:`product_table`) is for
lateral joins, in SQL too. Products are distinct per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Reaction = Callable[..., Iterable[str | None]]


def run_reaction(reaction: Reaction, reactants: tuple[str | None, ...]) -> list[str | None] | None:
    """All products of one pair, repeats and failures included; None if a reactant is missing or cannot be read."""
    if any(r is None for r in reactants):
        return None
    try:
        return list(reaction(*reactants))
    except ValueError:
        return None


def arrow_products(reaction: Reaction) -> Callable[..., Column]:
    """A column builder for ``product=``: from the reactants' columns to an array of texts.

    One Arrow batch is handed over at a time; pairs that repeat in a batch are made once. Null: a reactant could not be read;
    a null item: a product could not be made.
    """

    def rows(*columns: pa.Array) -> pa.Array:
        made: dict[tuple[str | None, ...], list[str | None] | None] = {}
        out = []
        for pair in zip(*(c.to_pylist() for c in columns), strict=True):
            if pair not in made:
                made[pair] = run_reaction(reaction, pair)
            out.append(made[pair])
        return pa.array(out, pa.list_(pa.string()))

    def one(a: pa.Array) -> pa.Array:
        return rows(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return rows(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return rows(a, b, c)

    def build(*reactants: Column) -> Column:
        return F.arrow_udf((one, two, three)[len(reactants) - 1], "array<string>")(*reactants)

    return build


def product_table(reaction: Reaction) -> Any:
    """The reaction as a table function (product, nth) that Spark feeds with Arrow batches.

    ``pairs.lateralJoin(f(F.col("a").outer(), F.col("b").outer()))``, or after ``spark.udtf.register(name, f)`` in SQL
    ``FROM pairs, LATERAL name(a, b)``.
    """

    class Products:
        def eval(self, *reactants: str | None) -> Iterator[tuple[str, int]]:
            found = run_reaction(reaction, reactants) or []
            for nth, product in enumerate(dict.fromkeys(p for p in found if p is not None), 1):
                yield product, nth

    return F.udtf(Products, returnType="product string, nth int", useArrow=True)


def expand(
    pairs: DataFrame, product: Column, out: str = "SMILES", counts: Observation | None = None, weight: str | None = None
) -> DataFrame:
    """One row per pair and distinct product, in the product's order; ``product`` gives an array of texts.

    Pairs without a product give no row. ``counts`` gets, with the job that runs the result anyway: pairs, problematic (pairs
    with a reactant that could not be read), no_product, failed_products and products. ``weight``: a column that says for how
    many pairs a row stands in them.
    """
    made = pairs.withColumn("_made", product)
    usable = F.array_distinct(F.array_compact("_made"))
    if counts is not None:
        each = F.lit(1).cast("long") if weight is None else F.col(weight)
        total = lambda n: F.coalesce(F.sum(n * each), F.lit(0)).cast("long")
        size = lambda x: total(F.size(x))
        counted = lambda where: total(F.when(where, F.lit(1)).otherwise(0))
        made = made.observe(
            counts,
            total(F.lit(1)).alias("pairs"),
            counted(F.col("_made").isNull()).alias("problematic"),
            counted(F.size(usable) == 0).alias("no_product"),
            size(F.filter(F.coalesce("_made", F.array().cast("array<string>")), lambda x: x.isNull())).alias("failed_products"),
            size(F.coalesce(usable, F.array().cast("array<string>"))).alias("products"),
        )
    return made.withColumn(out, F.explode(usable)).drop("_made")


def expand_lateral(pairs: DataFrame, table: Any, reactants: list[str], out: str = "SMILES") -> DataFrame:
    """The rows of :func:`expand` by a lateral join with a table function of :func:`product_table`."""
    made = pairs.alias("_pairs").lateralJoin(table(*[F.col(f"_pairs.`{c}`").outer() for c in reactants]).alias("_made"))
    return made.select("_pairs.*", F.col("_made.product").alias(out))
