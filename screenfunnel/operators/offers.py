"""Price offers: the best pack per item and the price of one unit of product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number
from screenfunnel.operators.dedupe import first_per_key
from screenfunnel.operators.rules import valid_price

# The default price ceilings per gram and per pack.
MAX_PRICE_PER_GRAM = 40.0
MAX_PACK_PRICE = 250.0


def best_offer(
    offers: DataFrame,
    key: str = "code",
    price: str = "price",
    unit_price: str = "price_per_gram",
    order: str = "pack_no",
    max_unit: float = MAX_PRICE_PER_GRAM,
    max_pack: float = MAX_PACK_PRICE,
) -> DataFrame:
    """Of the packs within the pack ceiling the one cheapest per gram (the first of equals); none
    if that is above the per-gram ceiling."""
    affordable = offers.filter((F.col(price) <= max_pack) & F.col(unit_price).isNotNull())
    best = first_per_key(affordable, [key], [F.col(unit_price), F.col(order)])
    return best.filter(F.col(unit_price) <= max_unit)


def attach_price(
    df: DataFrame,
    best: DataFrame,
    id_col: str = "Catalog_ID",
    key: str = "code",
    unit_price: str = "price_per_gram",
    weight: str = "MW",
    keep_unpriced: bool = False,
) -> DataFrame:
    """Add PriceG and PriceMol = PriceG · weight; rows without a positive price are dropped.

    The price side is unique per key; Spark broadcasts it when its measured size allows.
    """
    prices = best.select(F.col(key).alias(id_col), F.col(unit_price).alias("PriceG"))
    priced = df.drop("PriceG", "PriceMol").join(prices, id_col, "left").withColumn(
        "PriceMol", F.col("PriceG") * number(weight)
    )
    return priced if keep_unpriced else valid_price(priced, "PriceG")


def priced_ids(ids: DataFrame, best: DataFrame, id_col: str, key: str = "code") -> DataFrame:
    """The requested ids that have a price."""
    return ids.select(id_col).distinct().join(best.select(F.col(key).alias(id_col)), id_col, "left_semi")
