"""A query: the Spark side and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of a table that one task makes into records, atoms or texts.
TASK_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt to tasks of about ``TASK_ROWS`` rows. A file of a few megabytes is one task's to read, and so would be all that is
    made of its rows."""
    rows = df.count()
    return df if rows <= TASK_ROWS else df.repartition(math.ceil(rows / TASK_ROWS))


#: Writer options of texts that a query makes of a table: a quarter of the bytes, in files that are each one task's to read.
COMPACT = {"compression": "gzip", "maxRecordsPerFile": 100_000}


def settle(c: str | Column, digits: int) -> Column:
    """Round a result for the comparison with SQL, which has ``floor(x * 1e4 + 0.5001) / 1e4``.

    Halves go up; the small excess hides the last bits of sums taken in another order.
    """
    scale = float(10**digits)
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)
