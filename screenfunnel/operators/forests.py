"""Random forests fitted in lots: groups of trees with seeds of their own that predict as one forest.

A lot bounds what one fit holds and what a lost driver has to repeat: with a store, every finished lot is kept under a key
made of the training rows' content and all settings, and a run that starts again goes on with the first lot that is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import require_columns
from screenfunnel.operators.profile import fingerprint
from screenfunnel.sources.sinks import params_hash, read_manifest, write_manifest

Lot = RandomForestRegressionModel | RandomForestClassificationModel
INPUT = "_features"


@dataclass(frozen=True)
class Forest:
    """Lots of one kind over the same features."""

    lots: tuple[Lot, ...]
    features: tuple[str, ...]

    @property
    def trees(self) -> int:
        return sum(m.getNumTrees for m in self.lots)

    @property
    def classifies(self) -> bool:
        return isinstance(self.lots[0], RandomForestClassificationModel)

    def join(self, other: Forest) -> Forest:
        """The forest of the trees of both."""
        if self.features != other.features or self.classifies != other.classifies:
            raise ValueError("only forests of one kind over the same features can be joined")
        return Forest((*self.lots, *other.lots), self.features)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with ``out``: the mean over all trees, or the class with most votes (of equals the lowest).

        No feature may be null. Row by row on the executors, no shuffle; a lot's trees are sent once.
        """
        rows = VectorAssembler(inputCols=list(self.features), outputCol=INPUT).transform(df)
        parts = [f"_lot{i}" for i in range(len(self.lots))]
        for part, lot in zip(parts, self.lots):
            model = lot.copy().setFeaturesCol(INPUT).setPredictionCol("" if self.classifies else part)
            rows = (model.setRawPredictionCol(part).setProbabilityCol("") if self.classifies else model).transform(rows)
        if self.classifies:
            votes = vector_to_array(parts[0])
            for part in parts[1:]:
                votes = F.zip_with(votes, vector_to_array(part), lambda x, y: x + y)
            found = F.transform(F.array(votes), lambda v: F.array_position(v, F.array_max(v)) - 1)[0].cast("double")
        else:
            found = sum((F.col(p) * m.getNumTrees for p, m in zip(parts, self.lots)), F.lit(0.0)) / self.trees
        return rows.withColumn(out, found).drop(INPUT, *parts)

    def save(self, spark: SparkSession, path: str) -> None:
        for i, lot in enumerate(self.lots):
            lot.write().overwrite().save(f"{path}/lot-{i}")
        write_manifest(spark, f"{path}/manifest", {"lots": len(self.lots), "features": list(self.features), "classifies": self.classifies})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        found = read_manifest(spark, f"{path}/manifest")
        if found is None:
            raise ValueError(f"no forest at {path}")
        return Forest(tuple(_kind(found["classifies"]).load(f"{path}/lot-{i}") for i in range(found["lots"])), tuple(found["features"]))


def _kind(classifies: bool) -> type[Lot]:
    return RandomForestClassificationModel if classifies else RandomForestRegressionModel


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classifies: bool = False,
    trees: int = 500,
    depth: int = 30,
    seed: int = 42,
    lot: int = 50,
    store: str | None = None,
) -> Forest:
    """A forest of ``trees`` trees, ``lot`` at a time; lot i has seed ``seed`` + i.

    All features are tried at every split of a regression, their root at one of a classification. Rows with a null in
    a feature or the label are left out. The training rows are kept in memory or on disk of the executors while it runs.
    """
    require_columns(df, [*features, label], "fit_forest")
    if trees < 1 or lot < 1:
        raise ValueError("trees and lot must be at least 1")
    spark = df.sparkSession
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_label")).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol=INPUT).transform(narrow).select(INPUT, "_label")
    sizes = [min(lot, trees - at) for at in range(0, trees, lot)]
    base = None
    if store is not None:
        settings = {"features": list(features), "classifies": classifies, "depth": depth, "seed": seed, "lot": lot}
        base = f"{store}/{params_hash({**settings, 'rows': [str(v) for v in fingerprint(narrow).first()]})}"
    kind = RandomForestClassifier if classifies else RandomForestRegressor
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    lots = []
    for i, n in enumerate(sizes):
        path = None if base is None else f"{base}/lot-{i}-{n}"
        if path is not None and read_manifest(spark, f"{path}/manifest") is not None:
            lots.append(_kind(classifies).load(f"{path}/trees"))
            continue
        learner = kind(
            featuresCol=INPUT, labelCol="_label", numTrees=n, maxDepth=depth, seed=seed + i,
            featureSubsetStrategy="sqrt" if classifies else "all",
        )
        # The copy leaves out the training summary, which holds the session.
        model = learner.fit(rows).copy()
        if path is not None:
            model.write().overwrite().save(f"{path}/trees")
            write_manifest(spark, f"{path}/manifest", {"trees": n})
        lots.append(model)
    rows.unpersist()
    return Forest(tuple(lots), tuple(features))
