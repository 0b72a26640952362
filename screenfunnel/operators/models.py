"""Activity models (random forests) and clustering, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import active, ic50_nm, number, pic50, qsar_score, require_columns, selectivity
from screenfunnel.operators.forests import Forest, fit_forest
from screenfunnel.operators.groups import attach_labels
from screenfunnel.operators.profile import validate_features
from screenfunnel.operators.stats import Domain, Scaler, accuracy, fit_domain, fit_scaler, regression_metrics, stratified_split, stratify_bins

# The descriptor columns the models are fitted on, in this order.
DESCRIPTORS = ("MW", "HBD", "HBA", "RotB", "HvyAtm", "Rings", "HetAtm", "MR", "CAtm", "Atoms", "tPSA", "LogP")


def add_targets(df: DataFrame, off_target: str = "IC50_COX1_median", target: str = "IC50_COX2_median") -> DataFrame:
    """pIC50 of both targets and the activity class of the target (null stays null)."""
    require_columns(df, [off_target, target], "add_targets")
    df = df.withColumns({off_target: number(off_target), target: number(target)})
    return df.withColumns({"pIC50_COX2": pic50(target), "pIC50_COX1": pic50(off_target), "active_COX2": active(target)})


def drop_incomplete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in features}).dropna(subset=list(features))


@dataclass
class ActivityModels:
    """The fitted forests, the applicability domain and the hold-out metrics."""

    target: Forest
    target_class: Forest
    off_target: Forest
    domain: Domain
    features: tuple[str, ...]
    metrics: dict[str, float]

    def save(self, spark: SparkSession, path: str) -> None:
        self.target.save(spark, f"{path}/target")
        self.target_class.save(spark, f"{path}/target_class")
        self.off_target.save(spark, f"{path}/off_target")
        scaler = self.domain.scaler
        row = (list(self.features), list(scaler.mean), list(scaler.std), list(self.domain.centroid), self.domain.cutoff, self.metrics)
        schema = (
            "features array<string>, mean array<double>, std array<double>, centroid array<double>, "
            "cutoff double, metrics map<string,double>"
        )
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/domain")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ActivityModels:
        row = spark.read.parquet(f"{path}/domain").first()
        scaler = Scaler(tuple(row.features), tuple(row["mean"]), tuple(row["std"]))
        return ActivityModels(
            Forest.load(spark, f"{path}/target"),
            Forest.load(spark, f"{path}/target_class"),
            Forest.load(spark, f"{path}/off_target"),
            Domain(scaler, tuple(row.centroid), row.cutoff),
            tuple(row.features),
            dict(row.metrics),
        )


def fit_activity_models(
    df: DataFrame,
    features: Sequence[str] = DESCRIPTORS,
    id_col: str = "ChEMBL_ID",
    trees: int = 500,
    depth: int = 30,
    seed: int = 42,
    test_share: float = 0.2,
    lot: int = 50,
    store: str | None = None,
) -> ActivityModels:
    """Fit on the columns of :func:`add_targets`: regressor and classifier of the target on the
    training part of a stratified split, regressor of the off target on all its rows.

    The forests are fitted ``lot`` trees at a time; with ``store`` finished lots are kept there, so a run that was cut off
    goes on with the next. The training table is read several times; pass a stored one.
    """
    rows = drop_incomplete(df, features)
    target = rows.filter(F.col("pIC50_COX2").isNotNull())
    needed = list(dict.fromkeys([id_col, *features, "pIC50_COX2", "active_COX2", "stratum"]))
    binned = stratify_bins(target, "pIC50_COX2").select(*needed)
    # Two forests, the domain and the metrics read the split: it is made once and kept by the executors while they do.
    split = stratified_split(binned, "stratum", id_col, test_share, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = split.filter("not is_test"), split.filter("is_test")
        shape = {"trees": trees, "depth": depth, "seed": seed, "lot": lot, "store": store}
        model = fit_forest(train, features, "pIC50_COX2", **shape)
        model_class = fit_forest(train, features, "active_COX2", True, **shape)
        tested = model_class.transform(model.transform(test, "pIC50_COX2_pred"), "active_pred")
        metrics = {
            **regression_metrics(tested, "pIC50_COX2", "pIC50_COX2_pred").first().asDict(),
            **accuracy(tested, "active_COX2", "active_pred").first().asDict(),
        }
        domain = fit_domain(train, features)
    finally:
        split.unpersist()
    model_off = fit_forest(rows.filter(F.col("pIC50_COX1").isNotNull()), features, "pIC50_COX1", **shape)
    metrics = {k: float(v) for k, v in metrics.items() if v is not None}
    return ActivityModels(model, model_class, model_off, domain, tuple(features), metrics)


def score_activity(df: DataFrame, models: ActivityModels) -> DataFrame:
    """Predictions, selectivity, score and applicability domain; rows lacking a feature are dropped.

    Row by row on the executors, no shuffle.
    """
    rows = models.domain.transform(drop_incomplete(df, models.features))
    rows = models.target.transform(rows, "pIC50_COX2_pred")
    rows = models.off_target.transform(rows, "pIC50_COX1_pred")
    return rows.withColumns(
        {"IC50_COX2_pred_nM": ic50_nm("pIC50_COX2_pred"), "IC50_COX1_pred_nM": ic50_nm("pIC50_COX1_pred")}
    ).withColumns(
        {
            "SI_pred": selectivity("IC50_COX1_pred_nM", "IC50_COX2_pred_nM"),
            "QSAR_score": qsar_score("pIC50_COX2_pred", "pIC50_COX1_pred"),
        }
    )


def cluster(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | None = None,
    text_col: str = "SMILES",
    ignore: Sequence[str] = ("SMILES", "Violation"),
    k: int | None = None,
    candidates: Sequence[int] = (3, 5, 8, 12, 20),
    seed: int = 0,
) -> DataFrame:
    """Labels per id: Cluster, Point selected (1 for the row nearest to its cluster's centre), the
    distance to that centre and three principal components, joined to the input one to one.

    Features are z-scaled, a missing one counts as the mean. Without ``k`` the candidate with the
    best silhouette is taken.
    """
    if features is None:
        features, _ = validate_features(df, id_col, text_col, ignore)
    scaler = fit_scaler(df, features)
    scaled = df.select(id_col, *[F.coalesce(scaler.scaled(c), F.lit(0.0)).alias(f"z{i}") for i, c in enumerate(features)])
    gather = VectorAssembler(inputCols=[f"z{i}" for i in range(len(features))], outputCol="features")
    points = gather.transform(scaled).select(id_col, "features").persist()

    def fit(n: int):
        return KMeans(k=n, seed=seed, featuresCol="features", predictionCol="Cluster").fit(points)

    if k is None:
        n_rows = points.count()
        judge = ClusteringEvaluator(predictionCol="Cluster", featuresCol="features")
        tried = [(judge.evaluate(m.transform(points)), -n, m) for n in candidates if n < n_rows for m in [fit(n)]]
        model = max(tried, key=lambda t: t[:2])[2]
    else:
        model = fit(k)
    parts = PCA(k=min(3, len(features)), inputCol="features", outputCol="pc").fit(points)
    labelled = parts.transform(model.transform(points))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    offset = F.zip_with(
        vector_to_array("features"), F.element_at(centres, F.col("Cluster") + 1), lambda x, c: (x - c) * (x - c)
    )
    labelled = labelled.withColumn("CentroidDistance", F.sqrt(F.aggregate(offset, F.lit(0.0), lambda s, x: s + x)))
    nearest = labelled.groupBy(F.col("Cluster").alias("_c")).agg(
        F.min_by(F.col(id_col), F.struct("CentroidDistance", id_col)).alias("_nearest")
    )
    pcs = vector_to_array("pc")
    labels = (
        # One row per cluster, at most max(candidates) or k.
        labelled.join(F.broadcast(nearest), F.col("Cluster") == F.col("_c"))
        .select(
            id_col,
            "Cluster",
            F.when(F.col(id_col) == F.col("_nearest"), 1).otherwise(0).alias("Point selected"),
            "CentroidDistance",
            *[F.element_at(pcs, i + 1).alias(f"PC{i + 1}") for i in range(min(3, len(features)))],
        )
    )
    return attach_labels(df, labels, id_col, "Cluster", ("Point selected", "CentroidDistance", "PC1", "PC2", "PC3"))
