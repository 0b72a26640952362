"""Hit prioritisation: rules → activity scores → winnow → clusters → shortlist."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.operators.groups import representative_per_group, summarise_groups, top_n_per_group
from screenfunnel.operators.models import ActivityModels, cluster, score_activity
from screenfunnel.operators.profile import require_distinct
from screenfunnel.operators.ranking import winnow
from screenfunnel.operators.rules import rule_set_filter, tag_rule_set
from screenfunnel.plans import presets
from screenfunnel.sources.sinks import (
    materialise, materialise_decided, read_split, stage_counts, write_cluster_bundle, write_manifest, write_split,
)


@dataclass
class Shortlist:
    clustered: DataFrame
    representatives: DataFrame
    shortlist: DataFrame
    summary: DataFrame


def bioavailability(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At most one of the five rule sets violated; ``Violation`` stands behind ``QED``."""
    return rule_set_filter(df, presets.drug_likeness_rules(), after="QED")


def qsar_winnow(
    df: DataFrame, models: ActivityModels, store: str, id_col: str = "ID", rate: float = 0.01, minimum: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Score and keep the best; the scored table is stored, as it is read for the cut again."""
    scored = materialise(
        df.sparkSession, f"{store}/scored", {"rate": rate, "minimum": minimum}, lambda: score_activity(df, models), force=True
    )
    accepted, rejected = winnow(scored, "QSAR_score", id_col, rate, minimum)
    write_split(accepted, rejected, f"{store}/winnowed")
    return accepted, rejected


def prioritise(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    store: str,
    params: dict[str, object],
    rules: dict[str, Column] | None = None,
    max_fail: int = 1,
    score_col: str = "QSAR_score",
    id_col: str = "ID",
    rate: float = 0.01,
    minimum: int = 1000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules → scores → winnow: (rows that broke the rules, the best of the others, the rest of them), each with its columns.

    ``score`` adds ``score_col`` to rows that passed (such as ``lambda d: score_activity(d, models)``). Each stage is written once
    below ``store``, with its counts (:func:`prioritise_counts`): ``rules`` as one decided table, ``scored``, since the cut reads it
    again, and ``winnowed``. ``params`` name the input and the models: stored rules and scores are used again for the same ``params``,
    rule names and ``max_fail`` only.
    """
    spark, rules = df.sparkSession, rules or presets.drug_likeness_rules()
    named = {**params, "rules": sorted(rules), "max_fail": max_fail}
    after = "QED" if "QED" in df.columns else None
    tagged = materialise_decided(
        spark, f"{store}/rules", named, lambda: tag_rule_set(df, rules, max_fail, after=after), ["accepted", "rejected"]
    )
    side = lambda name: tagged.where(F.col("decision") == name).drop("decision")
    scored = materialise(spark, f"{store}/scored", {**named, "score": score_col}, lambda: score(side("accepted")))
    best, rest = winnow(scored, score_col, id_col, rate, minimum)
    counts = write_split(best, rest, f"{store}/winnowed/data")
    write_manifest(spark, f"{store}/winnowed/manifest", counts)
    if not sum(counts.values()):
        # a table in folders without rows has no file to read
        return side("rejected"), best, rest
    return side("rejected"), *read_split(spark, f"{store}/winnowed/data")


def prioritise_counts(spark: SparkSession, store: str) -> DataFrame:
    """stage, counter, n of a :func:`prioritise`, from its manifests."""
    return stage_counts(spark, store, ("rules", "scored", "winnowed"))


def shortlist(
    df: DataFrame, id_col: str = "ID", k: int | None = None, top_n: int = 3, features: Sequence[str] | None = None
) -> Shortlist:
    """Cluster, then per cluster the representative, the best few and a summary."""
    clustered = cluster(df, id_col, features, k=k)
    return Shortlist(
        clustered,
        representative_per_group(clustered, "Cluster", selected_col="Point selected", id_col=id_col),
        top_n_per_group(clustered, "Cluster", top_n, id_col=id_col),
        summarise_groups(clustered, "Cluster"),
    )


def shortlist_series(
    series: dict[str, DataFrame], path: str, k: dict[str, int | None] | None = None, top_n: int = 3
) -> dict[str, Shortlist]:
    """The shortlist of every series, each kept apart and written; any two series must differ."""
    for a, b in combinations(series.values(), 2):
        require_distinct(a, b)
    out = {}
    for name, df in series.items():
        out[name] = found = shortlist(df, k=(k or {}).get(name), top_n=top_n)
        write_cluster_bundle(
            path, name, found.clustered, found.representatives, found.shortlist, found.summary, top_n=top_n
        )
    return out
