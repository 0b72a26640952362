"""Docking grading: checked results → pose scores → best poses → final ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.operators import tasks
from screenfunnel.operators.contacts import geometric_score
from screenfunnel.operators.poses import RECEPTOR_LABELS, best_pose, cap_poses, pivot_scores, with_label
from screenfunnel.operators.ranking import Component, composite_score
from screenfunnel.plans import presets
from screenfunnel.sources import text_records as tr
from screenfunnel.sources.sinks import export_ranked, materialise, stage_counts

#: The stages of :func:`run_grading`, in order.
STAGES = ("checked", "poses", "atoms", "best", "ranked")


@dataclass
class Grading:
    """``checked`` tasks with their outcome, the ``status`` of all, ``poses``, ``best`` poses and the ``ranked`` ligands."""

    checked: DataFrame
    status: str
    poses: DataFrame
    best: DataFrame
    ranked: DataFrame


def all_poses(poses: DataFrame, n_modes: int = 3, labels: dict[str, str] = RECEPTOR_LABELS) -> DataFrame:
    """Up to ``n_modes`` poses per log with the target label and the score rounded to 2 decimals."""
    capped = cap_poses(poses, ["ligand_id", "receptor_id"], "pose_no", n_modes)
    return with_label(capped, labels).select(
        "ligand_id", "receptor_id", "cox_label", F.col("rank").alias("pose_rank"),
        "pose_no", F.round("score", 2).alias("docking_score"),
    )


def best_poses(
    poses: DataFrame,
    pose_atoms: DataFrame,
    receptor_atoms: DataFrame,
    labels: dict[str, str] = RECEPTOR_LABELS,
    per_model: bool = True,
) -> DataFrame:
    """Per ligand and receptor the pose with the best geometric score, the first of equals.

    Pose k of a log is model k of the pose file; ``per_model=False`` scores the file as a whole.
    """
    geometry = geometric_score(pose_atoms, receptor_atoms, labels, per_model=per_model)
    on = ["ligand_id", "receptor_id"]
    if per_model:
        geometry, on = geometry.withColumnRenamed("model", "pose_no"), [*on, "pose_no"]
    else:
        geometry = geometry.drop("model")
    scored = poses.join(geometry, on, "left").fillna(0.0, ["geometric_score"])
    best = best_pose(scored, ["ligand_id", "receptor_id"], "geometric_score", "pose_no")
    return best.select(
        "ligand_id", "receptor_id", "cox_label", F.col("pose_rank").alias("best_pose_rank"), "docking_score", "geometric_score"
    )


def final_ranking(
    best: DataFrame,
    ligands: DataFrame,
    id_col: str = "ID",
    qsar_col: str = "QSAR_score",
    parts: Sequence[Component] = presets.FINAL_RANKING,
) -> DataFrame:
    """One row per ligand with the scores of both targets, the normalised parts and final_score.

    Ordered by final_score, ties by id. ``parts`` holds weights and directions; by default a low
    activity score ranks high, as in the published table.
    """
    wide = pivot_scores(best, "ligand_id", "cox_label", "docking_score", ("COX2", "COX1"), "min")
    geometry = best.filter(F.col("cox_label") == "COX2").select("ligand_id", F.col("geometric_score").alias("geo_score"))
    activity = ligands.select(F.col(id_col).alias("ligand_id"), F.col(qsar_col).cast("double").alias("QSAR_score"))
    table = wide.join(geometry, "ligand_id", "left").join(activity, "ligand_id", "left")
    return composite_score(table, parts, "ligand_id").orderBy(F.col("final_score").desc(), "ligand_id")


def run_grading(
    logs: DataFrame,
    pose_files: DataFrame,
    receptor_atoms: DataFrame,
    grid: DataFrame,
    ligands: DataFrame,
    store: str,
    labels: dict[str, str] = RECEPTOR_LABELS,
    n_modes: int = 3,
    per_model: bool = True,
    only_complete: bool = False,
    id_col: str = "ID",
    qsar_col: str = "QSAR_score",
    parts: Sequence[Component] = presets.FINAL_RANKING,
) -> Grading:
    """From docking files to the exported ranking: check, extract, score, pick, rank, save.

    ``logs`` and ``pose_files`` are file texts (stem, value). Every stage is one table below ``store`` and the next one reads it,
    so no text is parsed again for a later stage and a lost executor costs one stage; :func:`grading_counts` reads what
    the stages counted while they were written. If the check fails as a whole (a receptor without any complete task),
    nothing is graded. The published workflow then takes the poses of every log it finds; ``only_complete`` takes those of complete
    tasks. The scores go to ``store/export/docking_scores``, the pose files of the ranked ligands to ``store/export/poses``.
    """
    spark = logs.sparkSession

    def kept(stage: str, made: DataFrame) -> DataFrame:
        return materialise(spark, f"{store}/{stage}", {"stage": stage}, lambda: made, force=True)

    checked = kept("checked", tasks.check_tasks(grid, tr.log_summary(logs), tr.pose_file_summary(pose_files)))
    status = tasks.overall_status(tasks.roll_up(checked)).first()["status"]
    found = tr.parse_dock_logs(logs)
    if status in (None, "FAIL"):
        found = found.where(F.lit(False))
    elif only_complete:
        complete = checked.where(F.col("outcome") == "complete").select(*tasks.TASK)
        found = found.join(complete, tasks.TASK, "left_semi")
    poses = kept("poses", all_poses(found, n_modes, labels))
    # Scoring reads the atoms several times: as a table, the texts are parsed once.
    atoms = kept("atoms", tr.parse_pose_atoms(pose_files))
    best = kept("best", best_poses(poses, atoms, receptor_atoms, labels, per_model))
    ranked = kept("ranked", final_ranking(best, ligands, id_col, qsar_col, parts))
    ligand, receptor = tr.stem_parts(F.regexp_replace(F.col("stem"), "_out$", ""))
    texts = pose_files.select(ligand.alias("ligand_id"), receptor.alias("receptor_id"), F.col("value").alias("text"))
    export_ranked(ranked, texts, f"{store}/export")
    return Grading(checked, status, poses, best, ranked)


def grading_counts(spark: SparkSession, store: str) -> DataFrame:
    """stage, counter, n of a :func:`run_grading`, from its manifests."""
    return stage_counts(spark, store, STAGES)
