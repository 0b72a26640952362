"""Task grids (ligand × receptor) and the check of what came back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.operators.order import number_rows

# A receptor list stands in the plan up to this many; longer ones are tables (task_grid_of_tables).
MAX_RECEPTORS = 1000
# Receptors are broadcast up to this many; beyond, both sides are shuffled in slices of about so many.
SLICE_ROWS = 100_000
TASK = ["ligand_id", "receptor_id"]


def receptor_list(df: DataFrame, column: str, order: str | None = None) -> list[str]:
    """A receptor table as the list the grid is made over (a handful of structures)."""
    rows = df.select(column, *([order] if order else [])).distinct().orderBy(order or column).limit(MAX_RECEPTORS + 1).collect()
    if len(rows) > MAX_RECEPTORS:
        raise ValueError(f"more than {MAX_RECEPTORS} receptors")
    return [r[column] for r in rows]


def task_grid(ligands: DataFrame, receptors: Sequence[str], id_col: str = "ID", order: str = "row_order") -> DataFrame:
    """Every ligand with every receptor; task ids count from 1, ligand by ligand in ``order`` (a
    unique numeric column). The receptors are an array in the plan, so no join is made."""
    if not receptors or len(receptors) > MAX_RECEPTORS:
        raise ValueError(f"1 to {MAX_RECEPTORS} receptors are needed")
    numbered = number_rows(ligands.select(id_col, order), order, out="_no")
    width = len(receptors)
    return numbered.select(
        F.col("_no"), F.col(id_col).cast("string").alias("ligand_id"), F.posexplode(F.array(*[F.lit(r) for r in receptors]))
    ).select(
        ((F.col("_no") - 1) * width + F.col("pos") + 1).alias("task_id"), "ligand_id", F.col("col").alias("receptor_id")
    )


def task_grid_of_tables(
    ligands: DataFrame,
    receptors: DataFrame,
    id_col: str = "ID",
    order: str = "row_order",
    receptor_id: str = "receptor_id",
    receptor_order: str = "row_order",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """:func:`task_grid` for a receptor table of any size, in the order of ``receptor_order`` (unique and numeric as well).

    Both sides are numbered, and a task's number follows from the two places. Each ligand goes once to every slice of
    receptors and meets it by an equi-join; only a side of at most ``slice_rows`` receptors is broadcast. Nothing comes to the driver but
    the number of receptors; without receptors there are no tasks.
    """
    if slice_rows < 1:
        raise ValueError("slice_rows must be at least 1")
    left = number_rows(ligands.select(id_col, order), order, out="_no").select(
        F.col(id_col).cast("string").alias("ligand_id"), "_no"
    )
    right = number_rows(receptors.select(receptor_id, receptor_order), receptor_order, out="_place").select(
        F.col(receptor_id).cast("string").alias("receptor_id"), "_place", F.floor((F.col("_place") - 1) / slice_rows).alias("_slice")
    )
    width = receptors.count()
    slices = -(-width // slice_rows)
    if not slices:
        return left.select(F.col("_no").alias("task_id"), "ligand_id", F.lit("").alias("receptor_id")).filter(F.lit(False))
    spread = left.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return spread.join(F.broadcast(right) if slices == 1 else right, "_slice").select(
        ((F.col("_no") - 1) * width + F.col("_place")).alias("task_id"), "ligand_id", "receptor_id"
    )


def pending_tasks(grid: DataFrame, logs: DataFrame, poses: DataFrame, force: bool = False) -> DataFrame:
    """Tasks that still have to run: those without both a log and a pose file, or all if forced."""
    if force:
        return grid
    done = logs.select(*TASK).distinct().join(poses.select(*TASK), TASK, "left_semi")
    return grid.join(done, TASK, "left_anti")


def missing_inputs(grid: DataFrame, ligand_files: DataFrame, receptor_files: DataFrame) -> DataFrame:
    """Tasks that cannot run, with the reason: the ligand or the receptor file is not there."""
    have_ligand = ligand_files.select("ligand_id").distinct().withColumn("_l", F.lit(True))
    have_receptor = receptor_files.select("receptor_id").distinct().withColumn("_r", F.lit(True))
    reason = F.when(F.col("_l").isNull(), "ligand file missing").when(F.col("_r").isNull(), "receptor file missing")
    return (
        grid.join(have_ligand, "ligand_id", "left")
        .join(have_receptor, "receptor_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*grid.columns, "reason")
    )


def check_tasks(
    grid: DataFrame, logs: DataFrame, poses: DataFrame, min_pose_bytes: int = 100
) -> DataFrame:
    """One row per task or orphaned log: ``outcome`` (complete, missing, failed, orphaned) and the
    reason of a failure.

    ``logs`` has n_poses and ``poses`` has n_bytes and has_marker, each one row per task. A task is
    complete if both files exist, the log has a pose, and the pose file is big enough and holds a
    docking marker.
    """
    expected = grid.select(*TASK).distinct().withColumn("_expected", F.lit(True))
    have_log = logs.select(*TASK, "n_poses").withColumn("_log", F.lit(True))
    have_pose = poses.select(*TASK, "n_bytes", "has_marker").withColumn("_pose", F.lit(True))
    joined = expected.join(have_log, TASK, "full_outer").join(have_pose, TASK, "left")
    reason = (
        F.when(F.coalesce(F.col("n_poses"), F.lit(0)) == 0, "no Vina poses in log")
        .when(
            F.col("n_bytes") < min_pose_bytes,
            F.concat(F.lit("pose file too small ("), F.col("n_bytes").cast("string"), F.lit(" B)")),
        )
        .when(~F.coalesce(F.col("has_marker"), F.lit(False)), "pose file missing Vina markers")
    )
    outcome = (
        F.when(F.col("_expected").isNull(), "orphaned")
        .when(F.col("_log").isNull() | F.col("_pose").isNull(), "missing")
        .when(reason.isNotNull(), "failed")
        .otherwise("complete")
    )
    return joined.select(
        *TASK, outcome.alias("outcome"), F.when(outcome == "failed", reason).alias("reason")
    )


def roll_up(checked: DataFrame, by: str | None = "receptor_id") -> DataFrame:
    """Counts and status per receptor (or over all): PASS if every expected task is complete,
    PARTIAL if some are, else FAIL. Each receptor is held against its own tasks only."""
    def n(outcome: str):
        return F.count_if(F.col("outcome") == outcome)

    keys = [by] if by else []
    counts = checked.groupBy(*keys).agg(
        F.count_if(F.col("outcome") != "orphaned").alias("total"),
        n("complete").alias("complete"),
        n("missing").alias("missing"),
        n("failed").alias("failed"),
        n("orphaned").alias("orphaned"),
    )
    return counts.withColumn(
        "status",
        F.when(F.col("complete") == F.col("total"), "PASS").when(F.col("complete") > 0, "PARTIAL").otherwise("FAIL"),
    )


def overall_status(per_receptor: DataFrame) -> DataFrame:
    """One row: summed counts; FAIL if any receptor fails, else PARTIAL if any is partial."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "PARTIAL", 1).otherwise(0))
    return per_receptor.agg(
        *[F.sum(c).alias(c) for c in ("total", "complete", "missing", "failed", "orphaned")],
        F.when(worst == 2, "FAIL").when(worst == 1, "PARTIAL").otherwise("PASS").alias("status"),
    )
