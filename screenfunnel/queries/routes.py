"""Whole routes on data that Spark derives from the driver tables: files to ranking, descriptors to shortlist, corrected logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.operators import tasks
from screenfunnel.plans import grading
from screenfunnel.plans.prioritise import prioritise, prioritise_counts
from screenfunnel.queries.base import COMPACT, query, settle, table
from screenfunnel.queries.ranking import norm_sql
from screenfunnel.queries.structures import coordinate
from screenfunnel.session import scratch_path
from screenfunnel.sources import text_records as tr
from screenfunnel.streaming import ingest

# --- docking files to the ranking -------------------------------------------------------------

# Every embedding is a ligand. Its log of 6COX has four poses, its pose file two models of ten atoms; label 9 has a log without
# poses and a pose file without a marker, and labels below 8 were docked to 3KK6 as well. Labels 0 and 1 place the two sites of the receptor.
GRADING_SQL = f"""
    n AS (SELECT unnest(range(1, 21)) AS i),
    a AS (SELECT vec_id, CASE WHEN i <= 10 THEN 1 ELSE 2 END AS model, i, round(embedding[i * 3 - 2]::DOUBLE * 20, 3) AS x,
            round(embedding[i * 3 - 1]::DOUBLE * 20, 3) AS y, round(embedding[i * 3]::DOUBLE * 20, 3) AS z FROM embeddings, n),
    r AS (SELECT label, embedding[61]::DOUBLE * 60 AS bx, embedding[62]::DOUBLE * 60 AS bw, embedding[63]::DOUBLE * 60 AS bz FROM embeddings),
    d AS (SELECT vec_id, model, i, label, sqrt((x - bx) * (x - bx) + (y - bw) * (y - bw) + (z - bz) * (z - bz)) AS d FROM a, r),
    per_atom AS (SELECT vec_id, model, i, max((label = 0)::INT) AS arg, max((label = 1)::INT) AS tyr, max((d < 2)::INT) AS clash
          FROM d WHERE d < 3.5 GROUP BY ALL),
    c AS (SELECT vec_id, model, max(arg) AS arg, max(tyr) AS tyr, sum(clash) AS clashes FROM per_atom GROUP BY ALL),
    m AS (SELECT vec_id, model, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM a GROUP BY ALL),
    p AS (SELECT a.vec_id, a.model, avg(CASE WHEN sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) < 5 THEN 1.0 ELSE 0.0 END) AS share
          FROM a JOIN m ON a.vec_id = m.vec_id AND a.model = m.model GROUP BY ALL),
    geo AS (SELECT p.vec_id, p.model, coalesce(arg, 0) * 2 + coalesce(tyr, 0) * 2 + (share > 0.3)::INT
          + CASE WHEN coalesce(clashes, 0) = 0 THEN 1 WHEN clashes <= 2 THEN 0 ELSE -2 END AS g
          FROM p LEFT JOIN c ON p.vec_id = c.vec_id AND p.model = c.model),
    k AS (SELECT unnest(range(1, 4)) AS k),
    poses AS (SELECT vec_id, k, -((vec_id * 7) % 120 + k * 3 + 0.5)::DOUBLE AS score, coalesce(g, 0) AS g FROM embeddings CROSS JOIN k
          LEFT JOIN geo USING (vec_id) WHERE label <> 9 AND (geo.model = k OR (k = 3 AND geo.model = 1))),
    fixed AS (SELECT vec_id, k, score, CASE WHEN k = 3 THEN 0 ELSE g END AS g FROM poses),
    best AS (SELECT vec_id, score, g FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, k) AS rn FROM fixed) WHERE rn = 1),
    t AS (SELECT 'lig_' || b.vec_id AS ligand_id, b.score AS score_cox2,
            CASE WHEN label < 8 THEN -((b.vec_id * 11) % 90 + 1.25)::DOUBLE END AS score_cox1, b.g::DOUBLE AS geo_score, ((b.vec_id * 5) % 37)::DOUBLE AS "QSAR_score"
          FROM best b JOIN embeddings e ON b.vec_id = e.vec_id),
    s AS (SELECT *, {norm_sql('"QSAR_score"', True)} AS q, {norm_sql("geo_score", False)} AS gn, {norm_sql("score_cox2", True)} AS v FROM t)
"""


def docking_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(logs, pose files, receptor atoms, grid, ligands)."""
    e = table(spark, sf, "embeddings")
    ligand, v = F.concat(F.lit("lig_"), F.col("vec_id")), F.col("vec_id")
    line = lambda k, score: F.concat(F.lit(f"   {k}   -"), score.cast("string"), F.lit("   0.0   0.0\n"))
    target = F.concat(
        F.lit("mode |   affinity | dist from best mode\n"), F.when(F.col("label") != 9, "-----+------------+----------\n").otherwise(""),
        *[line(k, (v * 7) % 120 + F.lit(k * 3 + 0.5)) for k in range(1, 5)],
    )
    off_target = F.concat(F.lit("-----+----\n"), line(1, (v * 11) % 90 + F.lit(1.25)))
    sixes = e.select(F.concat(ligand, F.lit("_6COX")).alias("stem"), target.alias("value"))
    threes = e.where("label < 8").select(F.concat(ligand, F.lit("_3KK6")).alias("stem"), off_target.alias("value"))

    def block(first: int, last: int):
        at = lambda i: (i - 1) * 3
        atom = lambda i: F.format_string(
            "ATOM  %5d  C   UNL     1    %8.3f%8.3f%8.3f  1.00  0.00", i, *[coordinate(at(i) + j, 20.0) for j in range(3)]
        )
        return F.concat_ws("\n", F.transform(F.sequence(F.lit(first), F.lit(last)), atom))

    head = lambda k: F.when(F.col("label") != 9, f"MODEL {k}\nROOT\n").otherwise(f"MODEL  {k}\n")
    text = F.concat(head(1), block(1, 10), F.lit("\nENDMDL\n"), head(2), block(11, 20), F.lit("\nENDMDL\n"))
    files = e.select(F.concat(ligand, F.lit("_6COX_out")).alias("stem"), text.alias("value")).unionByName(
        e.where("label < 8").select(F.concat(ligand, F.lit("_3KK6_out")).alias("stem"), text.alias("value"))
    )
    site = F.col("label")
    receptor = e.select(
        F.lit("6COX").alias("receptor_id"), F.when(site == 0, "NH1").when(site == 1, "OH").otherwise("CA").alias("atom"),
        F.when(site == 0, "ARG").when(site == 1, "TYR").otherwise("ALA").alias("residue"),
        F.when(site == 0, 120).when(site == 1, 355).otherwise(1).alias("resnum"),
        *[coordinate(60 + i, 60.0).alias(c) for i, c in enumerate(("x", "y", "z"))],
    )
    ligands = e.select(ligand.alias("ID"), "vec_id", ((v * 5) % 37).cast("double").alias("QSAR_score"))
    grid = tasks.task_grid(ligands, ["6COX", "3KK6"], "ID", "vec_id")
    return sixes.unionByName(threes), files, receptor, grid, ligands.drop("vec_id")


@query(
    "grading_funnel",
    f"""WITH {GRADING_SQL}
    SELECT ligand_id, score_cox2, score_cox1, geo_score, floor(q * 1e6 + 0.5001) / 1e6 AS qsar_norm, floor(gn * 1e6 + 0.5001) / 1e6 AS geo_norm,
           floor(v * 1e6 + 0.5001) / 1e6 AS vina_norm, round(0.5 * q + 0.4 * gn + 0.1 * v, 4) AS final_score FROM s""",
)
def grading_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Logs, pose files and a receptor → checked tasks → poses → best poses → ranking → export."""
    found = grading.run_grading(*docking_files(spark, sf), store=scratch_path(spark, "grading"))
    return found.ranked.select(
        "ligand_id", "score_cox2", "score_cox1", "geo_score",
        *[settle(c, 6).alias(c) for c in ("qsar_norm", "geo_norm", "vina_norm")], "final_score",
    )


@query(
    "grading_exports",
    """WITH e AS (SELECT count(*) AS n, count(*) FILTER (WHERE label < 8) AS n8, count(*) FILTER (WHERE label <> 9) AS n9 FROM embeddings)
       SELECT 'checked' AS stage, 2 * n AS n FROM e UNION ALL SELECT 'poses', n9 * 3 + n8 FROM e UNION ALL SELECT 'best', n9 + n8 FROM e
       UNION ALL SELECT 'atoms', 20 * (n + n8) FROM e
       UNION ALL SELECT 'ranked', n9 FROM e UNION ALL SELECT 'complete', 2 * n8 + (n9 - n8) FROM e
       UNION ALL SELECT 'exported scores', n9 FROM e UNION ALL SELECT 'exported files', n9 + n8 FROM e""",
)
def grading_exports(spark: SparkSession, sf: str) -> DataFrame:
    """What the stages counted on their way, and what stands in the export."""
    store = scratch_path(spark, "grading")
    found = grading.run_grading(*docking_files(spark, sf), store=store, only_complete=True)
    counts = grading.grading_counts(spark, store).select("stage", "n")
    one = lambda name, df: df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
    return (
        counts.unionByName(one("complete", found.checked.where("outcome = 'complete'")))
        .unionByName(one("exported scores", spark.read.csv(f"{store}/export/docking_scores", header=True)))
        .unionByName(one("exported files", spark.read.parquet(f"{store}/export/poses")))
    )


# --- descriptors to the winnowed list ---------------------------------------------------------

# Line items as molecules: descriptors made of their columns; some are missing.
MOLECULES_SQL = """
    m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS "ID", l_extendedprice / 120 AS mw,
            CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_discount * 60 END AS logp, l_linenumber AS hbd, l_quantity / 4 AS hba,
            l_quantity * 3 AS mr, l_suppkey % 90 AS atoms, l_tax * 2000 AS tpsa, l_partkey % 13 AS rotb, l_partkey % 30 AS catm,
            l_suppkey % 5 AS het, l_linenumber AS rings, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 1000 / 8.0::DOUBLE AS score FROM lineitem),
    r AS (SELECT *, coalesce(mw <= 500 AND logp <= 4.15 AND hbd <= 5 AND hba <= 10, false) AS r1,
            coalesce(mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND mr BETWEEN 40 AND 130 AND atoms BETWEEN 20 AND 70, false) AS r2,
            coalesce(logp <= 5.88 AND tpsa <= 131.6, false) AS r3,
            coalesce(mw BETWEEN 200 AND 600 AND logp BETWEEN -2 AND 5 AND catm >= 5 AND het >= 2 AND hbd <= 5 AND hba <= 10 AND rings <= 7
              AND rotb <= 15 AND tpsa <= 150, false) AS r4,
            coalesce(rotb <= 10 AND tpsa <= 140, false) AS r5 FROM m),
    f AS (SELECT *, concat_ws(', ', CASE WHEN NOT r1 THEN 'Lipinski' END, CASE WHEN NOT r2 THEN 'Ghose' END, CASE WHEN NOT r3 THEN 'Egan' END,
            CASE WHEN NOT r4 THEN 'Muegge' END, CASE WHEN NOT r5 THEN 'Veber' END) AS names,
            (NOT r1)::INT + (NOT r2)::INT + (NOT r3)::INT + (NOT r4)::INT + (NOT r5)::INT AS fails FROM r),
    w AS (SELECT *, row_number() OVER (ORDER BY score DESC, "ID") AS rn, count(*) OVER () AS n FROM f WHERE fails <= 1),
    routed AS (SELECT "ID", names, NULL::DOUBLE AS score, 'rules' AS fate FROM f WHERE fails > 1
               UNION ALL SELECT "ID", names, score, CASE WHEN rn <= least(n, greatest(CAST(floor(n * 0.1) AS BIGINT), 50)) THEN 'accepted' ELSE 'rejected' END FROM w)
"""


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    key = F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    return table(spark, sf, "lineitem").select(
        key.alias("ID"), (c("l_extendedprice") / 120).alias("MW"),
        F.when(~((c("l_returnflag") == "R") & (c("l_linenumber") == 1)), c("l_discount") * 60).alias("LogP"),
        c("l_linenumber").alias("HBD"), (c("l_quantity") / 4).alias("HBA"), (c("l_quantity") * 3).alias("MR"), (c("l_suppkey") % 90).alias("Atoms"),
        (c("l_tax") * 2000).alias("tPSA"), (c("l_partkey") % 13).alias("RotB"), (c("l_partkey") % 30).alias("CAtm"), (c("l_suppkey") % 5).alias("HetAtm"),
        c("l_linenumber").alias("Rings"), F.lit(0.5).alias("QED"), ((c("l_partkey") * 7 + c("l_suppkey") * 3 + c("l_linenumber")) % 1000).alias("raw"),
    )


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("QSAR_score", F.col("raw") / F.lit(8.0))


@query(
    "prioritise_funnel",
    f"""WITH {MOLECULES_SQL} SELECT "ID", CASE WHEN names = '' THEN 'none' ELSE names END AS "Violation", score AS "QSAR_score", fate FROM routed""",
)
def prioritise_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Rule sets, scores, the best tenth, with the fate of every row; the second run takes the stored stages."""
    store = scratch_path(spark, "prioritise")
    for _ in range(2):
        failed, best, rest = prioritise(molecules(spark, sf), scored, store, {"input": sf}, rate=0.1, minimum=50)
    parts = [
        df.select("ID", "Violation", score.cast("double").alias("QSAR_score"), F.lit(fate).alias("fate"))
        for df, score, fate in ((failed, F.lit(None), "rules"), (best, F.col("QSAR_score"), "accepted"), (rest, F.col("QSAR_score"), "rejected"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "prioritise_counts",
    f"""WITH {MOLECULES_SQL}
    SELECT 'rules' AS stage, 'accepted' AS counter, count(*) FILTER (WHERE fate <> 'rules') AS n FROM routed
    UNION ALL SELECT 'rules', 'rejected', count(*) FILTER (WHERE fate = 'rules') FROM routed
    UNION ALL SELECT 'scored', 'rows', count(*) FILTER (WHERE fate <> 'rules') FROM routed
    UNION ALL SELECT 'winnowed', 'accepted', count(*) FILTER (WHERE fate = 'accepted') FROM routed
    UNION ALL SELECT 'winnowed', 'rejected', count(*) FILTER (WHERE fate = 'rejected') FROM routed""",
)
def counts_of_prioritise(spark: SparkSession, sf: str) -> DataFrame:
    store = scratch_path(spark, "prioritise")
    prioritise(molecules(spark, sf), scored, store, {"input": sf}, rate=0.1, minimum=50)
    return prioritise_counts(spark, store)


# --- corrected logs ---------------------------------------------------------------------------


@query(
    "ingest_logs",
    """WITH k AS (SELECT 'L-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS ligand_id, * FROM lineitem)
       SELECT ligand_id, 'R' AS receptor_id, 1 AS pose_no, l_extendedprice AS score FROM k
       UNION ALL SELECT ligand_id, 'R', 2, l_extendedprice + 1 FROM k WHERE l_returnflag <> 'R'""",
)
def ingest_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of two poses, then corrected ones of one pose for return flag R, which replace both; another run finds nothing new."""
    path, target, marks = (scratch_path(spark, n) for n in ("logs", "logs-table", "logs-marks"))
    lines = table(spark, sf, "lineitem")
    name = F.concat_ws("-", F.lit("L"), *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    pose = lambda k, score: F.concat(F.lit(f"\n   {k}   "), score.cast("string"), F.lit("   0.0   0.0"))
    head = F.concat(name, F.lit("_R\n-----+----"))

    def write(rows: DataFrame, folder: str, *poses) -> None:
        made = rows.select(F.concat(head, *poses)).write.options(lineSep="$$$$", **COMPACT)
        made.text(f"{path}/{folder}")

    def run() -> None:
        # many logs to a file, each with its name in the first line
        logs = spark.readStream.option("lineSep", "$$$$").text(f"{path}/*")
        named = logs.select(F.substring_index("value", "\n", 1).alias("stem"), "value", *ingest.origin())
        rows = tr.parse_dock_logs(named, ingest.ORIGIN)
        ingest.ingest(rows, target, marks, ["ligand_id", "receptor_id"], ["pose_no"], buckets=16).awaitTermination()

    good = F.col("l_extendedprice")
    write(lines, "a", pose(1, F.when(F.col("l_returnflag") == "R", good + 7).otherwise(good)), pose(2, good + 1))
    run()
    write(lines.where("l_returnflag = 'R'"), "b", pose(1, good))
    run()
    run()
    return ingest.read_newest(spark, target).select("ligand_id", "receptor_id", "pose_no", "score")
