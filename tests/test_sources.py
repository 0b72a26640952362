import json

import os

import pytest
from pyspark.sql import functions as F

from screenfunnel.operators import assays, poses
from screenfunnel.sources import files, sinks
from screenfunnel.sources import text_records as tr
from screenfunnel.streaming import ingest


def record(catalog, symbols=("C", "O", "H", "N"), counts="  4  3  0  0  0  0            999 V2000", eol="\n"):
    atoms = [f"    0.7145   -3.7125    0.0000 {s:<3s} 0  0" for s in symbols]
    props = [">  <Mw>", "265.31", ""]
    if catalog is not None:
        props += [">  <Catalog_ID>  (1)", catalog, ""]
    props += [">  <IUPAC Name>", "2-(2-ethoxy)", "", ">  <Class>", "Aldehydes\r", ""]
    return eol.join(["", "  made", "", counts, *atoms, "M  END", *props]) + eol


def test_scan_sdf(spark, tmp_path):
    parts = [
        record("EN1"), record(None), record("EN2", eol="\r\n"), record("EN1", ("C", "C", "C", "C")), "junk\n", record("EN3"),
    ]
    (tmp_path / "a.sdf").write_bytes("$$$$\n".join(parts).encode() + b"$$$$\n")
    df = files.scan_sdf(spark, str(tmp_path / "a.sdf"), "ALD")
    rows = sorted(df.collect(), key=lambda r: r.ID)
    assert [(r.ID, r.Catalog_ID) for r in rows] == [("ALD1", "EN1"), ("ALD2", "EN2"), ("ALD3", "EN3")]
    first = rows[0]
    assert (first.CAtm, first.HetAtm, first.HvyAtm, first.Atoms) == (1, 2, 3, 3)
    assert (first.Mw, first["IUPAC Name"], first.Class, first.URL) == ("265.31", "2-(2-ethoxy)", "Aldehydes", None)
    assert first.mol_block.endswith("M  END")
    with pytest.raises(ValueError):
        files.scan_sdf(spark, str(tmp_path / "a.sdf"), "A1")
    (tmp_path / "b.sdf").write_text("junk\n$$$$\n")
    with pytest.raises(ValueError):
        files.scan_sdf(spark, str(tmp_path / "b.sdf"), "A")


def response(*entries):
    return {"results": list(entries)}


def entry(code, *packs):
    return {"product": {"code": code}, "prices": {"g": {"all": list(packs)}}}


def pack(price, amount, measure):
    return {"price": price, "weight": {"amount": amount, "measure": measure}}


def test_scan_offers_skips_unusable_packs(spark, tmp_path):
    doc = response(
        entry("EN1", pack(50.0, 500, "mg"), pack(80.0, 2, "g"), pack(900.0, 1, "kg")),
        entry("EN2", pack(10.0, None, "g"), pack(None, 1, "g"), pack(10.0, 1, "ml"), pack(10.0, 0, "g"), {"price": 3.0}),
        entry(None, pack(1.0, 1, "g")),
        {"product": {"code": "EN3"}},
    )
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    got = sorted((r.code, r.pack_no, r.price_per_gram) for r in files.scan_offers(spark, str(tmp_path)).collect())
    assert got == [("EN1", 0, 100.0), ("EN1", 1, 40.0), ("EN1", 2, 0.9)]


HEADER = (
    "Molecule ChEMBL ID;Smiles;Standard Type;Standard Value;Standard Units;Standard Relation;BAO Label;Target ChEMBL ID"
)


def test_assays_with_and_without_header(spark, tmp_path):
    a = [
        HEADER.replace(";Smiles", "; Smiles "),
        "M1;;IC50;100;nM;'=';single protein format;T221", "M1;CC;ic50 ;300;NM;'>=';  Cell-Free Format ;T221",
        "M2;CO;IC50;abc;nM;'=';single protein format;T221", "M3;CN;Ki;5;nM;'=';single protein format;T221",
        "M4;CF;IC50;7;uM;'=';single protein format;T221", "M5;CF;IC50;7;nM;'<';single protein format;T221",
        "M6;CF;IC50;7;nM;'=';tissue-based format;T221", "M1;CCC;IC50;50;nM;'=';cell-based format;T230",
        "M7;;IC50;;nM;'=';cell-based format;T230",
    ]
    b = ["M1;CCO;IC50;70;nM;'=';cell-based format;T230", "M8;N;IC50;9;nM;'=';cell-based format;T230"]
    (tmp_path / "a.csv").write_text("\n".join(a) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(b) + "\n")
    read = files.scan_assays(spark, str(tmp_path)).withColumn("no", F.monotonically_increasing_id())
    assert read.count() == 11
    wanted = assays.target_filter(read, ["T221", "T230"], "Target ChEMBL ID", "Standard Type", "Standard Value").cache()
    assert wanted.count() == 9
    sides = {t: assays.assay_filter(wanted.filter(F.col("Target ChEMBL ID") == t)) for t in ("T221", "T230")}
    assert sides["T221"].count() == 2
    exact = assays.assay_filter(wanted.filter("`Target ChEMBL ID` = 'T221'"), exact_relation=True)
    assert exact.count() == 1
    got = assays.assay_summary(sides["T221"], sides["T230"], "Molecule ChEMBL ID", "Standard Value", "Smiles", "no")
    rows = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert rows["M1"][1:] == (200.0, 60.0, 200.0, 60.0)
    assert rows["M1"][0] in ("CCC", "CCO")  # the second target's text is preferred
    assert rows["M8"] == ("N", None, 9.0, None, 9.0)
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "b.csv").write_text("\n".join(b) + "\n")
    with pytest.raises(ValueError):
        files.scan_assays(spark, str(tmp_path / "bare"))


def test_assays_with_two_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Target ChEMBL ID;Standard Type;Standard Value\nT1;IC50;1\n")
    (tmp_path / "b.csv").write_text("Standard Value;Target ChEMBL ID;Standard Type\n2;T1;IC50\n")
    (tmp_path / "c.csv").write_text("T1;IC50;3\n")
    got = files.scan_assays(spark, str(tmp_path)).filter("`Target ChEMBL ID` = 'T1'")
    assert sorted(r["Standard Value"] for r in got.collect()) == ["1", "2", "3"]


def test_assays_of_mixed_headers_in_many_files(spark, tmp_path, monkeypatch):
    wide = '"Target ChEMBL ID"; Standard Type ;Standard Value;Smiles\r\n"T;1";IC50;{};"C""C"\r\n\r\n'
    narrow = "Note;Standard Value;Target ChEMBL ID;Standard Type\nn;{};T2;Ki\nshort\n;7\n"
    for i in range(150):
        (tmp_path / f"f{i:03d}.csv").write_text((wide if i % 3 == 0 else narrow if i % 3 == 1 else "T3;IC50;{};N;beyond\n").format(i), newline="")
    (tmp_path / "z.csv").write_text("")
    want = {("T;1", "IC50", str(i), None) for i in range(0, 150, 3)} | {("T2", "Ki", str(i), "n") for i in range(1, 150, 3)}
    want |= {("T3", "IC50", str(i), None) for i in range(2, 150, 3)} | {(None, None, None, "short"), (None, None, "7", None)}
    for sent in (files.SENT_FILES, 10):
        monkeypatch.setattr(files, "SENT_FILES", sent)
        got = files.scan_assays(spark, str(tmp_path))
        assert got.columns == ["Target ChEMBL ID", "Standard Type", "Standard Value", "Smiles", "Note"]
        rows = got.select("Target ChEMBL ID", "Standard Type", "Standard Value", "Note").collect()
        assert len(rows) == 250 and {tuple(r) for r in rows} == want
        # no path of a file stands in the plan
        assert "f000.csv" not in got._jdf.queryExecution().toString()


def test_assay_summary_and_attach(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "ChEMBL_ID; SMILES ;IC50_COX1_median;IC50_COX2_median;IC50_COX1_mean;IC50_COX2_mean\n"
        "M1; CC ;10;2;;\nM0;CC;10;;;\nM2;CO;10;0;8;4\nM3;;1;1;1;1\n"
    )
    summary = files.scan_assay_summary(spark, str(tmp_path / "s.csv"))
    products = spark.createDataFrame(
        [("P1", "CC", 9.0, 0.5, "none"), ("P2", " CC", 3.0, 0.5, "none"), ("P3", "CO", None, 0.5, "none"), ("P4", "CN", 1.0, 0.5, "none")],
        "ID string, SMILES string, PriceMol double, QED double, Violation string",
    )
    got = assays.attach_assays(products, summary, after="QED", before="Violation")
    assert got.columns == [
        "ID", "SMILES", "PriceMol", "QED", "IC50_COX1_median", "IC50_COX2_median", "SI_median", "IC50_COX1_mean",
        "IC50_COX2_mean", "SI_mean", "Violation",
    ]
    rows = {r.ID: (r.SI_median, r.SI_mean) for r in got.collect()}
    assert rows == {"P2": (5.0, None), "P3": (None, 2.0)}


LOG = """#### program
mode |   affinity | dist from best mode
-----+------------+----------+----------
   1       -8.497          0          0
   2       -8.492      3.112      6.405
   x       -8.4 0 0
   2.5     -8.4 0 0
   3 |     -7.9 |    1.0        2.0   extra
   4       -7.0
"""


def test_dock_logs(spark, tmp_path):
    (tmp_path / "A_1_6COX.log").write_text(LOG)
    (tmp_path / "B_3KK6.log").write_text("mode\n1 -8 0 0\n")
    (tmp_path / "C_6COX.log").write_text("Refine results\nmode affinity\n1 -5.0 0 0\n")
    (tmp_path / "D_6COX.log").write_text("-----\n")
    (tmp_path / "nounderscore.log").write_text(LOG)
    got = sorted(tuple(r) for r in files.scan_dock_logs(spark, str(tmp_path)).collect())
    assert got == [
        ("A_1", "6COX", 1, 1, -8.497, 0.0, 0.0), ("A_1", "6COX", 2, 2, -8.492, 3.112, 6.405),
        ("A_1", "6COX", 3, 3, -7.9, 1.0, 2.0), ("C", "6COX", 1, 1, -5.0, 0.0, 0.0),
    ]
    counts = {(r.ligand_id, r.receptor_id): r.n_poses for r in files.scan_log_summary(spark, str(tmp_path)).collect()}
    assert counts == {("A_1", "6COX"): 3, ("B", "3KK6"): 0, ("C", "6COX"): 1, ("D", "6COX"): 0}
    table = files.scan_dock_logs(spark, str(tmp_path))
    spread = {r.ligand_id: r.pose_spread for r in poses.pose_spread(table, ["ligand_id", "receptor_id"]).collect()}
    assert spread == {"A_1": 6.405, "C": 0.0}
    best = {r.ligand_id: r.docking_score for r in poses.best_score(table, ["ligand_id", "receptor_id"], "pose_no").collect()}
    assert best == {"A_1": -8.5, "C": -5.0}


POSE = """MODEL 1
REMARK VINA RESULT:    -9.362      0.000      0.000
ROOT
ATOM      1  C   UNL     1      21.926  24.064  45.961  1.00  0.00     0.192 C
ENDMDL
MODEL 2
HETATM    1  C   UNL     1     -21.926  24.064-145.961  1.00  0.00     0.192 C
ATOM      2  C   UNL     1      22.176    bad   47.277  1.00  0.00     0.136 C
ENDMDL
"""


def test_pose_files(spark, tmp_path):
    (tmp_path / "A_1_6COX_out.pdbqt").write_text(POSE)
    (tmp_path / "B_6COX.pdbqt").write_text("ATOM      1  C   UNL     1       1.000   2.000   3.000\n")
    got = sorted((r.ligand_id, r.receptor_id, r.model, r.x, r.y, r.z) for r in files.scan_pose_atoms(spark, str(tmp_path)).collect())
    assert got == [
        ("A_1", "6COX", 1, 21.926, 24.064, 45.961), ("A_1", "6COX", 2, -21.926, 24.064, -145.961), ("B", "6COX", 0, 1.0, 2.0, 3.0),
    ]
    info = {r.ligand_id: (r.n_bytes, r.has_marker) for r in files.scan_pose_files(spark, str(tmp_path)).collect()}
    assert info == {"A_1": (len(POSE), True), "B": (55, False)}


PDB = """HEADER    MADE
ATOM      1  CA  ARG A 120      10.000  20.000  30.000  1.00  0.00
ATOM      2  NH1 ARG A 120      11.000  20.000  30.000  1.00  0.00
ATOM      3  OH  TYR B 355      12.000  20.000  30.000  1.00  0.00
HETATM    4  C1  S58 A 701      13.000  21.000  31.000  1.00  0.00
HETATM    5  C2  S58 A 701      15.000  23.000  33.000  1.00  0.00
HETATM    6  O   HOH A 801      14.000  20.000  30.000  1.00  0.00
ATOM      7  CA  MSE B   8      15.000  20.000  30.000  1.00  0.00
ATOM      8  CA  ALA A  xx      15.000  20.000  30.000  1.00  0.00
"""


def test_structures(spark, tmp_path):
    from screenfunnel.operators import contacts

    (tmp_path / "6COX.pdb").write_text(PDB)
    atoms = files.scan_structure_atoms(spark, str(tmp_path)).cache()
    assert atoms.count() == 7
    assert {(r.atom, r.residue, r.chain, r.resnum) for r in tr.clean_structure(atoms).collect()} == {
        ("CA", "ARG", "A", 120), ("NH1", "ARG", "A", 120), ("OH", "TYR", "B", 355),
    }
    assert sorted(r.residue_key for r in tr.nonstandard_residues(atoms).collect()) == ["A:701", "B:8"]
    centre = contacts.ligand_centre(atoms, atoms, "structure_id", F.col("residue") == "S58")
    box = contacts.search_box(centre, "structure_id").first()
    assert (box.center_x, box.center_y, box.center_z, box.size_x) == (14.0, 22.0, 32.0, 24.0)
    other = contacts.ligand_centre(atoms, atoms, "structure_id", F.col("residue") == "FLC").first()
    assert (other.center_x, other.source) == (73.0, "fallback")
    with pytest.raises(ValueError):
        contacts.search_box(centre, "structure_id", override=spark.createDataFrame([("6COX", 1.0)], "structure_id string, center_x double"))


def test_rescores(spark, tmp_path):
    (tmp_path / "a_mmgbsa.csv").write_text("complex_id,delta_G_bind_kcal_mol,std_kcal_mol\nc1,-40.5,1.5\nc2,oops,1\n")
    (tmp_path / "b_mmgbsa.csv").write_text("std_kcal_mol,delta_G_bind_kcal_mol\n2.0,-30.0\n")
    (tmp_path / "c_mmgbsa.csv").write_text("")
    got = sorted(tuple(r) for r in files.scan_rescores(spark, str(tmp_path)).collect())
    assert got == [("b", -30.0, 2.0), ("c1", -40.5, 1.5)]


def test_catalogue(spark, tmp_path):
    from screenfunnel.operators.screen import read_catalogue

    (tmp_path / "c.csv").write_text('tier,ord,family,name,pattern\n2,1,PAINS(a),x,"a,b"\n1,2,Brenk,z,c\n1,1,Brenk,y,d\n')
    alerts = read_catalogue(files.scan_catalogue(spark, str(tmp_path / "c.csv")))
    assert [(a.family, a.name, a.pattern) for a in alerts] == [("Brenk", "y", "d"), ("Brenk", "z", "c"), ("PAINS(a)", "x", "a,b")]


def test_materialise(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "stage")
    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.materialise(spark, path, params, compute).count() == 5
    assert len(calls) == 2
    sinks.materialise(spark, path, {"a": 2}, compute, force=True)
    assert len(calls) == 3
    sinks.materialise(spark, path, {"a": 2}, compute)
    assert len(calls) == 3  # the parameters of the forced run were kept


def test_materialise_split_checks_rows(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        df = spark.range(10)
        return df.filter("id < 4"), df.filter("id >= 4").withColumn("why", F.lit("big"))

    path = str(tmp_path / "split")
    for rows in (10, 10, 11, None):
        accepted, rejected = sinks.materialise_split(spark, path, {}, compute, rows)
        assert (accepted.count(), rejected.count()) == (4, 6)
    assert len(calls) == 2
    assert {r.why for r in rejected.collect()} == {"big"}


def test_counted_and_by_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert sinks.write_counted(df, str(tmp_path / "x"), ["id"], {"id": "ID"}, fmt="csv") == 2
    assert files.scan_products(spark, str(tmp_path / "x"), "csv").columns == ["ID"]
    spark.range(1).selectExpr("cast(id as string) as ID").write.mode("append").csv(str(tmp_path / "x/data"), header=True)
    with pytest.warns(UserWarning, match="manifest says 2"):
        files.scan_products(spark, str(tmp_path / "x"), "csv")
    sinks.write_by_key(df, "t", str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["_part=a", "_part=b"]
    sinks.save_candidates(df.withColumnRenamed("t", "ligand_id"), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["a", "b"]
    sinks.save_rescores(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_append_adds_nothing_twice(spark, tmp_path):
    target = str(tmp_path / "t")
    write = ingest.append_new(target, ["k"])
    for batch_id, keys in enumerate(([1, 2], [2, 3], [2, 3])):
        write(spark.createDataFrame([(k,) for k in keys], "k long"), batch_id)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, target, marks = tmp_path / "logs", str(tmp_path / "t"), str(tmp_path / "m")
    src.mkdir()
    (src / "A_6COX.log").write_text(LOG)
    run = lambda: ingest.ingest_logs(spark, str(src), target, marks, 4).awaitTermination()
    run()
    assert ingest.read_newest(spark, target).count() == 3
    (src / "B_6COX.log").write_text(LOG)
    run()
    run()
    assert ingest.read_newest(spark, target).count() == 6
    assert ingest.read_newest(spark, target).columns == ["ligand_id", "receptor_id", "pose_no", "rank", "score", "rmsd_lb", "rmsd_ub"]


def test_a_corrected_log_replaces_its_poses(spark, tmp_path):
    target, marks = str(tmp_path / "t"), str(tmp_path / "m")
    for k, name in enumerate(("first", "second", "late")):
        (tmp_path / "logs" / name).mkdir(parents=True)
    run = lambda: ingest.ingest_logs(spark, str(tmp_path / "logs" / "*"), target, marks, 8).awaitTermination()
    poses = lambda: {
        name: sorted(r.score for r in ingest.read_newest(spark, target).collect() if r.ligand_id == name) for name in ("A", "B")
    }
    for name in ("A", "B"):
        (tmp_path / "logs" / "first" / f"{name}_6COX.log").write_text(LOG)
    run()
    before = poses()
    others = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("*/*.parquet")}
    assert before["A"] == before["B"] and len(before["A"]) == 3
    fixed = tmp_path / "logs" / "second" / "A_6COX.log"
    fixed.write_text("-----+---\n   1   -9.5   0.0   0.0\n")
    os.utime(fixed, (4e9, 4e9))
    run()
    assert poses() == {"A": [-9.5], "B": before["B"]}
    # folders that the batch does not reach are neither read nor written
    assert any(p.exists() and p.stat().st_mtime_ns == t for p, t in others.items())
    # an older file that comes late changes nothing
    late = tmp_path / "logs" / "late" / "A_6COX.log"
    late.write_text(LOG)
    os.utime(late, (1e9, 1e9))
    run()
    assert poses() == {"A": [-9.5], "B": before["B"]}


def test_upsert_survives_a_break_and_reads_few_folders(spark, tmp_path):
    target, marks = str(tmp_path / "t"), str(tmp_path / "m")
    rows = lambda made, n: spark.range(n).selectExpr(
        "id AS u", "id % 3 AS v", f"timestamp_seconds({made}) AS _modified", f"'f{made}' AS _file"
    )
    write = ingest.upsert_newest(target, marks, ["u"], ["v"], 16)
    write(rows(1, 100), 0)
    write(rows(2, 1).withColumn("v", F.lit(7).cast("long")), 1)
    found = {r.u: r.v for r in ingest.read_newest(spark, target).collect()}
    assert len(found) == 100 and found[0] == 7 and found[5] == 2
    plan = ingest.stored_rows(spark, target, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    assert {r[0] for r in ingest.stored_rows(spark, target, [3]).select("_bucket").distinct().collect()} == {3}
    # the folders of the last batch are lost while they are replaced; the batch is run again, though its rows are gone
    bucket = spark.range(1).select(F.pmod(F.hash("id"), F.lit(16))).first()[0]
    for part in (tmp_path / "t" / f"_bucket={bucket}").glob("*"):
        part.unlink()
    write(rows(2, 0), 1)
    assert {r.u: r.v for r in ingest.read_newest(spark, target).collect()} == found
    # a batch without rows changes nothing
    write(rows(3, 0), 2)
    assert ingest.read_newest(spark, target).count() == 100


def test_newest_of_ties_and_nulls(spark):
    rows = spark.createDataFrame(
        [(None, 1, 1, "a"), (None, 2, 2, "a"), ("x", 1, 1, "a"), ("x", 1, 1, "a"), ("x", 5, 1, "b"), ("x", 6, 1, "b")],
        "u string, v int, m int, _file string",
    ).selectExpr("u", "v", "timestamp_seconds(m) AS _modified", "_file")
    assert sorted(((r.u or ""), r.v) for r in ingest.newest_per_unit(rows, ["u"], ["v"]).collect()) == [("", 2), ("x", 5), ("x", 6)]


def test_rows_of_a_small_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """What is made of the rows of one file is not one task's work."""
    from screenfunnel.queries import base, structures

    monkeypatch.setattr(base, "TASK_ROWS", 100)
    spark.range(1000).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "5 AS p_size", "1D AS p_retailprice"
    ).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tasks = structures.part_records(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 10 and max(r["count"] for r in tasks) < 500


def test_a_merge_moves_its_rows_once(spark):
    """Both steps of a merge, null units included, are done where the first shuffle by unit has put the rows."""
    rows = spark.range(2000).selectExpr(
        "IF(id % 7 = 0, NULL, concat('u', id % 50)) AS u", "id % 11 AS v", "timestamp_seconds(id % 3) AS _modified", "concat('f', id % 2) AS _file"
    )
    newest = ingest.newest_per_unit(rows.repartition(8, "u"), ["u"], ["v"])
    found = sorted((r.u or "", r.v) for r in newest.collect())
    held = [(r.u, r.v, (r._modified, r._file)) for r in rows.collect()]
    last = {u: max(o for w, _, o in held if w == u) for u, _, _ in held}
    assert found == sorted({(u or "", v) for u, v, o in held if o == last[u]})
    plan = newest._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1


def test_ingest_after_a_first_batch_that_was_cut_off(spark, tmp_path):
    """What is left of it is a folder without rows, or some of its folders."""
    rows = spark.range(60).selectExpr("id AS u", "id % 3 AS v", "timestamp_seconds(1) AS _modified", "'f' AS _file")
    target = tmp_path / "t"
    (target / ".spark-staging-1").mkdir(parents=True)
    write = ingest.upsert_newest(str(target), str(tmp_path / "m"), ["u"], ["v"], 4)
    write(rows, 0)
    for part in (target / "_bucket=2").glob("*"):
        part.unlink()
    write(rows, 0)
    assert sorted((r.u, r.v) for r in ingest.read_newest(spark, str(target)).collect()) == [(u, u % 3) for u in range(60)]
    assert not list((tmp_path / "t").glob("*/*.snappy.parquet"))


def test_made_files_of_the_ingest_queries_are_compressed(spark, tmp_path, monkeypatch):
    """The texts that stand for price responses and logs are the most that these queries write."""
    from screenfunnel.queries import routes, structures

    for module in (routes, structures):
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: str(tmp_path / name))
    structures.offers_ingest(spark, "/root/testdata/sf0.001")
    routes.ingest_logs(spark, "/root/testdata/sf0.001")
    for made in ("offers/*", "logs/*/*"):
        names = [p.name for p in tmp_path.glob(made) if p.name.startswith("part-")]
        assert names and all(n.endswith(".gz") for n in names)


def test_pose_lines_with_tabs_and_names_of_columns(spark):
    """Tabs and bars part the numbers wherever they stand; a line that names a column, before or behind its numbers, is no pose."""
    lines = [
        "\t1\t-7.5\t0.0\t0.5", " | 2 | -6e0 |.5|1.", "3 -5.0 1.0 2.0 Mode", "4 -4.0 1.0 2.0\taffinity (kcal)", "AFFINITY 5 -3.0 1.0 2.0",
        "6 -2.0 1.0 2.0mode", "7 -1.0 1.0", "+8 -1.5 1.0 2.0 more\r", "Refine 9 -1.0 1.0 1.0", "10 +.25 3 4",
    ]
    logs = spark.createDataFrame([("A_R", "1 -9 0 0\n  -----+---\n" + "\n".join(lines)), ("B_R", "Refine\n1 -2 3 4"), ("C_R", "1 -2 3 4\n-----")], "stem string, value string")
    found = sorted((r.ligand_id, r.pose_no, r["rank"], r.score, r.rmsd_lb, r.rmsd_ub) for r in tr.parse_dock_logs(logs).collect())
    assert found == [
        ("A", 1, 1, -7.5, 0.0, 0.5), ("A", 2, 2, -6.0, 0.5, 1.0), ("A", 3, 8, -1.5, 1.0, 2.0), ("A", 4, 10, 0.25, 3.0, 4.0), ("B", 1, 1, -2.0, 3.0, 4.0)
    ]
    assert sorted((r.ligand_id, r.n_poses) for r in tr.log_summary(logs).collect()) == [("A", 4), ("B", 1), ("C", 0)]
