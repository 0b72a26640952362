"""Corpus queries with SQL against DuckDB, and the others against what their contract says, on the smallest tables."""

import hashlib
import os
import re
import zlib

import pytest
from oracle import compare, connect

import corpus_pipeline
from screenfunnel.llm.queries import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_against_sql(spark, con, name):
    assert compare(REGISTRY[name].build(spark, SF), con, REGISTRY[name].sql) is None


def test_all_operators_and_the_pipeline():
    assert sorted({int(n[2:].split("_")[0]) for n in REGISTRY if n.startswith("op")}) == list(range(1, 14))
    assert "pipeline" in REGISTRY and len(corpus_pipeline.STAGES) == 5


def test_languages_are_learned(spark, con):
    rows = {r["doc_id"]: r for r in REGISTRY["op1_language_id"].build(spark, SF).collect()}
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert rows.keys() == langs.keys()
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [k for k, r in rows.items() if r["held_out"]]
    assert sum(rows[k]["lang_pred"] == langs[k] for k in out) >= 0.95 * len(out)


def test_secret_base_spans(spark, docs):
    def base(text):
        spans = []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            spans += [("assign", *m.span())] if len(m[2]) >= 6 else []
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))

    rows = REGISTRY["op5_secret_scan"].build(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}


def test_packing_is_gapless_and_exact(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    import numpy as np

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs.items()}
    rows = REGISTRY["op6_packing"].build(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for k, want in ids.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(want)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_main_text_is_the_article(spark, con):
    """The test pages have one article each; everything in it is main text and nothing else is."""
    from screenfunnel.llm.blocks import read_blocks

    rows = {r["page_id"]: r for r in REGISTRY["op7_html_main_text"].build(spark, SF).collect()}
    for page, html in con.execute("SELECT page_id, html FROM pages").fetchall():
        want = "\n".join(b.text for b in read_blocks(html) if any(t == "article" for t, _ in b.path))
        assert rows[page]["text"] == want and rows[page]["n_chars"] == len(want)


def test_license_lines(spark, con):
    rows = REGISTRY["op8_license_scan"].build(spark, SF).collect()
    lines = ["GNU General Public License, version 3", "All rights reserved", "CC BY-NC 4.0", "the MIT License", "the Apache License, Version 2.0"]
    counts = [con.execute("SELECT count(*) FROM documents WHERE contains(text, ?)", [x]).fetchone()[0] for x in lines]
    names = ["GPL-3.0 notice", "All rights reserved", "CC-BY-NC-4.0 notice", "MIT notice", "Apache-2.0 notice"]
    assert [sum(n in r["licenses"] for r in rows) for n in names] == counts and sum(counts) > 0


def test_training_order_is_a_permutation(spark):
    rows = REGISTRY["op10_training_order"].build(spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sorted(r["sequence"] for r in rows) == list(range(len(rows)))
    assert any(r["slot"] != r["sequence"] for r in rows)


def _similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def _shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_pipeline_against_brute_force(spark, con, tmp_path):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    good = {r["doc_id"] for r in REGISTRY["op9_quality_rules"].build(spark, SF).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["quality rules"]} == good
    groups = {}
    for r in kept["quality rules"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r["text"]), []).append(r)
    best = {min(g, key=lambda r: (-len(r["text"]), r["doc_id"]))["doc_id"] for g in groups.values()}
    assert {r["doc_id"] for r in kept["exact dedup"]} == best
    sets = {r["doc_id"]: _shingles(r["text"], 5) for r in kept["exact dedup"]}
    root = {k: k for k in sets}
    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if root[a] != root[b] and _similar(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in kept["near dedup"]} == set(root.values())
    copies = {}
    for r in kept["mixing"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= set(root.values())
    tokens = {}
    for r in kept["packing"]:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    lengths = {r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}
    assert tokens == {k: n * lengths[k] for k, n in copies.items()}
