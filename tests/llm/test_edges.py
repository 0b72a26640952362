"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import base64
import gzip
import random
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfunnel.llm import binary, exact, graph, htmltext, langid, licenses, minhash, mixing, packing, quality, secrets, wordbpe
from screenfunnel.llm.blocks import read_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, row string, key string, gone string, u double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "q", "r", "k", "g", 0.5) for i, t, lang, s in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 20_000)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, long, "en", "a"), (5, long, "en", "b"), (5, long, "en", "b"),
        (None, "a text without an id, and so on and so forth for ever", "en", "b"), (None, None, "de", "b"), (6, "one", "de", None),
        (7, "12 34 !!", "de", "a"), (8, prose(2, 30), "de", "b"), (8, prose(3, 30), "de", "b"),
    ]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_quality(odd, none):
    out = quality.quality_rules(odd).collect()
    assert len(out) == 12 and all(r["quality"]["base_failed"] for r in out if r["text"] is None)
    assert set(out[0].asDict()) == set(odd.columns)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, None, 8}
    assert quality.keep_good(none).count() == 0


def test_quality_of_small_and_other_languages(spark):
    """A language is measured by its own reference, or not at all: never by the nearest other one."""
    rng = random.Random(4)

    def text(letters, common, n):
        made = ("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n))
        return " ".join(rng.choice(common) if common and rng.random() < 0.4 else w for w in made)

    english = [(k, text("abcdefghij", quality.COMMON_WORDS["en"], 200), "en", "a") for k in range(20)]
    german = [(100, text("abcdefghij", quality.COMMON_WORDS["de"], 200), "de", "a")]
    russian = [(200 + k, text("абвгдежзик", None, 200), "ru", "a") for k in range(8)]
    chinese = [(300, text("的一是不了人我在有他", None, 200), "zh", "a")]
    junk = [(400, text("#*$%&|<>", None, 200), "ru", "a"), (401, text("abcdefghij", None, 200), "en", "a"), (402, text("абвгд", None, 200), None, "a")]
    rows = english + german + russian + chinese + junk
    out = {r["doc_id"]: r["quality"] for r in quality.quality_rules(table(spark, rows)).collect()}
    assert len(out) == len(rows) and {k for k, q in out.items() if not q["kept"]} == {400, 401, 402}
    assert all(out[k]["char_distance"] is None and out[k]["word_distance"] is None for k in (100, 300))
    assert all(out[k]["char_distance"] <= 0.27 and out[k]["word_distance"] <= 0.4 for k in range(200, 208)), out[200]
    assert {r["doc_id"] for r in quality.keep_good(table(spark, rows)).collect()} == out.keys() - {400, 401, 402}


def test_repeat_words(spark):
    texts = ["a b c d e f a b c d e", "a a a a a a", "a b c d e", "x " * 4, "a b c d e a b c d e f g"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(quality.repeat_words(F.split(F.trim("t"), " "))).collect()]

    def brute(w):
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, g in enumerate(win) if win.count(g) > 1 for k in range(5)})

    assert got == [brute(t.split()) for t in texts]


def test_exact(odd, none):
    out = exact.exact_duplicates(odd).collect()
    assert len(out) == 12 and sum(r["kept"] for r in out) == 7
    blank = [r for r in out if r["group_size"] == 4]
    assert {r["doc_id"] for r in blank} == {1, 2, 3, None} and {r["keep_id"] for r in blank} == {3}
    kept = exact.keep_first_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7 and {r["doc_id"] for r in kept.collect()} == {3, 4, None, 6, 7, 8}
    assert exact.exact_duplicates(none).count() == exact.keep_first_copies(none).count() == 0


def test_cuckoo_index_grows_and_forgets():
    index, rng = exact.CuckooIndex(2), random.Random(5)
    live = [rng.randbytes(32) for _ in range(3000)]
    for k, d in enumerate(live):
        assert index.find(d) is None
        index.put(d, k)
    assert index.size == 3000 and index.mask + 1 > 2
    assert all(index.remove(d) for d in live[::2]) and not index.remove(live[0])
    assert all((index.find(d) is None) == (k % 2 == 0) for k, d in enumerate(live))
    twin = live[1][:10] + bytes(22)
    assert index.may_hold(twin) and index.find(twin) is None


def test_index_is_kept_up(spark):
    rows = spark.createDataFrame([(bytes([k]) * 32, 5, k, k) for k in range(6)], "digest binary, n_points long, doc_id long, row long")
    live = exact.build_index(rows)
    more = spark.createDataFrame([(bytes([2]) * 32, 9, 99, 7)], rows.schema)
    now = {r["doc_id"]: r["copies"] for r in exact.build_index(more, live, rows.where("doc_id < 2").select("digest")).collect()}
    assert now == {99: 2, 3: 1, 4: 1, 5: 1}


def test_near(odd, none):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == 12
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in out if r["doc_id"] in (1, 2, 3))
    assert {(r["component_id"], r["kept"]) for r in out if r["doc_id"] == 5} == {(4, False)}
    kept = minhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, None, 6, 7, 8}
    assert minhash.near_duplicates(none).count() == minhash.keep_one_of_each(none).count() == 0


def test_near_chain_and_star_lose_no_link(spark):
    """Copies of one text that differ from it, and more from each other, and a chain whose ends are not alike."""
    base = prose(9, 400).split()
    rows = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for i in range(k, 400, 60):
            w[i] = f"new{k}x{i}"
        rows.append((k, " ".join(w)))
    chain = prose(10, 300).split()
    for k in range(12):
        rows.append((2000 + k, " ".join(chain)))
        chain = chain[:]
        chain[k * 20 : k * 20 + 6] = [f"c{k}y{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spec = minhash.NearDup(words=2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, spec).collect()}
    hashes = minhash._Words()
    sets = {k: set(minhash.shingle_set(t.encode(), 2, hashes).tolist()) for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == root


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs * 70:
        if a != b:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    for _ in range(300):
        root = {k: root[v] for k, v in root.items()}
    assert got == root


def test_mixing(odd, none):
    sized = mixing.sized_rows(odd).cache()
    out = mixing.take(sized, mixing.mixing_plan(sized.drop("row"))).collect()
    assert len(out) == 12 and all(r["copies"] <= 3 for r in out) and all(r["copies"] == 0 for r in out if r["size"] == 0)
    total = sum(r["size"] for r in out)
    targets = {r["row"]["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 and all(t <= 3 * n for t, n in targets.values())
    assert mixing.mixture(odd).columns == odd.columns and mixing.mixture(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(["w"] * rng.randint(1, 400)), "en", rng.choice("aaaaaabcd")) for k in range(2000)]
    sized = mixing.sized_rows(table(spark, rows)).cache()
    out = mixing.take(sized, mixing.mixing_plan(sized.drop("row"))).collect()
    for source in "abcd":
        mine = [r for r in out if r["row"]["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 5


def test_secrets_in_layers(odd, none):
    key = "AKIA" + "B" * 18
    inner = base64.b64encode(gzip.compress(f"x {key} y".encode())).decode()
    text = f"see {urllib.parse.quote(inner, safe='')} and \\u0074oken=%61bcdefg and {base64.b64encode(base64.b64encode(b'password: hunter22!!')).decode()}"
    found = secrets.find_secrets(text)
    assert {f[0] for f in found if f[3]} == {"access", "assign"}
    assert any(f[4] == key and "base64+zip" in f[3] for f in found)
    token = next(f for f in found if f[4] == "token=abcdefg")
    assert text[token[1] : token[2]] == "\\u0074oken=%61bcdefg"
    assert any(f[3] == "base64>base64" and f[4].startswith("password: hunter22") for f in found)
    quine = "%2525" * 50
    assert secrets.find_secrets(quine) == []
    out = secrets.summary(secrets.scan_secrets(odd)).collect()
    assert len(out) == 12 and all(r["spans"] == "" for r in out) and secrets.scan_secrets(none).count() == 0


def test_secrets_at_every_place():
    """An encoded secret that stands several times, in the same or another encoding, is found at each place."""
    plain = b"\xc3\xbf?>>~ password: hunter22!! \xc3\xbf?>>~"
    blob, safe, packed = base64.b64encode(plain), base64.urlsafe_b64encode(plain), base64.b64encode(gzip.compress(plain, mtime=0))
    assert blob != safe
    runs = [x.decode() for x in (blob, blob, safe, packed, base64.b64encode(blob), blob)]
    text = " and ".join(runs)
    places, at = [], 0
    for run in runs:
        places.append((text.index(run, at), text.index(run, at) + len(run)))
        at = places[-1][1]
    found = [f for f in secrets.find_secrets(text) if f[4] == "password: hunter22"]
    assert [(f[1], f[2]) for f in found] == places
    assert [f[3] for f in found] == ["base64", "base64", "base64", "base64+zip", "base64>base64", "base64"]


def test_secrets_in_wrapped_odd_and_packed_runs():
    plain = "note\n" + prose(7, 40) + "\npassword: hunter22!!"

    def ways(text):
        return {(f[1], f[2]) for f in secrets.find_secrets(text) if f[4] == "password: hunter22"}

    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = [gzip.compress(plain.encode(), mtime=k) for k in range(1, 9)] + [zlib.compress(plain.encode()), raw.compress(plain.encode()) + raw.flush()]
    for data in [*packed, plain.encode()]:
        for code in (base64.b64encode, base64.urlsafe_b64encode):
            run = code(data).decode()
            for width, indent in ((76, ""), (64, "  "), (40, "\t"), (len(run) - 1, ""), (len(run) - 3, "")):
                wrapped = f"\n{indent}".join(run[k : k + width] for k in range(0, len(run), width))
                assert ways(f"x:\n{indent}{wrapped}\nThe end.") == {(3 + len(indent), 3 + len(indent) + len(wrapped))}, (width, run)
    for text in (f"{plain}\xa0\u3000\u200b", f"\ufeff{plain}", f"\x00{plain}"):
        assert len(ways(base64.b64encode(text.encode()).decode())) == 1
    for codec in ("utf-16", "utf-16-le", "utf-16-be", "latin-1"):
        assert len(ways(base64.b64encode(f"{plain} ü".encode(codec)).decode())) == 1
    cut = gzip.compress(plain.encode() + random.Random(1).randbytes(4000))[:-1000]
    for data in (gzip.compress(b"first") + packed[0], cut, gzip.compress(packed[0])):
        assert len(ways(base64.b64encode(data).decode())) == 1
    large = gzip.compress(bytes(b" " * (secrets.WINDOW - 9)) + plain.encode() + b" " * (70 << 20) + b"\ntoken=abcdefgh")
    found = secrets.find_secrets(base64.b64encode(gzip.compress(large)).decode() + " " + base64.b64encode(large).decode())
    assert len(found) == 2 and all(f[0] == "assign" and f[3] == "base64+zip" for f in found)


def test_secrets_beside_codes_that_cannot_be_decoded():
    secret = "password=hunter22"
    percent = "".join(f"%{ord(c):02X}" for c in secret)
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    for text, bad in (("%FF" + percent, 3), ("\\ud800" + escaped, 6), (percent + "%C3", 0), (escaped + "\\udc00\\U0011FFFF", 0)):
        size = len(percent if "%" in text else escaped)
        assert [f[:3] for f in secrets.find_secrets("see " + text)] == [("assign", 4 + bad, 4 + bad + size)]
    # characters of several codes keep exact places beside a bad one
    assert [f[:3] for f in secrets.find_secrets("%C3%BC%FF" + percent)] == [("assign", 9, 9 + len(percent))]
    # a pair of surrogates is one character, and what follows it is not lost
    assert [f[4] for f in secrets.find_secrets("\\ud83d\\ude00" + escaped + "\\ude00")] == [secret]
    assert secrets.find_secrets("%FF%FE \\ud800\\ud800") == []


def test_secrets_in_runs_over_window_ends():
    noise = random.Random(3).randbytes(180_000)
    inner = base64.b64encode(gzip.compress(noise.hex().encode() + b" token=abcdefgh1 ")).decode()
    assert len(inner) > 2 * secrets.SHARED
    for before in (100, secrets.WINDOW - 100_000, secrets.WINDOW - 10):
        outer = base64.b64encode(("word, " * (before // 6) + inner + ", end. " * 50_000).encode()).decode()
        found = secrets.find_secrets("x " + outer)
        assert [f[:3] for f in found if f[0] == "assign"] == [("assign", 2, 2 + len(outer))], before


def test_tokens_are_the_tokenizers():
    import public_tokenizers

    bpe = wordbpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), most=500)
    rng = random.Random(1)
    odd = ["it's I'LL", "ǅ ẞ Σας ΑΣ İ", "a<|endoftext|>b", "a\tb\x0bc d\x85e\xa0f", "é ́ x", "日本 😀👍🏽", "", " \n", "\x1cfoo\x1d"]
    odd += ["".join(rng.choice("abC 'sS.,\n\té€ß12_<|>́İΣ") for _ in range(30)) for _ in range(500)]
    for text in odd:
        bpe.tidy()
        assert bpe.ids(bpe.chunks(text)).tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(odd, none):
    rows = packing.pack(odd, with_ids=True, shard_docs=5).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["length"] for r in rows if r["start"] == 0) > 0 and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert packing.pack(none).count() == 0


def test_neighbours_are_lexical():
    docs = [np.array(x) for x in ([1, 2, 3, 50], [4, 5, 6], [1, 2, 9, 50], [4, 5, 7], [8, 8, 8])]
    index = packing.Bm25Shard(docs)
    index.unused[0] = False
    assert index.neighbours(0).tolist() == [2] and index.neighbours(1)[1:].tolist() == [3] or index.neighbours(1)[0] == 1


def test_html(spark):
    pages = [
        (1, "u", "<body><nav><a>home</a></nav><article><h1>T &amp; T</h1><p>One <b>two</b>\n three.<p>Four<br>five.<div class=ad>Buy</div></article><footer>x</footer>"),
        (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", "plain words only, without a tag in sight, but a sentence."),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = htmltext.main_text(df).collect()
    assert len(out) == 5 and out[0]["text"] == "T & T\nOne two three.\nFour five."
    assert [r["text"] for r in out[1:3]] == ["", ""] and htmltext.main_text(df.limit(0)).count() == 0


def test_blocks_of_broken_html():
    html = "<ul><li>a<li>b</ul></p><table><tr><td>c<td>d</table><p>e<p>f</b><script>var x='<p>no</p>'</script><!-- no --> g"
    assert [b.text for b in read_blocks(html)] == ["a", "b", "c", "d", "e", "f", "g"]


def test_blocks_after_foreign_elements():
    page = "<article><p>Intro</p>{}<p>Body one</p><p>Body two</p></article>"
    for foreign in ("<svg/>", '<svg class="i" />', "<math/>", "<svg><path d='M0'/><g/></svg>", "<p>a <svg><use/></svg></p>"):
        texts = [b.text for b in read_blocks(page.format(foreign))]
        assert [t for t in texts if t != "a"] == ["Intro", "Body one", "Body two"]
    # other elements do not end themselves
    assert [b.text for b in read_blocks("<script/>x</script><div/>kept")] == ["kept"]


def test_labeller_on_new_pages():
    model = htmltext.trained()
    right = total = 0
    for x, y in htmltext.labelled_pages(60, 123):
        chance = htmltext.predict(model, x[None], np.ones((1, len(x)), np.float32))[0]
        right, total = right + ((chance > 0.5) == (y > 0.5)).sum(), total + len(y)
    assert right >= 0.97 * total


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in htmltext._start(3, 0).items()}
    x, mask = rng.normal(size=(2, 4, htmltext.SIZE)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        q = htmltext.predict(p, x, mask)
        return -((y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / mask.sum()

    grads = htmltext._step(p, x, mask, y)
    for name in ("whf", "whb", "bf", "out"):
        at = tuple(int(rng.integers(n)) for n in p[name].shape)
        p[name][at] += 1e-4
        up = loss()
        p[name][at] -= 2e-4
        down = loss()
        p[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-4


def test_languages(odd, none, spark):
    model = langid.fit_language_model(odd)
    out = langid.identify_languages(odd, model).collect()
    assert len(out) == 12
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3, 7))
    assert all(r["lang_pred"] in ("de", "en") for r in out if r["doc_id"] in (4, 6, 8))
    empty = langid.fit_language_model(none)
    assert {r["lang_pred"] for r in langid.identify_languages(odd, empty).collect()} == {"und"}


def test_language_sample_is_bounded(spark, monkeypatch):
    """Labelled rows that share one id, null ids and a row repeated very often: no more than the bound reach the driver, and the
    model still learns."""
    rng = random.Random(6)
    words = {"aa": "abcde", "bb": "vwxyz"}
    made = [(7, " ".join("".join(rng.choice(words[k]) for _ in range(5)) for _ in range(8)), k, "s") for _ in range(2000) for k in words]
    made += [(None, t, k, "s") for _, t, k, _ in made[:100]] + [made[0]] * 3000
    seen = []
    fit = langid.fit_ftrl
    monkeypatch.setattr(langid, "fit_ftrl", lambda data, n, s: seen.append(len(data)) or fit(data, n, s))
    model = langid.fit_language_model(table(spark, made), langid.LangSettings(sample=200, kept_back=0.0))
    assert 100 <= seen[0] <= 2 * 200 + 2
    out = langid.identify_languages(table(spark, [(i, t, None, "s") for i, (_, t, _, _) in enumerate(made[:200])]), model).collect()
    assert sum(r["lang_pred"] == made[r["doc_id"]][2] for r in out) >= 190


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(400):
        k = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(100, 5000, 20), 10 + k))
        data.append((k, (at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32))))
    w, b = langid.fit_ftrl(data, 3, langid.LangSettings(epochs=5, l1=0.3))
    assert all(int(np.argmax(w[10 + k])) == k for k in range(3)) and (w != 0).sum() < 0.5 * 3 * 4900
    z, labels = rng.normal(size=(4000, 3)), np.empty(4000, int)
    for i, row in enumerate(z):
        labels[i] = rng.choice(3, p=langid._softmax(row / 2.5))
    assert abs(langid.fit_temperature(z, labels) - 2.5) < 0.5


def test_licenses(odd, none):
    index = licenses.LicenseIndex()
    text = index.templates["MIT"].replace("hereby granted", "hereby gladly granted").replace("the rights to use, copy", "the right to use, copy")
    text = f"Ünï\n{text}\nLicensed under CC BY-NC 4.0. None of the rights are reserved."
    found = licenses.find_licenses(text, index)
    assert [f[0] for f in found] == ["MIT", "CC-BY-NC-4.0 notice"] and found[0][3] == found[0][4] - 1
    assert text[found[0][1] : found[0][2]].startswith("Permission") and text[found[0][1] : found[0][2]].endswith("SOFTWARE")
    assert licenses.scan_licenses(odd).count() == 12 and licenses.scan_licenses(none).count() == 0


def test_licenses_count_as_often_as_they_stand():
    index = licenses.LicenseIndex()
    cases = [
        ("(c) 2019 A. All rights reserved. (c) 2020 B. All rights reserved.", 2), ("Licensed under the MIT License.\n" * 2, 2),
        ("Licensed under MIT License.\nLicensed under the MIT License.\nLicensed under the MIT License, too.", 3),
        ("All rights reserved.\n" * 1000, 1000), (f"{index.templates['MIT']}\n" * 3, 3), ("(c) A. All rights reserved.\n" * 3 + index.templates["ISC"], 4),
    ]
    for text, n in cases:
        found = licenses.find_licenses(text, index)
        assert len(found) == n and all(a[2] <= b[1] for a, b in zip(found, found[1:])), text[:80]
        assert all(text[f[1] : f[2]].lower().split()[0] in ("all", "licensed", "permission") for f in found)


def test_alignment_counts_the_longest_common_order():
    rng = random.Random(2)

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                t[i + 1][k + 1] = max(t[i][k + 1], t[i + 1][k], t[i][k] + (x == y))
        return t[-1][-1]

    for _ in range(100):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        got, first, last = licenses.align(np.array(a), np.array(b), -14, 14)
        assert got == brute(a, b) and (got == 0 or 0 <= first <= last < len(b))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        place = binary.Feistel(n, "k")
        assert sorted(place(np.arange(n)).tolist()) == list(range(n))
    assert binary.Feistel(1000, "k")(np.arange(9)).tolist() != binary.Feistel(1000, "l")(np.arange(9)).tolist()


def test_shards_hold_the_ids_of_the_tokenizer(spark, tmp_path):
    """Sequences in table order, decoded from the shards, are the tokenizer's ids one after the other."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [prose(k, 40) + ("" if k % 3 else ", e\u0301té (1989)!\n") for k in range(30)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    folder = binary.whole_uri(spark, str(tmp_path / "ids"))
    assert folder == f"file://{tmp_path}/ids" and binary.whole_uri(spark, folder) == folder
    number = {r["slot"]: r["sequence"] for r in binary.materialise(df, folder, window=64, per_shard=7).collect()}
    read = sorted((number[slot], ids.tolist()) for slot, ids in binary.read_slots(folder, 0, 64, 7))
    want = [i for t in texts for i in [*tok.encode(t or "", add_special_tokens=False).ids, 1]]
    assert [i for _, ids in read for i in ids] == want and [n for n, _ in read] == list(range(len(read)))


def test_shards_read_back(odd, none, tmp_path):
    folder = str(tmp_path / "shards")
    rows = {r["slot"]: r for r in binary.materialise(odd, folder, window=64, per_shard=100).collect()}
    import zlib

    read = list(binary.read_slots(folder, 0, 64, 100))
    assert [s for s, _ in read] == sorted(rows)
    for slot, ids in read:
        assert len(ids) == rows[slot]["n_ids"] and zlib.crc32(ids.astype("<u4").tobytes()) == rows[slot]["ids_crc32"]
    again = list(binary.read_slots(folder, 150, 64, 100))
    assert again[0][0] == 150 and (again[0][1] == read[150][1]).all() and len(again) == len(read) - 150
    assert binary.materialise(none, str(tmp_path / "none"), window=64).count() == 0
