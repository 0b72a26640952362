import random
import re
import time

import pytest
from pyspark.sql import functions as F

from screenfunnel.operators import screen
from screenfunnel.operators.literals import required_literals
from screenfunnel.operators.screen import Alert


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("abc", ("abc",)), ("ab+cde", ("cde",)), ("(?i)HeLLo", ("hello",)), ("x?yz", ("yz",)), ("(abc|def)g", ("abc", "def")), ("abc|d", None),
        ("[Ll]icen[cs]e", ("icen",)), (r"https?://", ("http",)), ("[0-9]{9}", None), ("(ab){2,}", ("ab",)), ("(ab)*cd", ("cd",)), ("a.c", None),
        ("äbc", ("bc",)), (r"\Qa.b\E", None), (r"[a[bc]]de", None), (r"(a)\1xyz", None), ("(", None), (r"\bfoo\b", ("foo",)), ("(?=abc)x", None),
    ],
)
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_every_match_holds_a_literal():
    rng = random.Random(2)
    parts = ["a", "bc", "d?", "(ef|gh)", "[xy]", "z+", "(?:k|lm)*", "n{2}", "."]
    for _ in range(300):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        needs = required_literals(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abcdefghxyzklmn") for _ in range(30))
            m = re.search(pattern, text)
            assert needs is None or not m or any(x in m[0] for x in needs)


def catalogue(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5)))
    shapes = [lambda: word(), lambda: f"{word()}[0-9]+", lambda: f"{word()}|{word()}", lambda: f"(?i){word().upper()}", lambda: f"{word()}.?{word()}"]
    out = [Alert(rng.randint(1, 3), f"F{i % 7}", f"e{i}", rng.choice(shapes)()) for i in range(n)]
    return out + [Alert(2, "S", "digits", "[0-9]{4}"), Alert(1, "S", "caps", "[A-Z]{6}")]


def texts(spark, n, length):
    rng = random.Random(3)
    made = [(i, "".join(rng.choice("abcdefgh    AB0") for _ in range(rng.randint(0, length)))) for i in range(n)]
    return spark.createDataFrame([*made, (n, None), (n + 1, ""), (n + 2, "1234"), (n + 3, "ABCDEF 1234")], "id int, t string")


def test_long_catalogue_equals_one_by_one(spark, monkeypatch):
    df, entries = texts(spark, 400, 60), catalogue(60)
    quick = df.select("id", screen.first_alert(F.col("t"), entries).alias("hit")).collect()
    assert len(entries) >= screen.AUTOMATON_FROM
    monkeypatch.setattr(screen, "AUTOMATON_FROM", 10**9)
    slow = df.select("id", screen.first_alert(F.col("t"), entries).alias("hit")).collect()
    assert sorted(map(str, quick)) == sorted(map(str, slow)) and sum(r.hit is not None for r in quick) > 50


def test_catalogue_of_any_size(spark):
    """More than 5000 entries, from a table; the time does not follow the number of patterns."""
    entries = catalogue(5200)
    rows = spark.createDataFrame([(a.tier, i, a.family, a.name, a.pattern) for i, a in enumerate(entries)], "tier int, ord int, family string, name string, pattern string")
    read = screen.read_catalogue(rows)
    assert len(read) == 5202
    df = texts(spark, 2000, 200).cache()
    df.count()
    took = {}
    for n in (583, 5202):
        part = sorted(read, key=lambda a: a.name)[:n]
        accepted, rejected = screen.alert_screen(df, "t", part)
        start = time.perf_counter()
        total = accepted.count() + rejected.count()
        took[n] = time.perf_counter() - start
        assert total == df.count()
    assert took[5202] < 60
    first = {a.name: a for a in entries}
    for r in rejected.limit(50).collect():
        assert r.MatchAlert == "invalid_smiles" or first[r.Substructure].family == r.MatchAlert
