"""Which patterns of a large catalogue can match a text at all: one pass over the text finds the literals they need."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter literals are in nearly every text.
SHORTEST = 2
# Where Java's patterns read otherwise than Python's: nested classes, intersections, numbered escapes and quoting.
DIFFERENT = re.compile(r"\[[^\]]*\[|&&|\\[0-9QEpPhHRXGkN]")

_parse = re._parser


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals (ASCII, in lower case) of which every match holds at least one, or None if none can be told."""
    if DIFFERENT.search(pattern):
        return None
    try:
        best = _required(_parse.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return tuple(sorted(set(best))) if best else None


def _required(tokens) -> list[str] | None:
    """The choice of literals whose shortest is longest, among all that a sequence of pattern elements needs."""
    choices: list[list[str]] = []
    run = ""
    for op, value in tokens:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        choices.append([run])
        run, inner = "", None
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            inner = _required(value[2])
        elif name == "SUBPATTERN":
            inner = _required(value[3])
        elif name == "ATOMIC_GROUP":
            inner = _required(value)
        elif name == "BRANCH":
            each = [_required(branch) for branch in value[1]]
            inner = [x for one in each for x in one] if all(each) else None
        if inner:
            choices.append(inner)
    choices.append([run])
    best = max(choices, key=lambda c: min(map(len, c)))
    return best if min(map(len, best)) >= SHORTEST else None


@cache
def _automaton(needs: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, literals in enumerate(needs, 1):
        for x in literals:
            found.add_word(x, (*found.get(x, ()), i))
    found.make_automaton()
    return found


def candidates(needs: Sequence[tuple[str, ...]]) -> Callable[[Column], Column]:
    """From a text to the sorted 1-based numbers of the entries one of whose literals stands in it; Arrow batches, one pass."""
    needs = tuple(needs)

    def numbers(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(needs), []
        for text in texts.to_pylist():
            # only A-Z change, in the text as in the literals
            hits = automaton.iter(text.encode().lower().decode()) if text else ()
            out.append(sorted({i for _, entries in hits for i in entries}))
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(numbers, "array<int>")
