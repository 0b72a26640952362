"""License scans: winnowed fingerprints find candidates, a banded alignment measures them.

Templates are cut into words; of the hashes of their word runs, winnowing keeps the smallest in each window, and an inverted
index leads from a fingerprint to its templates and places. A document looks up all its runs, so that a template's
fingerprints are met wherever they stand. Hits of one template on neighbouring diagonals are one candidate; an alignment in
a band around its diagonals counts the template's words that the document has in order, and gives the span. What lies left
and right of a finding is aligned again, so that a notice counts as often as it stands. Of overlapping findings the one with
most matched words stays.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.license_texts import TEMPLATES

WORD = re.compile(r"[a-z0-9]+")


def _hash(words: tuple[str, ...]) -> int:
    return zlib.crc32(" ".join(words).encode())


def winnow(words: list[str], run: int, window: int) -> list[tuple[int, int]]:
    """(hash, place) of the word runs that are smallest in a window, the rightmost of equals; a short text keeps one."""
    hashes = [_hash(tuple(words[i : i + run])) for i in range(len(words) - run + 1)]
    kept = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        low = min(part)
        kept.add(i + max(k for k, h in enumerate(part) if h == low))
    return [(hashes[i], i) for i in sorted(kept)]


@dataclass
class LicenseIndex:
    """Templates as words, with the inverted index of their fingerprints."""

    templates: dict[str, str] = field(default_factory=lambda: TEMPLATES)
    run: int = 3
    window: int = 4
    band: int = 12
    least_coverage: float = 0.8

    def __post_init__(self) -> None:
        self.words = {name: WORD.findall(text.lower()) for name, text in self.templates.items()}
        self.postings: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            for _, place in winnow(words, self.run, self.window):
                self.postings[tuple(words[place : place + self.run])].append((name, place))
        #: Only these words can be part of a hit.
        self.marks = {w for gram in self.postings for w in gram}

    def hits(self, words: list[str]) -> dict[str, set[int]]:
        """Per template the diagonals (document place minus template place) of its hits."""
        known = np.fromiter(map(self.marks.__contains__, words), bool, len(words))
        full = known[: len(words) - self.run + 1].copy()
        for k in range(1, self.run):
            full &= known[k : len(words) - self.run + 1 + k]
        hits: dict[str, set[int]] = defaultdict(set)
        for i in np.flatnonzero(full).tolist():
            for name, place in self.postings.get(tuple(words[i : i + self.run]), ()):
                hits[name].add(i - place)
        return hits

    def bands(self, name: str, diagonals: set[int]) -> list[tuple[int, int]]:
        """Lowest and highest of neighbouring diagonals. A long chain of them is cut in pieces that overlap by several
        templates, so that the work grows with the document and not with its square."""
        out: list[tuple[int, int]] = []
        for d in sorted(diagonals):
            if out and d - out[-1][1] <= self.band:
                out[-1] = (out[-1][0], d)
            else:
                out.append((d, d))
        size = len(self.words[name]) + self.band
        return [(k, min(k + 64 * size, high)) for low, high in out for k in range(low, max(high - 4 * size, low) + 1, 60 * size)]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words that the document has in order, with word i facing places i+low to i+high, and the places of the
    first and last of them."""
    n, width = len(template), high - low + 1
    score = np.zeros((n + 1, width), np.int32)
    at = np.arange(width)
    equal = np.zeros((n, width), bool)
    for i in range(n):
        place = i + low + at
        inside = (place >= 0) & (place < len(words))
        equal[i, inside] = words[place[inside]] == template[i]
        # a place is one column to the left for the next word; skipping words costs nothing
        down = np.append(score[i, 1:], score[i, -1])
        score[i + 1] = np.maximum.accumulate(np.maximum(np.where(equal[i], score[i] + 1, 0), down))
    best = int(score[n].max())
    i, k = n, int(np.argmax(score[n] == best))
    first = last = -1
    while i and score[i, k]:
        if equal[i - 1, k] and score[i, k] == score[i - 1, k] + 1:
            first = i - 1 + low + k
            last = first if last < 0 else last
            i -= 1
        elif k and score[i, k] == score[i, k - 1]:
            k -= 1
        else:
            i, k = i - 1, min(k + 1, width - 1)
    return best, first, last


Found = tuple[str, int, int, int, int]


def find_licenses(text: str, index: LicenseIndex) -> list[Found]:
    """(template, start, end, matched words, template words) by start; start and end in code points, end exclusive."""
    low = text.lower()
    if len(low) != len(text):
        # a few letters change their length; such texts keep them
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = WORD.findall(low)
    if len(words) < index.run or not (hits := index.hits(words)):
        return []
    spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
    code: dict[str, int] = {}
    doc = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    found = []
    for name, diagonals in hits.items():
        template = np.array([code.get(w, -1) for w in index.words[name]], np.int64)
        work = [(low - index.band, high + index.band, 0, len(doc)) for low, high in index.bands(name, diagonals)]
        while work:
            low, high, a, b = work.pop()
            # diagonals that meet this piece of the document, in which its first place counts as place 0
            low, high = max(low, a - len(template) + 1), min(high, b - 1)
            if low > high:
                continue
            matched, first, last = align(template, doc[a:b], low - a, high - a)
            if matched < max(index.least_coverage * len(template), 1):
                continue
            first, last = first + a, last + a
            found.append((name, spans[first][0], spans[last][1], matched, len(template)))
            work += [(low, high, a, first), (low, high, last + 1, b)]
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (-f[3], -f[3] / f[4], f[1], f[2], f[0])):
        # kept ones lie apart, so only the neighbours can overlap
        at = bisect(kept, f[1], key=lambda k: k[1])
        if (not at or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
            kept.insert(at, f)
    return kept


FINDING = "array<struct<license:string,start:long,end:long,matched:long,words:long>>"
_TYPE = pa.list_(pa.struct([("license", pa.string())] + [(n, pa.int64()) for n in ("start", "end", "matched", "words")]))


def _scanned(index: LicenseIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("license", "start", "end", "matched", "words")
        for batch in batches:
            found = [[dict(zip(names, f)) for f in find_licenses(t.as_py() or "", index)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _TYPE)], ["doc_id", "findings"])

    return run


def scan_licenses(df: DataFrame, index: LicenseIndex | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``findings``: license, start, end (code points, exclusive), matched and words of its template, by start.

    One row per row, whatever repeats; a null or empty text has no findings; null ids stay null; an empty table gives no
    rows; other columns play no part. Ties between templates go to the higher coverage, then the first place, then the name.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_scanned(index or LicenseIndex()), f"doc_id long, findings {FINDING}")


def summary(found: DataFrame) -> DataFrame:
    """Number of findings and all of them as license:start:end:matched/words, joined by semicolons."""
    one = F.transform(
        "findings",
        lambda f: F.format_string("%s:%d:%d:%d/%d", f["license"], f["start"], f["end"], f["matched"], f["words"]),
    )
    return found.select("doc_id", F.size("findings").cast("long").alias("n_licenses"), F.array_join(one, ";").alias("licenses"))
