"""HTML pages as sequences of text blocks with their tag paths, and their numbers for a model."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import regex

#: Elements that do not end a block. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Fixed values.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video".split())
#: Elements of other languages, which may end themselves. Fixed values.
FOREIGN = frozenset(("svg", "math"))
#: Starting one of these ends an open paragraph; the second table ends open elements of its own kind. Fixed values.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tbody", "tbody": "thead tr td th"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table"}
TOKEN = regex.compile(r"[A-Za-z]+|\d+")


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]]
    linked: int


@dataclass
class _Open:
    tag: str
    tokens: tuple[str, ...] = field(default_factory=tuple)


class _Reader(HTMLParser):
    """Collects blocks; unclosed and stray tags are mended as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.silent = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = [(e.tag, e.tokens) for e in self.open if e.tag not in INLINE]
            self.blocks.append(Block(text, path, self.linked))
        self.parts, self.linked = [], 0

    def pop(self, at: int) -> None:
        for e in self.open[at:]:
            self.links -= e.tag == "a"
            self.silent -= e.tag in SILENT
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.end_block()
            if tag in ENDS_P:
                self._close({"p"}, set())
            if tag in SIBLINGS:
                self._close(set(SIBLINGS[tag].split()), set(SCOPES[tag].split()))
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        tokens = tuple(t.lower() for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for t in TOKEN.findall(v))
        self.open.append(_Open(tag, tokens))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                self.pop(i)
            elif self.open[i].tag in scope or (not scope and self.open[i].tag not in INLINE):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # only void elements end themselves in HTML, but svg and math do, and all elements in them
        if tag not in FOREIGN and not (self.silent and any(e.tag in FOREIGN for e in self.open)):
            self.handle_starttag(tag, attrs)
        elif tag not in INLINE:
            self.end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.pop(i)
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def read_blocks(html: str) -> list[Block]:
    """Blocks in page order: character references decoded, white space runs as one blank, no empty block."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return reader.blocks


PATH_SIZE, WORD_SIZE, PLAIN_SIZE = 512, 32, 8
SIZE = PATH_SIZE + WORD_SIZE + PLAIN_SIZE


def _places(token: str) -> tuple[int, int]:
    return zlib.crc32(token.encode()) % PATH_SIZE, zlib.crc32(b"2" + token.encode()) % PATH_SIZE


@lru_cache(1 << 14)
def _path_row(path: tuple[tuple[str, tuple[str, ...]], ...]) -> np.ndarray:
    """Places of all elements of a path, of their names, and of the last element."""
    tokens = [t for tag, names in path for t in (f"<{tag}", *[f".{k}" for k in names])]
    if path:
        tokens.append(f"last {path[-1][0]}")
    return np.array(sorted({p for t in tokens for p in _places(t)}), np.int64)


class _Codes(dict):
    """Place of a word, and half the codes further for those that count negative."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = zlib.crc32(word.encode())
        code = self[word] = h % WORD_SIZE + (0 if h & (1 << 20) else WORD_SIZE)
        return code


_CODES = _Codes()


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed elements of the tag path, hashed words, and lengths, links, signs and place."""
    x = np.zeros((len(blocks), SIZE), np.float32)
    words = [b.text.split(" ") for b in blocks]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    at = np.repeat(np.arange(len(blocks)), sizes) * (2 * WORD_SIZE) + codes
    counts = np.bincount(at, minlength=len(blocks) * 2 * WORD_SIZE).reshape(len(blocks), 2, WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = (counts[:, 0] - counts[:, 1]) / (np.maximum(sizes, 4) * 0.75)[:, None]
    for i, b in enumerate(blocks):
        x[i, _path_row(tuple(b.path))] = 0.7
        n = len(b.text)
        x[i, -PLAIN_SIZE:] = (
            math.log1p(n) / 8, math.log1p(len(words[i])) / 6, min(1.0, b.linked / n), sum(map(b.text.count, ".,;:!?")) / n * 10,
            i / len(blocks), len(b.path) / 10, 1.0 if "©" in b.text or "|" in b.text else 0.0, 1.0 if b.text[-1] in ".!?" else 0.0,
        )
    return x
