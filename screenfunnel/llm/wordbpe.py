"""Ids of a word-level BPE tokenizer file, with the merges run once per distinct run of letters.

White space never joins two tokens here, so a text's ids are the ids of its chunks between blanks and line breaks. Chunks
are looked up in a table; an unknown one of Latin letters, digits and signs is cut as the file's own pattern cuts it, and
only a new run goes through the merges. Any other chunk is given to the tokenizer as it is.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

#: Printable characters below U+0250 whose composition and lower case do not depend on their neighbours.
PLAIN = re.compile(r"[!-~¡-įı-ɏ]*")


def _plain(kind: str) -> str:
    """The lower-case plain characters of a general category."""
    return "".join(sorted({c for i in range(0x21, 0x250) for c in chr(i).lower() if unicodedata.category(c)[0] == kind}))


#: The file's splitting pattern, for plain characters. Fixed value.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_plain('L')}]+|[{_plain('N')}]|[^\s{_plain('L')}{_plain('N')}]+")
#: Signs that are one piece, however many, after letters.
ENDINGS = ".,;:!?*#$%&"


def _byte_letters() -> dict[int, str]:
    """The usual stand-ins of bytes in byte-level vocabularies: printable ones are themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBpe:
    """``chunks(text)`` as places in the table, and ``ids(places)`` as uint16 array.

    Both tables are emptied at ``most`` entries, between texts; places handed out before are then void. Ids are kept as bytes,
    two for each, which the garbage collector need not walk through.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.letters = _byte_letters()
        self.most = most
        self.runs: dict[str, bytes] = _Runs(self)
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = _Places(self)
        self.made: list[bytes] = []

    def tidy(self) -> None:
        if len(self.places) > self.most:
            self.reset()
        if len(self.runs) > self.most:
            self.runs.clear()

    def merge(self, run: str) -> bytes:
        mapped = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return array("H", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def encode(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self.runs[chunk.lower()]
            body = chunk.rstrip(ENDINGS)
            if body.isalpha():
                return self.runs[body.lower()] + self.runs[chunk[len(body) :]]
        if "<|" in chunk or not PLAIN.fullmatch(chunk):
            return array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.runs.__getitem__, PIECES.findall(chunk.lower())))

    def chunks(self, text: str) -> list[int]:
        return list(map(self.places.__getitem__, text.replace("\n", " ").split(" ")))

    def ids(self, places: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.made.__getitem__, places)), np.uint16)


class _Runs(dict):
    def __init__(self, owner: WordBpe):
        super().__init__()
        self.merge = owner.merge

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.merge(run)
        return ids


class _Places(dict):
    def __init__(self, owner: WordBpe):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> int:
        made = self.owner.made
        made.append(self.owner.encode(chunk))
        place = self[chunk] = len(made) - 1
        return place
