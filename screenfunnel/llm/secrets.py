"""Secret scans through nested encodings.

A worklist starts with the text. Each layer on it is scanned, then unwrapped in every way that applies: percent signs,
Unicode escapes and character references (in place, so a key before an encoded value still counts), and Base64 runs, wrapped
or not, whose bytes may be compressed and are then unpacked, in windows if there is much. What comes out is a new layer unless the same layer was seen at the same place,
so the list ends at a fixpoint. A layer knows which characters of the text each of its own came from, and findings are
reported there.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import re
import string
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex"]
#: Patterns and least lengths. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|quot|apos|lt|gt);")
#: Bytes that are no UTF-8, as ``surrogateescape`` names them, or the text between them.
UNDECODED = re.compile("[\udc80-\udcff]+|[^\udc80-\udcff]+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
#: Runs that are tried as Base64: short ones cannot hold a secret. A wrapped one goes on over line ends and indents.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK, LINE = re.compile(r"[ \t]*\r?\n[ \t]*"), re.compile(r"[A-Za-z0-9+/_-]+={0,2}|={1,2}")
LEAST_LINE, LONG_LINE = 16, 60
#: Unpacked bytes are scanned in windows of this size that share so many bytes; compressed layers in each other are opened
#: to this depth, since one may hold itself. A window grows up to ``MOST_HELD`` bytes rather than end in an encoded run.
WINDOW, SHARED, MOST_LEVELS, MOST_HELD = 1 << 22, 1 << 16, 100, 1 << 24
#: Bytes that an encoded run may hold, line ends and the zeros of UTF-16 included.
IN_RUN = (string.ascii_letters + string.digits + "+/_=-%\\{}&#; \t\r\n\0").encode()
#: How a run was read: as plain text, as text with characters that do not print, or with bytes that are no text.
PLAIN, ODD, BROKEN = range(3)

#: Start and end, in the text, of each character of a layer; None for the text itself.
Origin = tuple[Sequence[int], Sequence[int]] | None
Finding = tuple[str, int, int, str, str]


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end (code points, exclusive) of base findings, leftmost and not overlapping within a kind."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


#: A part of a run: what it stands for, or None if it cannot be decoded and stays as it is, and its size.
Part = tuple[str | None, int]


def _percent(run: str) -> Iterator[Part]:
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    for m in UNDECODED.finditer(text):
        piece = m.group()
        yield (None, 3 * len(piece)) if "\udc80" <= piece[0] <= "\udcff" else (piece, 3 * len(piece.encode()))


def _escape(run: str) -> Iterator[Part]:
    if run[0] == "&":
        yield unescape(run), len(run)
        return
    codes = [(int(m.group(1) or m.group(2), 16), m.end() - m.start()) for m in ONE_ESCAPE.finditer(run)]
    plain, size, i = [], 0, 0
    while i < len(codes):
        code, width = codes[i]
        i += 1
        if 0xD800 <= code < 0xDC00 and i < len(codes) and 0xDC00 <= codes[i][0] < 0xE000:
            # a pair of surrogates is one character
            code, width = 0x10000 + ((code - 0xD800) << 10) + codes[i][0] - 0xDC00, width + codes[i][1]
            i += 1
        if code < 0xD800 or 0xE000 <= code < 0x110000:
            plain.append(chr(code))
            size += width
            continue
        if plain:
            yield "".join(plain), size
        yield None, width
        plain, size = [], 0
    if plain:
        yield "".join(plain), size


def _in_place(text: str, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]] | None:
    """The text with all decodable parts of runs replaced, and the start and end that each of its characters had."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        here = m.start()
        for plain, size in decode(m.group()):
            if plain:
                parts += [text[at:here], plain]
                starts += [*range(at, here)]
                ends += [*range(at + 1, here + 1)]
                n = len(plain)
                # characters of a part share it evenly, which is exact for parts of equally long codes
                starts += [here + size * i // n for i in range(n)]
                ends += [here + size * (i + 1) // n for i in range(n)]
                at = here + size
            here += size
    if not parts:
        return None
    return "".join(parts) + text[at:], [*starts, *range(at, len(text))], [*ends, *range(at + 1, len(text) + 1)]


class _Same:
    """A sequence of one number, without its memory."""

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, at: int) -> int:
        return self.value


def _packed(data: bytes) -> bool:
    """Whether ``data`` starts like gzip or zlib."""
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0)


def _inflate(chunks: Iterator[bytes], bits: int = 47) -> Iterator[bytes]:
    """What comes out of one compressed member after the other, up to the end or to where the stream is cut or damaged."""
    tool, rest = zlib.decompressobj(bits), b""
    for chunk in chunks:
        rest += chunk
        while rest and not (tool.eof and len(rest) < 3):
            if tool.eof:
                if not _packed(rest):
                    return
                tool = zlib.decompressobj(bits)
            before = tool.copy()
            try:
                out = tool.decompress(rest, SHARED)
            except zlib.error:
                # byte by byte, what stands before the damage
                try:
                    for k in range(len(rest)):
                        yield before.decompress(rest[k : k + 1])
                except zlib.error:
                    pass
                return
            rest = tool.unused_data if tool.eof else tool.unconsumed_tail
            if out:
                yield out
    if not tool.eof and (out := tool.flush()):
        yield out


def _opened(data: bytes) -> tuple[Iterator[bytes], bool]:
    """The bytes behind all gzip and zlib layers around ``data``, and whether there were any."""
    head, chunks, found = data, iter(()), False
    for _ in range(MOST_LEVELS):
        if not _packed(head):
            break
        out = _inflate(itertools.chain([head], chunks))
        first = next((x for x in out if x), b"")
        if not first or first == head[: len(first)]:
            break
        head, chunks, found = first, out, True
    return itertools.chain([head], chunks), found


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Windows of ``WINDOW`` bytes; one that would end in an encoded run goes on to the run's end, up to ``MOST_HELD`` bytes."""
    held, end, new = bytearray(), WINDOW, False
    for chunk in chunks:
        held += chunk
        new = True
        while len(held) >= end:
            if end < MOST_HELD and not bytes(held[end - SHARED : end]).rstrip(IN_RUN):
                end += SHARED
                continue
            yield bytes(held[:end])
            del held[: end - SHARED]
            new, end = len(held) > SHARED, WINDOW
    if new:
        yield bytes(held)


def _codec(data: bytes) -> str:
    """UTF-16 by its mark or by the zeros of its Latin letters, else UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if data[:1] == b"\xff" else "utf-16-be"
    half = len(data) // 2
    if half and 5 * data[1::2].count(0) >= 2 * half and not data[::2].count(0):
        return "utf-16-le"
    return "utf-16-be" if half and 5 * data[::2].count(0) >= 2 * half and not data[1::2].count(0) else "utf-8"


def _text(data: bytes, codec: str) -> tuple[str, int]:
    try:
        text, state = data.decode(codec), PLAIN
    except UnicodeDecodeError:
        return data.decode(codec, "replace"), BROKEN
    body = text[1:] if text[:1] == "\ufeff" else text
    return text, state if body.isprintable() or all(c.isprintable() or c in "\t\r\n" for c in body) else ODD


def _bytes(run: str) -> bytes | None:
    """A run that does not end with a whole group loses its last characters."""
    joined = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    joined = joined[: len(joined) - (len(joined) % 4 == 1)]
    try:
        return base64.b64decode(joined + "=" * (-len(joined) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _ends(data: bytes | None) -> bool:
    """Whether the compressed stream in ``data`` comes to its end there."""
    bits = 47 if data and _packed(data) else -15
    while data:
        tool = zlib.decompressobj(bits)
        while data and not tool.eof:
            try:
                tool.decompress(data, WINDOW)
            except zlib.error:
                return False
            data = tool.unconsumed_tail
        if not tool.eof:
            return False
        data = tool.unused_data if _packed(tool.unused_data) else b""
    return True


def _base64(run: str) -> tuple[Iterator[str], str, int] | None:
    """The decoded text in windows, the name of the way, and how it reads."""
    if (data := _bytes(run)) is None:
        return None

    def read(chunks: Iterator[bytes]) -> tuple[Iterator[str], int]:
        windows = _windows(chunks)
        first = next(windows, b"")
        codec = _codec(first)
        text, state = _text(first, codec)
        return itertools.chain([text] if text else [], (_text(w, codec)[0] for w in windows)), state

    chunks, found = _opened(data)
    texts, state = read(chunks)
    if not found and state == BROKEN:
        # raw deflate has no mark: it counts if what comes out is text
        raw, raw_state = read(_inflate(iter([data]), -15))
        first = next(raw, "")
        if raw_state == PLAIN and len(first) >= LEAST_ASSIGN:
            return itertools.chain([first], raw), "base64+zip", PLAIN
    return texts, "base64+zip" if found else "base64", state


def _runs(text: str) -> Iterator[tuple[int, int, Iterator[str], str]]:
    """Start, end, decoded windows and way of the Base64 runs.

    A run goes on in the next line if both are equally long or both long; a shorter line after a full one may be its end, and
    words before it in its first line may be none of it. Of these readings the one that gives the cleanest text counts, the
    longest of equals; lines outside it, and all lines if none is clean, are read one by one too.
    """
    at = 0
    while m := BASE64.search(text, at):
        lines, last = [m.span()], None
        inline = m.start() > 0 and text[: m.start()].rstrip(" \t")[-1:] not in ("", "\n") if "\n" in text[m.end() : m.end() + 80] else False
        while text[lines[-1][1] - 1] != "=" and (gap := BREAK.match(text, lines[-1][1])) and (t := LINE.match(text, gap.end())):
            width, n = lines[-1][1] - lines[-1][0], t.end() - t.start()
            if n >= LEAST_LINE and (n == width or min(n, width) >= LONG_LINE or (inline and len(lines) == 1 and n > width)):
                lines.append(t.span())
                continue
            if n < width:
                last = t.span()
            break
        at = lines[-1][1]
        choices = [lines + [last]] * (last is not None) + [lines] * (len(lines) > 1 or last is not None)
        if inline and len(lines) > 1:
            choices += [lines[1:] + [last]] * (last is not None) + [lines[1:]]
        best = None
        for choice in choices:
            run = "".join(text[a:b] for a, b in choice)
            got = _base64(run)
            if got is not None and got[1] == "base64+zip" and choice[-1] == last and _ends(_bytes(run[: len(run) - (last[1] - last[0])])):
                # the stream does without that line
                continue
            if got is not None and (best is None or got[2] < best[1][2]):
                best = (choice, got)
            if got is not None and got[2] == PLAIN:
                break
        alone = lines
        if best is not None:
            choice, (texts, way, state) = best
            if state == PLAIN:
                alone = [x for x in lines if x not in choice]
                at = max(at, choice[-1][1])
            if len(choice) > 1:
                yield choice[0][0], choice[-1][1], texts, way
            elif state == PLAIN:
                alone = lines
        for a, b in alone:
            if (got := _base64(text[a:b])) is not None:
                yield a, b, got[0], got[1]


def find_secrets(text: str) -> list[Finding]:
    """(kind, start, end, way, value) in order of start and kind; way is '' for the text itself, else the decoders taken."""
    found: dict[tuple[str, int, int], tuple[str, str]] = {}
    work: deque[tuple[Iterator[str], Origin, str]] = deque([(iter([text]), None, "")])
    # the same layer at another place is another layer: its findings have spans of their own
    seen: set[tuple[int, int, int, int]] = set()

    while work:
        windows, origin, way = work.popleft()
        if (layer := next(windows, None)) is None:
            continue
        if origin is not None:
            # the next window waits for its turn, so that one at a time is in memory
            work.append((windows, origin, way))
        start, end = (0, len(text)) if origin is None else (origin[0][0], origin[1][-1])
        # hashes stand for layers, which may be large
        if (key := (hash(layer), len(layer), start, end)) in seen:
            continue
        seen.add(key)

        def back(start: int, end: int) -> tuple[int, int]:
            return (start, end) if origin is None else (origin[0][start], origin[1][end - 1])

        for kind, start, end in scan(layer):
            value, place = layer[start:end], (kind, *back(start, end))
            old = found.setdefault(place, (way, value))
            if old[0] == way and value.startswith(old[1]):
                # the end of a window may have cut it
                found[place] = (way, value)
        for sign, pattern, decode, name in (("%", PERCENT, _percent, "url"), ("\\", ESCAPE, _escape, "unicode"), ("&", ESCAPE, _escape, "unicode")):
            if sign in layer and (new := _in_place(layer, pattern, decode)):
                plain, starts, ends = new
                if origin is not None:
                    starts, ends = [origin[0][i] for i in starts], [origin[1][i - 1] for i in ends]
                work.append((iter([plain]), (starts, ends), f"{way}>{name}".lstrip(">")))
        for a, b, texts, name in _runs(layer):
            start, end = back(a, b)
            work.append((texts, (_Same(start), _Same(end)), f"{way}>{name}".lstrip(">")))
    rank = {k: i for i, k in enumerate(KINDS)}
    keys = sorted(found, key=lambda k: (k[1], rank[k[0]], k[2]))
    return [(*k, *found[k]) for k in keys]


FINDING = "array<struct<kind:string,start:long,end:long,way:string,value:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("way", pa.string()), ("value", pa.string())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [dict(zip(("kind", "start", "end", "way", "value"), f)) for f in find_secrets(text.as_py() or "")] for text in batch.column(1)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _TYPE)], ["doc_id", "findings"])


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``findings``: kind, start, end (code points, exclusive), way and value, by start and kind.

    ``way`` is empty for what the text shows itself and names the decoders otherwise; such spans cover the encoded
    characters. One row per row, whatever repeats; a null or empty text has no findings; null ids stay null; an empty table
    gives no rows; other columns play no part.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_scanned, f"doc_id long, findings {FINDING}")


def summary(found: DataFrame) -> DataFrame:
    """Counts and a digest of the plain findings, and all spans, of the rows of ``scan_secrets``."""
    base = F.filter("findings", lambda f: f["way"] == "")

    def spans(of):
        return F.array_join(F.transform(of, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
