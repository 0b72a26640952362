"""Packing documents into windows with their lexical neighbours.

A task takes the documents of its partition in shards of bounded size. Each shard has an inverted index of its words with
BM25 weights. A window starts with a seed document; the index returns the unused documents nearest to the seed, which fill
the window one after the other. The one that passes the end is cut there, and its rest seeds the next window, so windows are
full. What is left at the end of a shard is cut into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled; memory is one shard per task, whatever its sources, copies or longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.wordbpe import WordBpe

WINDOW, END_ID = 2048, 1
#: A shard ends at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 2000, 8_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """Inverted index over documents given as arrays of word numbers."""

    K1, B, QUERY_WORDS = 1.2, 0.75, 12

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        counted = [np.unique(d, return_counts=True) for d in docs]
        words = np.concatenate([w for w, _ in counted]) if n else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), [len(w) for w, _ in counted])
        tf = np.concatenate([c for _, c in counted]).astype(np.float32) if n else np.empty(0, np.float32)
        vocabulary, term, df = np.unique(words, return_inverse=True, return_counts=True)
        size = np.array([len(d) for d in docs], np.float32)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = self.K1 * (1 - self.B + self.B * size / max(size.mean() if n else 1, 1))
        weight = idf[term] * tf * (self.K1 + 1) / (tf + norm[owner])
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = owner[order], weight[order]
        self.ends = np.concatenate([[0], np.cumsum(df)])
        # the words of a document that tell most, out of those that another one has too
        asked = np.where(df[term] > 1, weight, 0)
        self.first = np.concatenate([[0], np.cumsum([len(w) for w, _ in counted])])
        self.term, self.asked = term, asked
        self.unused = np.ones(n, bool)

    def neighbours(self, doc: int) -> np.ndarray:
        """Unused documents that share words with ``doc``, best first; ties by place."""
        a, b = self.first[doc], self.first[doc + 1]
        asked = self.asked[a:b]
        k = min(self.QUERY_WORDS, len(asked))
        if not k:
            return np.empty(0, np.int64)
        best = np.argpartition(-asked, k - 1)[:k]
        terms = self.term[a:b][best[asked[best] > 0]]
        spans = [np.arange(self.ends[t], self.ends[t + 1]) for t in terms]
        if not spans:
            return np.empty(0, np.int64)
        at = np.concatenate(spans)
        score = np.bincount(self.docs[at], self.weights[at], len(self.unused))
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(lengths: list[int], index: Bm25Shard, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) in which every id of every document lies once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = filled = 0

    def place(doc: int) -> None:
        nonlocal sequence, filled
        start, left = 0, lengths[doc]
        while left:
            n = min(left, window - filled)
            pieces.append((doc, start, n, sequence, filled))
            start, left, filled = start + n, left - n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0

    for doc in range(len(lengths)):
        if not index.unused[doc]:
            continue
        index.unused[doc] = False
        place(doc)
        seed: int | None = doc
        while filled and seed is not None:
            now, carried = sequence, None
            for other in index.neighbours(seed):
                index.unused[other] = False
                place(int(other))
                if sequence != now:
                    carried = int(other)
                    break
            seed = carried
    return _in_powers(pieces, sequence, filled)


def _in_powers(pieces: list[tuple[int, int, int, int, int]], last: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """The last, unfilled sequence as sequences whose lengths are powers of two, longest first."""
    if not filled or filled & (filled - 1) == 0:
        return pieces
    bounds = [0]
    while bounds[-1] < filled:
        bounds.append(bounds[-1] + (1 << ((filled - bounds[-1]).bit_length() - 1)))
    done = [p for p in pieces if p[3] != last]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == last):
        for k in range(len(bounds) - 1):
            a, b = max(offset, bounds[k]), min(offset + length, bounds[k + 1])
            if a < b:
                done.append((doc, start + a - offset, b - a, last + k, a - bounds[k]))
    return done


#: One table per worker process, kept from task to task.
_TOKENIZERS: dict[str, WordBpe] = {}


def _packed(path: str, window: int, shard_docs: int, shard_ids: int, with_ids: bool):
    def emit(docs: list, texts: list, sequence: int) -> tuple[list, int]:
        index = Bm25Shard([w for w, _ in texts])
        rows = []
        top = -1
        for doc, start, length, seq, offset in pack_shard([len(x) for _, x in texts], index, window):
            ids = texts[doc][1][start : start + length].astype("<u4")
            top = max(top, seq)
            rows.append((docs[doc], start, length, zlib.crc32(ids), len(texts[doc][1]), sequence + seq, offset, ids))
        return rows, sequence + top + 1

    def batch(rows: list) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECE.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            names = [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordBpe(path)
        bpe = _TOKENIZERS[path]
        sequence = TaskContext.get().partitionId() << 40
        docs, texts, size = [], [], 0
        for got in batches:
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1)):
                if not docs:
                    bpe.tidy()
                words = bpe.chunks(text.as_py() or "")
                ids = np.append(bpe.ids(words), np.uint16(END_ID))
                docs.append(doc_id)
                texts.append((np.array(words), ids))
                size += len(ids)
                if len(docs) == shard_docs or size >= shard_ids:
                    rows, sequence = emit(docs, texts, sequence)
                    yield batch(rows)
                    docs, texts, size = [], [], 0
        if docs:
            rows, sequence = emit(docs, texts, sequence)
            yield batch(rows)

    return run


def pack(df: DataFrame, tokenizer: str | None = None, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
         shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on request.

    * A document is its ids and one id 1; a null or empty text is that id alone. Each id lies in exactly one piece.
    * Rows are packed one by one: repeated rows and null ids are documents like any other. An empty table gives no rows.
    * Sequence ids are unique, and the same whenever the table is read in the same partitions.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return narrow.mapInArrow(_packed(tokenizer, window, shard_docs, shard_ids, with_ids), schema)
