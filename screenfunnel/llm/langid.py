"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three characters (letters in lower case, everything else one blank) are hashed to a fixed number of buckets.
Document frequencies cover every training document. The weights are fitted on the driver by follow-the-regularised-leader
with elastic-net penalties, on a sample whose size is a parameter; a part of the sample is kept back to fit the temperature
of the softmax. Prediction is row by row in the tasks and reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LangSettings:
    """``sample``: labelled rows to fit on, all languages together (at most twice as many and one for each language, whatever
    repeats); the others are as in the method's papers."""

    sample: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    kept_back: float = 0.2


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the grams of a whole text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    # one blank for each run, and one at both ends
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    h = c + np.uint64(1)
    for n in range(3):
        if n:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(1)
        mixed = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
        out += np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
    return out


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF values, of length one."""
    at = np.flatnonzero(counts)
    return _weighed(at, counts[at], idf)


def _weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(n)) * idf[at]
    return at, (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (c := gram_counts(text.as_py())) is not None:
                seen += c > 0
                docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(seen[at], docs)})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, order, at, n = [], [], [], []
        for name, o, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (c := gram_counts(text.as_py())) is not None:
                found = np.flatnonzero(c)
                lang.append(name)
                order.append(o)
                at.append(found.astype("<u2").tobytes())
                n.append(c[found].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(order, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "o", "at", "n"]
        )


def _scores(w: np.ndarray, b: np.ndarray, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return x[1] @ w[x[0]] + b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(data: list[tuple[int, tuple[np.ndarray, np.ndarray]]], classes: int, s: LangSettings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and biases; the order of ``data`` is the order of learning.

    z sums the adjusted gradients, n the squared ones; a weight is zero while |z| is within the L1 penalty.
    """
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z_: np.ndarray, n_: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z_) * np.maximum(np.abs(z_) - l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n_)) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for label, (at, x) in data:
            zi, ni = z[at], n[at]
            w, b = weights(zi, ni, s.l1), weights(zb, nb, 0)
            p = _softmax(x @ w + b)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[at] = ni + g * g
            zb, nb = zb + p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / s.alpha * b, nb + p * p
    return weights(z, n, s.l1).astype(np.float32), weights(zb, nb, 0).astype(np.float32)


def fit_temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm between 1/20 and 20."""

    def loss(t: float) -> float:
        p = _softmax(z / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 1 on division by 3; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit_language_model(df: DataFrame, settings: LangSettings | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LangModel:
    """A model from the rows with a language that are not held out.

    The languages are the values of the column. Each gives an equal share of the sample, or all its rows if it has fewer; rows
    are chosen by a hash of id and text; of repeated rows, at most twice a language's share is taken. Without such rows the model has no language.
    """
    s = settings or LangSettings()
    known = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    found = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in found}
    docs = seen.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + docs) + 1, np.float32)
    for bucket, n in seen.items():
        idf[bucket] = np.log((1 + docs) / (1 + n)) + 1
    empty = LangModel(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    if len(langs) < 2:
        return empty
    share = s.sample / len(langs)
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, share / counts[k]) * (1 << 30)))])
    # Id and text choose, so that rows which share an id do not come all together; repeated rows do, hence the limit.
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))
    rows = known.withColumn("o", order).where(F.pmod("o", F.lit(1 << 30)) < limits[F.col("lang")])
    packed = rows.select("lang", "o", "text").mapInArrow(_sampled, "lang string, o long, at binary, n binary")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("o", "at", "n"))
    rows = packed.withColumn("nth", nth).where(F.col("nth") <= 2 * int(share) + 1).drop("nth").collect()
    rows.sort(key=lambda r: (r["o"], r["lang"], r["at"], r["n"]))
    data = []
    for r in rows:
        at = np.frombuffer(r["at"], "<u2").astype(np.int32)
        data.append((langs.index(r["lang"]), _weighed(at, np.frombuffer(r["n"], "<u4"), idf)))
    back = int(len(data) * s.kept_back)
    weights, bias = fit_ftrl(data[back:], len(langs), s)
    model = LangModel(langs, idf, weights, bias)
    if back:
        z = np.array([_scores(weights, bias, x) for _, x in data[:back]])
        model.temperature = fit_temperature(z, np.array([k for k, _ in data[:back]]))
    return model


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LangModel = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                c = gram_counts(text.as_py())
                if c is None or not model.langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(_scores(model.weights, model.bias, _features(c, model.idf)) / model.temperature)
                best = int(p.argmax())
                names.append(model.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify_languages(df: DataFrame, model: LangModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score (calibrated chance of the prediction).

    One row per row, from the text alone. A null text, or one without a letter, is 'und' with score 0; so is every text if
    the model knows no language. Ties go to the first language; null ids stay null; other columns play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return narrow.mapInArrow(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")
