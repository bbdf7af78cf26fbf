"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled documents (``max_train`` rows); the
smoothed log-probability matrix (buckets x languages) is broadcast, and batches of whole
texts are scored with sparse look-ups in numpy. The matrix has at most 2**entry_bits entries:
with very many languages, buckets are folded together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, pack_arrays, texts, unpack_arrays

#: What the trained model knows; pred is UNDETERMINED where a text has no letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5
    max_train: int = 8_000
    entry_bits: int = 24


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # (buckets, languages), float32
    log_prior: np.ndarray
    params: LanguageParams


_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters, for all of Unicode."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def code_points(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, runs of anything else as one 0, and the start of each text.

    Every text begins and ends with a 0, so n-grams never join two texts: those that
    contain a 0 in their middle are not used.
    """
    parts = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts_]
    sizes = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    x = np.where(letter_table()[x], x, np.uint32(0))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], at[starts]


def grams(x: np.ndarray, orders: tuple[int, ...], bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(order, bucket at each position, whether the position counts) for each order."""
    out = []
    y = x * np.uint32(0x01000193) + np.uint32(7)
    y ^= y >> np.uint32(15)
    for n in orders:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h *= _MIX[j % len(_MIX)]
            h += y[j : j + m]
            h ^= h >> np.uint32(13)
        ok = np.ones(m, bool)
        if n == 1:
            ok = x != 0
        elif n == 2:
            ok = (x[:-1] != 0) | (x[1:] != 0)
        else:
            for j in range(1, n - 1):
                ok &= x[j : j + m] != 0
        h *= np.uint32(0x9E3779B1)
        out.append((n, (h >> np.uint32(32 - bits)).astype(np.int32), ok))
    return out


def _slices(column: list, limit: int = 2_000_000):
    """Row ranges of about ``limit`` characters; a longer text has a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(column):
        n = len(t or "")
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(column):
        yield begin, len(column)


def train(docs: DataFrame, usable: Column, p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Counts over a bounded, hash-chosen sample of the rows where ``usable`` holds.

    Rows with a null text or label are left out. Without any row the model is empty and
    every text is ``und``.
    """
    rows = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the sample is bounded, so four tasks count it and each returns one vector per language
    rows = bounded_sample(rows, "doc_id", p.max_train).select("lang", "text").repartition(4)
    size = 1 << p.bits

    def count(batch: pa.RecordBatch):
        langs = np.array(batch.column(0).to_pylist(), object)
        column = texts(batch.column(1))
        for lang in sorted(set(langs)):
            chosen = [column[i] for i in np.flatnonzero(langs == lang)]
            total = np.zeros(size, np.int64)
            for a, b in _slices(chosen):
                x, _ = code_points(chosen[a:b])
                for _, h, ok in grams(x, p.orders, p.bits):
                    total += np.bincount(h[ok], minlength=size)
            yield row(lang, len(chosen), total)

    def row(lang: str, n: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_pydict({"lang": [lang], "docs": [n], "counts": [pack_arrays(at=at.astype(np.uint32), n=total[at])]}, pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("counts", pa.binary())]))

    def add(batch_iter):
        sums: dict[str, list] = {}
        for batch in batch_iter:
            for lang, docs_, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = sums.setdefault(lang, [0, np.zeros(size, np.int64)])
                s[0] += docs_
                a = unpack_arrays(counts)
                s[1][a["at"]] += a["n"]
            if len(sums) > 64:
                yield from (row(k, *v) for k, v in sums.items())
                sums = {}
        yield from (row(k, *v) for k, v in sums.items())

    schema = "lang string, docs long, counts binary"
    parts = map_batches(rows, schema, count).mapInArrow(add, schema).collect()
    langs = sorted({r["lang"] for r in parts})
    number = {x: i for i, x in enumerate(langs)}
    bits = max(1, min(p.bits, int(p.entry_bits - np.log2(max(1, len(langs))))))
    p, fold_ = replace(p, bits=bits), p.bits - bits  # buckets are the first bits of a hash
    matrix = np.zeros((1 << bits, len(langs)), np.float32 if len(langs) > 200 else np.float64)
    prior = np.zeros(len(langs))
    for r in parts:
        k = number[r["lang"]]
        a = unpack_arrays(bytes(r["counts"]))
        np.add.at(matrix[:, k], (a["at"] >> np.uint32(fold_)).astype(np.int64), a["n"])
        prior[k] += r["docs"]
    smooth = matrix + p.smoothing
    with np.errstate(divide="ignore"):
        return LanguageModel(tuple(langs), np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if langs else matrix.astype(np.float32), np.log(prior / max(1.0, prior.sum())), p)


def predict(texts_: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each whole text."""
    pred: list[str] = [UNDETERMINED] * len(texts_)
    score = np.zeros(len(texts_))
    k = len(model.languages)
    if not k:
        return pred, score
    table = np.ascontiguousarray(model.log_prob.T)
    for a, b in _slices(texts_):
        rows = [i for i in range(a, b) if texts_[i]]
        if not rows:
            continue
        x, starts = code_points([texts_[i] for i in rows])
        logp = np.zeros((len(rows), k))
        letters = np.add.reduceat(x != 0, starts, dtype=np.int64)
        for n, h, ok in grams(x, model.params.orders, model.params.bits):
            begin = np.minimum(starts, len(h) - 1)
            empty = np.concatenate((starts[1:], [len(x)])) <= starts
            for j in range(k):
                v = table[j][h]
                v *= ok
                logp[:, j] += np.where(empty, 0.0, np.add.reduceat(v, begin, dtype=np.float64))
        logp += model.log_prior
        best = logp.argmax(axis=1)
        p = np.exp(logp - logp.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for r, i in enumerate(rows):
            if letters[r]:
                pred[i] = model.languages[best[r]]
                score[i] = p[r, best[r]]
    return pred, score


def identify(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Null, empty and letterless texts get ``und`` with score 0; repeated rows are scored one
    by one; ties go to the language that comes first in order.
    """

    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = predict(texts(batch.column(2)), known.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double", run)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; null for a null id, which is then neither held out nor learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def language_predictions(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """identify() with a model of the rows that are not held out.

    Null ids are neither held out nor learned from; rows with a null lang are scored only;
    an empty table gives an empty result. Other columns are not read.
    """
    return identify(docs, train(docs, fold() != 0, p), fold() == 0)
