"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression.

Features are sparse and binary: which words, and which word beginnings, a document has.
Those that best tell toxic documents apart are chosen by greedy cover under a
log-likelihood-ratio test (at most ``max_features``). One weight vector is shared by all ordered thresholds:
P(grade >= k) = logistic(w.x - b_k) with b_1 < b_2 < ...; the output is the expected grade.

The label is binary, so the grades of toxic training documents come from how much of the
vocabulary that the labels single out they use: 0 clean, then 1 to ``grades`` by equal
shares of the toxic documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, map_batches, texts

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityParams:
    prefixes: tuple[int, ...] = (4, 5, 6)
    max_train: int = 12_000
    max_toxic: int = 3_000
    max_features: int = 4_000
    min_support: int = 3
    min_llr: float = 12.0
    grades: int = 3
    l2: float = 0.05
    steps: int = 400
    cover: int = 2
    cutoff: float = 0.5
    smallest_class: int = 5


@dataclass(frozen=True)
class ToxicityModel:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; empty: nothing was learned
    params: ToxicityParams


def document_features(text: str | None, p: ToxicityParams) -> set[str]:
    """Words of the whole text as ``=word`` and word beginnings as ``begin``."""
    words = set(_WORD.findall((text or "").lower()))
    found = {"=" + w for w in words}
    for n in p.prefixes:
        found |= {w[:n] for w in words if len(w) > n}
    return found


def _llr(a: int, b: int, na: int, nb: int) -> float:
    """Signed log-likelihood ratio of seeing a feature in a of na toxic and b of nb clean documents."""

    def term(k: float, e: float) -> float:
        return k * math.log(k / e) if k > 0 else 0.0

    n, k = na + nb, a + b
    g = 2 * (term(a, k * na / n) + term(b, k * nb / n) + term(na - a, (n - k) * na / n) + term(nb - b, (n - k) * nb / n))
    return g if a * nb >= b * na else -g


def distinct_rows(rows: list[np.ndarray], bands: int = 6, width: int = 6, seed: int = 1) -> list[int]:
    """Positions of documents (word hashes), near copies counted once (bands of word MinHashes)."""
    mults = (np.random.default_rng(seed).integers(1, 1 << 62, (bands, width)) * 2 + 1).astype(np.uint64)
    taken: set[tuple] = set()
    kept = []
    for i, h in enumerate(rows):
        if not len(h):
            kept.append(i)
            continue
        sig = [(b, *(int((h * m).min()) for m in mults[b])) for b in range(bands)]
        if not any(x in taken for x in sig):
            kept.append(i)
        taken.update(sig)
    return kept


def same_word(f: str, g: str) -> bool:
    """Whether two features are forms of one word, such as ``=idiot`` and ``idio``."""
    f, g = f.lstrip("="), g.lstrip("=")
    return f.startswith(g) or g.startswith(f)


def hash_word(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def select_features(rows: list[set[str]], toxic: np.ndarray, p: ToxicityParams) -> dict[str, int]:
    """Features by greedy cover: the one that best tells the toxic documents not yet explained.

    A toxic document counts as explained once it has ``cover`` chosen features, so words that
    merely come along with the telling ones are not taken.
    """
    seen, where = Counter(), {}
    for i, (r, t) in enumerate(zip(rows, toxic, strict=True)):
        if t:
            for f in r:
                where.setdefault(f, []).append(i)
        else:
            seen.update(r)
    na, nb = int(toxic.sum()), int(len(toxic) - toxic.sum())
    left = {f: set(at) for f, at in where.items() if len(at) >= p.min_support and _llr(len(at), seen.get(f, 0), na, nb) >= p.min_llr}
    need = dict.fromkeys(np.flatnonzero(toxic).tolist(), p.cover)
    chosen: list[str] = []
    gain = {f: _llr(len(at), seen.get(f, 0), na, nb) for f, at in left.items()}
    heap = [(-g, f[0] != "=", -len(f), f) for f, g in gain.items()]
    heapq.heapify(heap)
    while heap and len(chosen) < p.max_features:
        g, *_, f = heapq.heappop(heap)
        at = {i for i in left[f] if need[i] > 0}
        now = _llr(len(at), seen.get(f, 0), na, nb) if len(at) >= p.min_support else -1.0
        if now < p.min_llr:
            continue
        if now < -g - 1e-9:  # some of its documents are explained by now: look again later
            heapq.heappush(heap, (-now, f[0] != "=", -len(f), f))
            continue
        if any(same_word(f, g) and len(left[f] & left[g]) >= 0.9 * len(left[f]) for g in chosen):
            continue
        chosen.append(f)
        for i in at:
            need[i] -= 1
    return {f: i for i, f in enumerate(chosen)}


def _grades(rows: list[set[str]], toxic: np.ndarray, index: dict[str, int], p: ToxicityParams) -> np.ndarray:
    found = np.array([sum(f in index for f in r) for r in rows])
    y = np.zeros(len(rows), np.int64)
    if toxic.any():
        edges = np.quantile(found[toxic], np.linspace(0, 1, p.grades + 1)[1:-1])
        y[toxic] = 1 + np.searchsorted(edges, found[toxic], side="left")
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(indices: list[np.ndarray], y: np.ndarray, n_features: int, grades: int, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised log-likelihood of the cumulative links.

    The thresholds are kept in order by being sums of positive steps.
    """
    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    cols = np.concatenate(indices).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    n = len(y)
    # one row's weight: classes balanced by halves, clean against toxic
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(n_features)
    raw = np.concatenate(([0.5], np.zeros(grades - 1)))  # first threshold, log of the steps
    theta = [w, raw]
    m = [np.zeros_like(t) for t in theta]
    v = [np.zeros_like(t) for t in theta]
    for step in range(1, p.steps + 1):
        w, raw = theta
        b = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        score = np.bincount(rows, weights=w[cols], minlength=n)
        # P(y >= k) for k = 0..grades+1, and the likelihood of each row's own grade
        up = np.column_stack([np.ones(n), *(_sigmoid(score - t) for t in b), np.zeros(n)])
        own = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-12)
        slope = up * (1 - up)
        at = np.arange(n)
        g_score = share * (slope[at, y] - slope[at, y + 1]) / own
        g_b = np.zeros(grades)
        for k in range(1, grades + 1):
            g_b[k - 1] = -(share * ((y == k) * slope[:, k] - (y + 1 == k) * slope[:, k]) / own).sum()
        g_w = np.bincount(cols, weights=g_score[rows], minlength=n_features) - p.l2 * w / max(1, n_features)
        g_raw = np.concatenate(([g_b.sum()], np.cumsum(g_b[::-1])[::-1][1:] * np.exp(raw[1:])))
        for i, g in enumerate((g_w, g_raw)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    w, raw = theta
    return w, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """A model from at most about ``max_train`` labelled documents, ``max_toxic`` of them toxic.

    Ids that are null, or have contradicting or null labels, are left out. With fewer than
    ``smallest_class`` toxic or clean documents nothing is learned and nothing is rejected.
    """
    lab = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t2")).filter("toxic = t2").drop("t2")
    lab = bounded_sample(lab.filter("toxic = 1"), "doc_id", p.max_toxic, seed=7).union(bounded_sample(lab.filter("toxic = 0"), "doc_id", p.max_train - p.max_toxic, seed=7))
    # bounded as well: at most about max_train ids, and then as many texts
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id"))

    toxic_rows = sample.filter("toxic = 1").select("doc_id", "text")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, all_ = [], []
        for t in texts(batch.column(1)):
            found = document_features(t, p)
            words.append(np.sort(np.fromiter((hash_word(f) for f in found if f[0] == "="), np.uint64)).tobytes())
            all_.append(np.fromiter(map(hash_word, found), np.uint64, len(found)).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(words, pa.binary()), pa.array(all_, pa.binary())], names=["doc_id", "words", "features"])

    # Toxic documents come as hashes; of their features only those that enough of them have
    # and that tell them from clean documents are asked for by name.
    table = map_batches(toxic_rows, "doc_id long, words binary, features binary", hashed).toPandas().sort_values("doc_id", kind="stable")
    kept = distinct_rows([np.frombuffer(w, np.uint64) for w in table["words"]])
    arrays = [np.frombuffer(f, np.uint64) for f in table["features"]]
    arrays = [arrays[i] for i in kept]
    del table
    seen, times = np.unique(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64), return_counts=True)
    seen, times = seen[times >= p.min_support], times[times >= p.min_support]

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, n = np.zeros(len(seen), np.int64), 0
        for t in texts(batch.column(1)):
            total[members(document_features(t, p), seen)] += 1
            n += 1
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype("<u4").tobytes()], pa.binary())], names=["n", "counts"])

    clean_rows = sample.filter("toxic = 0").select("doc_id", "text")
    parts = map_batches(clean_rows.repartition(4), "n long, counts binary", known).collect()
    n_clean = sum(r["n"] for r in parts)
    clean_counts = sum((np.frombuffer(r["counts"], "<u4").astype(np.int64) for r in parts), np.zeros(len(seen), np.int64))
    telling = [i for i in range(len(seen)) if n_clean and _llr(int(times[i]), int(clean_counts[i]), len(arrays), n_clean) >= p.min_llr]
    telling_hashes = seen[telling]

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [sorted(f for f in found if hash_word(f) in wanted) for found in (document_features(t, p) for t in texts(batch.column(1)))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "features"])

    wanted = set(telling_hashes.tolist())
    toxic = map_batches(toxic_rows, "doc_id long, features array<string>", named).toPandas().sort_values("doc_id", kind="stable")["features"].tolist()
    clean = map_batches(clean_rows, "doc_id long, features array<string>", named).toPandas()["features"].tolist()
    return fit_rows([set(toxic[i]) for i in kept], [set(f) for f in clean], p)


def members(found: set[str], among: np.ndarray) -> np.ndarray:
    """Positions in a sorted array of hashes of the features that are there."""
    if not found or not len(among):
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hash_word, found), np.uint64, len(found))
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return at[among[at] == h]


def fit_rows(toxic: list[set[str]], clean: list[set[str]], p: ToxicityParams) -> ToxicityModel:
    none = ToxicityModel({}, np.zeros(0), np.zeros(0), p)
    if min(len(toxic), len(clean)) < p.smallest_class:
        return none
    rows = [*toxic, *clean]
    is_toxic = np.arange(len(rows)) < len(toxic)
    index = select_features(rows, is_toxic, p)
    if not index:
        return none
    y = _grades(rows, is_toxic, index, p)
    indices = [np.array(sorted(index[f] for f in r if f in index), np.int64) for r in rows]
    w, b = fit_ordinal(indices, y, len(index), p.grades, p)
    return ToxicityModel(index, w, b, p)


def score_texts(column: list[str | None], model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= 1) and expected grade of each whole text; null and empty texts are clean."""
    n = len(column)
    if not len(model.thresholds):
        return np.zeros(n), np.zeros(n)
    raw = np.zeros(n)
    empty = np.zeros(n, bool)
    index, weights, p = model.index, model.weights, model.params
    for i, t in enumerate(column):
        if not t:
            empty[i] = True
            continue
        words = set(_WORD.findall(t.lower()))
        keys = {"=" + w for w in words if "=" + w in index}
        for k in p.prefixes:
            keys |= {w[:k] for w in words if len(w) > k and w[:k] in index}
        raw[i] = sum(weights[index[f]] for f in keys)
    up = _sigmoid(raw[:, None] - model.thresholds[None, :])
    up[empty] = 0
    return up[:, 0], up.sum(axis=1)


def grade(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic for every row; other columns are not read."""
    p = model.params

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, expected = score_texts(texts(batch.column(1)), model)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(first), pa.array(first >= p.cutoff)], names=["doc_id", "severity", "p_toxic", "toxic"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, severity double, p_toxic double, toxic boolean", run)


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, whatever their names.

    Null and empty texts are clean and stay; null ids are scored like others; of repeated rows all stay or all go. Without toxic
    labels nothing is known to be toxic, and every row stays.
    """
    model = fit(docs, labels, p)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, _ = score_texts(texts(batch.column(at)), model)
        return batch.filter(pa.array(first < p.cutoff))

    return map_batches(docs, docs.schema, run)


def toxicity_grades(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """grade() with a model fitted on the labelled rows: one row per row of ``docs``.

    Null texts count as empty, repeated rows are scored one by one, null labels and labels of
    unknown ids teach nothing, an empty table gives an empty result, other columns are not read.
    """
    return grade(docs, fit(docs, labels, p))
