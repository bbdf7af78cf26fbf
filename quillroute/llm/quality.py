"""Quality rules with risk-controlled thresholds.

Each rule is a feature of a document with a cutoff; documents above the cutoff are rejected.
A cutoff is used only when labelled holdouts prove that it rejects few good documents: over
the good documents of a stratum, the one-sided Clopper-Pearson bound of the false-rejection
rate of all rules together has to be at most ``risk``, at a level corrected for the number of
strata and, by a fixed order of tests, for the number of rule sets that are tried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ids, cut, map_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
#: The features whose high values speak against a document, as columns of feature_values().
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "bang_share", "word_length", "short_word_share")
#: Strata by the number of words: false rejections are limited in each of them.
STRATA = (100, 400, 1600)


@dataclass(frozen=True)
class QualityParams:
    risk: float = 0.05
    confidence: float = 0.95
    levels: tuple[float, ...] = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)
    min_words: int = 50
    max_repeat_percent: int = 50


def word_statistics(b: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = b.split()
    n = len(words)
    solid = b.translate(None, _SPACES)
    chars = len(solid) - _continuation_bytes(solid)
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.translate(None, _SPACES)]
    dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeated_words(words)


def _continuation_bytes(b: bytes) -> int:
    if b.isascii():
        return 0
    x = np.frombuffer(b, np.uint8)
    return int(np.count_nonzero((x & 0xC0) == 0x80))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = Ids()
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    pair = w[:-1] * v + w[1:]
    if v < 2_000_000:
        key = pair[:-1] * v + w[2:]
    else:  # v**3 does not fit: number the pairs first
        key = np.unique(pair, return_inverse=True)[1][:-1].astype(np.int64) * v + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(n, bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def feature_values(b: bytes, stats: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    n, chars, symbols, dup, repeat = stats
    n1, c1 = max(1, n), max(1, chars)
    lines = max(1, b.count(b"\n") + 1)
    low = len(b) - len(b.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    up = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    bang = b.count(b"!")
    return (symbols / c1, repeat / n1, dup / lines, up / max(1, up + low), bang / n1, chars / n1, -chars / n1)


def base_failed(stats: tuple[int, ...], p: QualityParams) -> bool:
    n, repeat = stats[0], stats[4]
    return n < p.min_words or 100 * repeat > p.max_repeat_percent * n


def binomial_upper(k: int, n: int, alpha: float) -> float:
    """One-sided exact (Clopper-Pearson) upper bound of a rate after k events in n trials."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs, i = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))]), np.arange(k + 1)

    def below(p: float) -> float:
        terms = logs + i * math.log(p) + (n - i) * math.log1p(-p)
        top = terms.max()
        return math.exp(top) * float(np.exp(terms - top).sum())

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or below(mid) > alpha:
            lo = mid
        else:
            hi = mid
        if mid >= 1:
            break
    return hi


def choose_cutoffs(values: np.ndarray, good: np.ndarray, stratum: np.ndarray, p: QualityParams) -> np.ndarray:
    """Cutoff per stratum and feature (infinite: the rule is off there).

    One half of the labelled documents fixes a sequence of rule sets, from the most lenient
    to the strictest; the other half, the holdout, tests them in that order. A set passes if
    the exact bound of the rate at which all its rules together reject good documents is at
    most ``risk``; testing stops at the first that fails (fixed-sequence testing), and the
    level is divided by the number of strata (Bonferroni), so all strata hold at once with
    probability ``confidence``. Of the sets that pass, the first that catches nearly all
    that any of them catches is used. A stratum with too few labels gets no rule.
    """
    k = len(STRATA) + 1
    out = np.full((k, len(FEATURES)), np.inf)
    half = np.arange(len(values)) % 2 == 0
    for s in range(k):
        hold = values[~half & (stratum == s) & good]
        tune_good = values[half & (stratum == s) & good]
        tune_bad = values[half & (stratum == s) & ~good]
        if not len(hold) or not len(tune_good) or not len(tune_bad):
            continue
        passed = []
        for level in p.levels:
            cuts = rule_set(tune_good, tune_bad, level)
            events = int((hold > cuts).any(axis=1).sum())
            if binomial_upper(events, len(hold), (1 - p.confidence) / k) > p.risk:
                break
            passed.append(((tune_bad > cuts).any(axis=1).mean(), cuts))
        if passed:
            most = max(x for x, _ in passed)
            out[s] = next(cuts for caught, cuts in passed if caught >= 0.99 * most)
    return out


def rule_set(good: np.ndarray, bad: np.ndarray, level: float) -> np.ndarray:
    """Cutoffs that leave a share of ``level`` of the good above each, put midway to the bad ones beyond."""
    cuts = np.full(good.shape[1], np.inf)
    for f in range(good.shape[1]):
        edge = np.quantile(good[:, f], 1 - level, method="higher")
        beyond = bad[bad[:, f] > edge, f]
        if len(beyond) >= max(2, 0.01 * len(bad)):
            cuts[f] = (edge + beyond.min()) / 2
    return cuts


def _measure(doc_ids: pa.Array, column: pa.Array, p: QualityParams):
    stats, feats = [], []
    for b in text_bytes(column):
        b = b or b""
        s = word_statistics(b)
        stats.append(s)
        feats.append(feature_values(b, s))
    return np.array(stats, np.int64).reshape(-1, 5), np.array(feats, float).reshape(-1, len(FEATURES))


def _stratum(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(STRATA), n_words, side="right")


def _cells(batch: pa.RecordBatch, half: int, quality: int):
    """stratum and feature values of the labelled rows of one half and label."""
    at = (batch.column(1).to_numpy() == half) & (batch.column(0).to_numpy() == quality)
    return batch.column(2).to_numpy()[at], np.stack([batch.column(3 + f).to_numpy()[at] for f in range(len(FEATURES))], axis=1)


def _sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _number(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(float)[0])


def _order_statistics(rows: DataFrame, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The values of the wanted ranks (from 0) of each cell (stratum and feature) over the tuning half's good rows, exactly.

    Sixteen bits of the numbers are settled in each of four passes, which count the rows under
    every prefix that still holds a wanted rank; at most 65,536 counts of each come to the driver.
    """
    k = len(FEATURES)
    inside = {(cell, rank): (0, rank) for cell, ranks in wanted.items() for rank in ranks}  # prefix, rank under it
    for shift in (48, 32, 16, 0):
        prefixes: dict[int, set[int]] = {}
        for (cell, _), (prefix, _) in inside.items():
            prefixes.setdefault(cell, set()).add(prefix)
        active = {cell: np.array(sorted(x), np.uint64) for cell, x in prefixes.items()}

        def count(batch: pa.RecordBatch, shift=shift, active=active) -> pa.RecordBatch:
            stratum, values = _cells(batch, 0, 1)
            cells, bins, n = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for cell, some in active.items():
                key = _sortable(values[stratum == cell // k, cell % k])
                if shift < 48:
                    key = key[np.isin(key >> np.uint64(shift + 16), some)]
                found, times = np.unique(key >> np.uint64(shift), return_counts=True)
                cells.append(np.full(len(found), cell, np.int32))
                bins.append(found)
                n.append(times)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(bins).view(np.int64)), pa.array(np.concatenate(n))], names=["cell", "bin", "n"])

        under: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in map_batches(rows, "cell int, bin long, n long", count).groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect():
            b = r["bin"] % (1 << 64)
            under.setdefault((r["cell"], b >> 16 if shift < 48 else 0), []).append((b, r["n"]))
        for (cell, rank), (prefix, left) in inside.items():
            for b, n in sorted(under[cell, prefix]):
                if left < n:
                    inside[cell, rank] = b, left
                    break
                left -= n
    return {which: _number(prefix) for which, (prefix, _) in inside.items()}


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> np.ndarray:
    """choose_cutoffs() over all labelled documents, as counts in Spark.

    Labels that are null, or of documents without a row or with several, are left out.
    Documents that the base rules reject are no part of the holdout. A hash of the id deals
    documents to the halves. Only counts and order statistics come to the driver.
    """
    lab = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("q2")).filter("quality = q2").drop("q2")
    k, strata, none = len(FEATURES), len(STRATA) + 1, np.full((len(STRATA) + 1, len(FEATURES)), np.inf)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, feats = _measure(batch.column(0), batch.column(1), p)
        keep = pa.array(~np.array([base_failed(tuple(s), p) for s in stats], bool))
        columns = [batch.column(0).cast(pa.int64()), pa.array(_stratum(stats[:, 0]).astype(np.int32)), *(pa.array(feats[:, i]) for i in range(k))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "stratum", *FEATURES]).filter(keep)

    # texts stay where they are: their few numbers meet the labels
    measured = map_batches(docs.filter("doc_id is not null").select("doc_id", "text"), "doc_id long, stratum int, " + ", ".join(f"{f} double" for f in FEATURES), measure)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    rows = cut(measured.join(lab, "doc_id").select("quality", half, "stratum", *FEATURES))
    size = {(r["stratum"], r["half"], r["quality"]): r["n"] for r in rows.groupBy("stratum", "half", "quality").agg(F.count("*").alias("n")).collect()}
    used = [s for s in range(strata) if all(size.get((s, *x)) for x in ((0, 0), (0, 1), (1, 1)))]
    if not used:
        return none
    rank = {(s, level): math.ceil((size[s, 0, 1] - 1) * (1 - level)) for s in used for level in p.levels}
    edges = _order_statistics(rows, {s * k + f: sorted({rank[s, level] for level in p.levels}) for s in used for f in range(k)})
    edge = {(s, n): np.array([edges[s * k + f, rank[s, level]] for f in range(k)]) for s in used for n, level in enumerate(p.levels)}

    def beyond(batch: pa.RecordBatch) -> pa.RecordBatch:
        stratum, values = _cells(batch, 0, 0)
        out = []
        for (s, n), e in edge.items():
            v = values[stratum == s]
            over = v > e
            out += [(s * k + f, n, int(over[:, f].sum()), float(v[over[:, f], f].min())) for f in range(k) if over[:, f].any()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))], names=["cell", "level", "n", "least"])

    cuts = {which: np.full(k, np.inf) for which in edge}
    for r in map_batches(rows, "cell int, level int, n long, least double", beyond).groupBy("cell", "level").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect():
        s, f = divmod(r["cell"], k)
        if r["n"] >= max(2, 0.01 * size[s, 0, 0]):
            cuts[s, r["level"]][f] = (edge[s, r["level"]][f] + r["least"]) / 2

    def events(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for quality, of_half in ((1, 1), (0, 0)):
            stratum, values = _cells(batch, of_half, quality)
            out += [(s, n, quality, int((values[stratum == s] > c).any(axis=1).sum())) for (s, n), c in cuts.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["stratum", "level", "quality", "n"])

    hit = {(r["stratum"], r["level"], r["quality"]): r["n"] for r in map_batches(rows, "stratum int, level int, quality int, n long", events).groupBy("stratum", "level", "quality").agg(F.sum("n").alias("n")).collect()}
    for s in used:
        passed = []
        for n in range(len(p.levels)):
            if binomial_upper(hit[s, n, 1], size[s, 1, 1], (1 - p.confidence) / strata) > p.risk:
                break
            passed.append((hit[s, n, 0] / size[s, 0, 0], cuts[s, n]))
        if passed:
            most = max(x for x, _ in passed)
            none[s] = next(c for caught, c in passed if caught >= 0.99 * most)
    return none


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, stratum int, rejected_by string"


def judge(docs: DataFrame, cutoffs: np.ndarray, p: QualityParams = QualityParams()) -> DataFrame:
    """The verdict and its reasons for every row of ``docs`` (doc_id, text).

    Null texts have no words and fail the base rules. Repeated rows are judged one by one.
    Other columns are not read, so their names cannot clash.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, feats = _measure(batch.column(0), batch.column(1), p)
        failed, rejected, stratum, why = verdicts(stats, feats, cutoffs, p)
        arrays = [batch.column(0).cast(pa.int64()), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & ~rejected), pa.array(stratum.astype(np.int32)), pa.array(why, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _OUT.split(", ")])

    return map_batches(docs.select("doc_id", "text"), _OUT, run)


def verdicts(stats: np.ndarray, feats: np.ndarray, cutoffs: np.ndarray, p: QualityParams):
    failed = (stats[:, 0] < p.min_words) | (100 * stats[:, 4] > p.max_repeat_percent * stats[:, 0])
    stratum = _stratum(stats[:, 0])
    over = feats > cutoffs[stratum]
    why = [",".join(np.array(FEATURES)[o]) if o.any() else None for o in over]
    return failed, over.any(axis=1), stratum, why


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names and order.

    Null and empty texts fail the base rules and go; null ids stay if their text passes; of
    repeated rows all stay or all go. See quality_verdicts().
    """
    cutoffs = fit(docs, labels, p)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, feats = _measure(batch.column(0), batch.column(at), p)
        failed, rejected, _, _ = verdicts(stats, feats, cutoffs, p)
        return batch.filter(pa.array(~failed & ~rejected))

    return map_batches(docs, docs.schema, run)


def quality_verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """judge() with cutoffs fitted on the labelled rows.

    One row per row of ``docs``, repeated rows one by one. Null and empty texts have no word
    and fail the base rules. Without labels (null ones count as none) no cutoff is proven, and
    only the base rules reject. Equal texts share a verdict; an empty table gives an empty
    result; other columns are not read.
    """
    return judge(docs, fit(docs, labels, p), p)
