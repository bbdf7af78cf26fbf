"""Spelling variants: two-dimensional range reporting over words sorted forwards and backwards.

Two words one edit apart share all before the edit and all after it. Sorted forwards, the words
with a common beginning are an interval; sorted by their reversed letters, those with a common
end are one too. A word is a point (place in the first order, place in the second), so for each
edit position the words that fit are the points of a rectangle, which a wavelet tree reports.

Spark deals the words so that only words that may be near meet. A cell is a length L and a range
of edit positions; its words (of L and L + 1 letters) are keyed by the letters before the range
and after it, and each pair is reported at one position only, the first at which the words
differ, so in one cell. Two ranges per length come first. A key that holds more words than a task should has
its range halved, with longer keys, as often as needed; a range of one position holds the
words that differ in one place, which the alphabet bounds. No word or pair is dropped.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_caches, release_memory, run_starts, ship_package, text_bytes

#: The letters of runs (the lower-cased text has no A-Z), and the lower case of A-Z.
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class VariantParams:
    least_letters: int = 5
    least_count: int = 3
    noise_modulus: int = 97
    ratio: int = 2  # a form is at least so many times as frequent
    key_words: int = 4096
    key_bytes: int = 1 << 22
    bin_words: int = 40_000
    bin_bytes: int = 1 << 23
    held: int = 200_000  # words that a worker counts before it hands them on


# -- words ------------------------------------------------------------------------------


def noisy(doc_id: int | None, word: str, modulus: int) -> str:
    """The word, or for some (document, word) pairs the word without one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """word, n: all words of enough letters and occurrences. Counts are summed in each worker before they are shuffled."""

    def run(batches):
        drop_caches()
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                here: dict[str, int] = {}
                for word in _RUN.findall((text or b"").translate(_LOWER).decode()):
                    if len(word) >= p.least_letters:  # deleting a letter makes no word longer
                        here[word] = here.get(word, 0) + 1
                for word, n in here.items():
                    word = noisy(doc_id, word, p.noise_modulus)
                    if len(word) >= p.least_letters:
                        found[word] = found.get(word, 0) + n
                if len(found) > p.held:
                    yield out()
        if found:
            yield out()
        release_memory()

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least_count)


# -- range reporting --------------------------------------------------------------------


class WaveletTree:
    """A sequence of numbers; reports those in a range of places and a range of values."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, per bit from the highest
        for bit in range(self.levels - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            values = np.concatenate([values[~one], values[one]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value v with ``low <= v < high`` at a place with ``begin <= place < end``, for all queries at once."""
        query = np.flatnonzero((begin < end) & (low < high))
        a, b, first = begin[query], end[query], np.zeros(len(query), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.levels - 1 - level)
            za, zb, all_zeros = zeros[a], zeros[b], zeros[-1]
            sides = ((za, zb, first), (all_zeros + a - za, all_zeros + b - zb, first + half))
            parts = []
            for x, y, v in sides:
                keep = (x < y) & (v < high[query]) & (v + half > low[query])
                parts.append((query[keep], x[keep], y[keep], v[keep]))
            query, a, b, first = (np.concatenate(c) for c in zip(*parts, strict=True))
        copies = b - a
        return np.repeat(query, copies), np.repeat(first, copies)


def letters(words: list[bytes], width: int) -> np.ndarray:
    """Latin-1 words as rows of bytes, filled up with zeros."""
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _sorted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows, each row's place in it, and the common beginning of each row in order with the one before it."""
    order = np.argsort(m.view(f"S{m.shape[1]}").reshape(-1), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    s = m[order]
    same = np.cumprod(s[1:] == s[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64) if m.size < 1 << 22 else np.array([_common(x, y) for x, y in zip(s[:-1], s[1:], strict=True)], np.int64)
    return order, place, np.concatenate(([-1], same))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else len(x)


def _interval(common: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval of the order whose words share ``depth`` letters with the word at each place."""
    starts = np.flatnonzero(common < depth)
    at = np.searchsorted(starts, place, "right") - 1
    return starts[at], np.append(starts[1:], len(common))[at]


def near_pairs(short: list[bytes], long: list[bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart whose first difference is at a place from ``low`` to ``high`` - 1.

    All ``short`` words have L letters, all ``long`` ones L + 1; words are distinct, and numbered
    with the short ones first. Pairs are (short, short), both ways round, and (short, long).
    """
    n = len(short)
    size = len(short[0]) if n else 0
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n or n + len(long) < 2:
        return none
    words = short + long
    m = letters(words, size + 1)
    forwards, fplace, fcommon = _sorted(m)
    backwards, bplace, bcommon = _sorted(letters([w[::-1] for w in words], size + 1))
    is_short = forwards < n
    found = []
    # the first difference of two words is the least common beginning between them, so one of these
    depths = np.unique(fcommon[1:])
    depths = depths[(depths >= low) & (depths < high) & (depths <= size)]
    for targets, gap in ((is_short, 1), (~is_short, 0)):
        before = np.concatenate(([0], np.cumsum(targets)))  # places among the targets
        if before[-1] == 0:
            continue
        tree = WaveletTree(bplace[forwards[targets]])
        for depth in depths:
            if size - depth - gap < 0:
                continue
            begin, end = _interval(fcommon, fplace[:n], depth)
            first, last = _interval(bcommon, bplace[:n], size - depth - gap)
            ask = np.flatnonzero((before[end] - before[begin] > gap) & (last - first > 1))  # more than the word itself
            if not len(ask):
                continue
            q, value = tree.report(before[begin[ask]], before[end[ask]], first[ask], last[ask])
            x, y = ask[q], backwards[value]
            # the pair's own place: the next letters differ (this also leaves out the word itself)
            differ = m[x, depth] != m[y, depth] if depth < size else np.full(len(x), gap == 0)
            found.append((x[differ], y[differ]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else none


# -- cells ------------------------------------------------------------------------------


def cells(words: DataFrame, p: VariantParams) -> DataFrame:
    """word, n, size (L), low, high, key: four rows a word, and more where keys were too frequent."""

    def keyed(df: DataFrame) -> DataFrame:
        # the last size - high letters are after the range, whichever of both lengths a word has
        tail = F.greatest(F.lit(0), F.col("size") - F.col("high"))
        beginning, rest = F.substring("word", F.lit(1), F.col("low")), F.when(tail > 0, F.substring("word", -tail, tail)).otherwise("")
        return df.withColumn("key", F.xxhash64("size", "low", "high", beginning, rest))

    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.filter(F.array(length, length - 1), lambda x: x >= p.least_letters)))
    half = (F.col("size") / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("size") + 1).alias("high")))
    todo = keyed(rows.withColumn("r", F.explode(ranges)).select("word", "n", "size", F.col("r.low"), F.col("r.high")))
    done = None
    while True:
        counts = todo.groupBy("key", "low", "high").agg(F.count("*").alias("k"), F.sum(F.length("word").cast("long")).alias("bytes"))
        heavy = cut(counts.filter(((F.col("k") > p.key_words) | (F.col("bytes") > p.key_bytes)) & (F.col("high") - F.col("low") > 1)).select("key"))
        n = heavy.count()
        if not n:
            return todo if done is None else done.unionByName(todo)
        # a key with a third of the words would be one task of a shuffled join; few keys are sent to all instead
        few = F.broadcast(heavy) if n <= 100_000 else heavy
        light = todo.join(few, "key", "left_anti")
        done = light if done is None else done.unionByName(light)
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        split = todo.join(few, "key", "left_semi").withColumn("r", F.explode(halves)).select("word", "n", "size", F.col("r.low"), F.col("r.high"))
        todo = cut(keyed(split))


def neighbourhoods(words: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n, ties to the smaller word) of every word with near words."""
    dealt = cut(cells(words, p))
    rows, size = dealt.agg(F.count("*"), F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0))).first()
    bins = max(1, -(-rows // p.bin_words), -(-size // p.bin_bytes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (size, low, high), part in pdf.groupby(["size", "low", "high"]):
            raw = [w.encode("latin-1") for w in part["word"]]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            order = np.concatenate([np.flatnonzero(lengths == size), np.flatnonzero(lengths == size + 1)])
            short = int((lengths == size).sum())
            words_ = [raw[i] for i in order]
            x, y = near_pairs(words_[:short], words_[short:], int(low), int(high))
            if not len(x):
                continue
            # pairs of one length are found from both sides, the others from the shorter word
            more = y >= short
            x, y = np.concatenate([x, y[more]]), np.concatenate([y, x[more]])
            n = part["n"].to_numpy(np.int64)[order]
            rank = np.empty(len(words_), np.int64)
            rank[np.argsort(np.array(words_, object), kind="stable")] = np.arange(len(words_))
            by = np.lexsort((rank[y], -n[y], x))
            x, y = x[by], y[by]
            starts = run_starts(x)
            column = part["word"].to_numpy(object)[order]
            out.append(pd.DataFrame({"word": column[x[starts]], "n_near": np.diff(np.append(starts, len(x))), "form_n": n[y[starts]], "form": column[y[starts]]}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "form_n": [], "form": []})

    ship_package(words.sparkSession)
    binned = dealt.withColumn("bin", F.pmod("key", F.lit(bins)))
    found = binned.groupBy("bin").applyInPandas(run, "word string, n_near long, form_n long, form string")
    # F.min of (-n, word): the largest n, then the smallest word
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each (word, form) on to the last form, by joining with twice as long steps each time."""
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        # counts at least double along forms, so there are few steps and no circles
        further = step.alias("a").join(step.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = further.drop("moved")
        if further.filter("moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least ``least_letters`` letters and ``least_count`` occurrences.

    Words are runs of Latin letters with A-Z lower-cased, after the letter that ``noisy`` deletes;
    a null doc_id is an empty string there. Words are near if one inserted, deleted or replaced
    letter makes one the other. Null and empty texts have no words; a run of any length is
    a word. Repeated rows count each time; an empty table gives an empty result.
    """
    words = cut(word_counts(docs, p))
    near = neighbourhoods(words, p)
    found = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n") >= p.ratio * F.col("n"), F.struct("form", "form_n")).alias("f")))
    root = roots(found.filter("f is not null").select("word", F.col("f.form")))
    return found.join(root, "word", "left").select("word", "n", "n_near", F.col("f.form"), F.col("f.form_n"), F.coalesce("root", "word").alias("root"))
