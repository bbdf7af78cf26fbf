"""Best-fit packing of tokenized documents into sequences of fixed length.

Only the histogram of piece lengths matters for the plan, and it has at most ``capacity``
entries, so the plan is made on the driver: single lengths, sums of two and sums of three
lengths are indexed, combinations that exactly complete a sequence are consumed as often as
their counts allow, and what is left is packed best-fit, longest first. The plan is a list
of patterns (lengths that share a sequence) with multiplicities. Pieces are then numbered
within their length on the executors and looked up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import resolve
from .common import cut, map_batches, texts, worker_cache

#: White space in Python's sense that the vocabulary's pattern does not take for white space.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


@dataclass(frozen=True)
class PackingParams:
    vocabulary: str = "word_bpe_49k.json"
    capacity: int = 4096
    end_id: int = 1
    salts: int = 64
    #: words whose ids each worker keeps; fewer save memory and cost time
    known_words: int = 1_500_000


# -- tokens ---------------------------------------------------------------------------


class _Tails(dict):
    """Ids of the punctuation behind words; no punctuation has none."""

    def __init__(self, owner: WordEncoder):
        super().__init__({"": b""})
        self.owner = owner

    def __missing__(self, tail: str) -> bytes:
        ids = self.owner._one_by_one([tail])[0]
        if len(self) < 10_000:
            self[tail] = ids
        return ids


class WordEncoder:
    """Ids of a word-level BPE vocabulary, each distinct word encoded once per worker.

    The vocabulary drops white space and splits words at it, so a text's ids are those of
    its words in turn; its special tokens hold no white space. A word of letters with ASCII
    punctuation behind it splits between the two, and the last token of each such part is
    marked as a word end, so many of them are encoded in one call and told apart again.
    """

    def __init__(self, path: str, known_words: int = 1_500_000):
        from tokenizers import Tokenizer

        self.known_words = known_words

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # the words met lately, and those met in the generation before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.tails = _Tails(self)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        for lo in range(0, len(parts), 2000):
            some = parts[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(some):
                self.parts.update(zip(some, map(lambda a, b: raw[a:b], [0, *ends], ends), strict=True))
            else:
                self.parts.update(zip(some, self._one_by_one(some), strict=True))

    def _learn(self, words: set[str]) -> None:
        known, parts, tails = self.known, self.parts, self.tails
        later = []
        for w in words:
            stem = w.rstrip(_TAIL)
            key = stem.lower() if stem.isascii() else stem
            ids = parts.get(key)
            if ids is None:
                later.append((w, key, len(stem)))
            elif len(stem) == len(w):
                known[w] = ids
            else:
                known[w] = ids + tails[w[len(stem) :]]
        self._learn_parts(list({k for _, k, n in later if 0 < n < 200 and k.lower().isalpha()}))
        odd = []
        for w, key, n in later:
            if (ids := parts.get(key)) is None:
                odd.append(w)
            else:
                known[w] = ids + tails[w[n:]]
        known.update(zip(odd, self._one_by_one(odd), strict=True))

    def _age(self) -> None:
        """Forget the words of the generation before, once there are too many of both."""
        if 2 * len(self.known) > self.known_words:
            self.older, self.known = self.known, {}
        if 2 * len(self.parts) > self.known_words:
            self.parts = {}

    def encode_all(self, column: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self._age()
        known, older = self.known, self.older
        split = [[t] if t and any(c in t for c in _NOT_SPACE) else (t or "").split() for t in column]
        new = set(filterfalse(known.__contains__, chain.from_iterable(split)))
        if new:
            again = list(filter(older.__contains__, new)) if older else []
            known.update(zip(again, map(older.__getitem__, again), strict=True))
            self._learn(new.difference(again))
        return [b"".join(map(known.__getitem__, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def _clear() -> bool:
    held = any(e.known for e in _encoders.values())
    _encoders.clear()
    return held


worker_cache("packing", _clear)


def encoder(path: str, known_words: int = 1_500_000) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, known_words)
    _encoders[path].known_words = known_words
    return _encoders[path]


def tokenize(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """The pieces of every row: doc_id, piece, start, length, ids_crc32.

    Null and empty texts give one piece that holds only the end id.
    """
    width = 4 * p.capacity

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(resolve(p.vocabulary), p.known_words)
        ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
        end = np.array([p.end_id], "<u4").tobytes()
        column = texts(batch.column(1))
        for lo in range(0, len(column), 500):
            for doc, raw in zip(ids[lo : lo + 500], enc.encode_all(column[lo : lo + 500]), strict=True):
                raw += end
                for i, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    for o, v in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        o.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", run, keep="packing")


# -- plan -----------------------------------------------------------------------------


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, longest first) and how many sequences follow each."""
    count = {k: n for k, n in histogram.items() if n > 0}
    if any(k < 1 or k > capacity for k in count):
        raise ValueError("lengths must lie between 1 and the capacity")
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> bool:
        """Use the combination as often as the counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(count.get(x, 0) // k for x, k in need.items())
        if times <= 0:
            return False
        for x, k in need.items():
            count[x] -= k * times
        out.append((tuple(sorted(lengths, reverse=True)), times))
        return True

    consume((capacity,))
    for first in sorted(count, reverse=True):  # one other length fills the gap exactly
        if count[first]:
            consume((first, capacity - first))
    _exact_sums(count, capacity, consume, 2)
    _exact_sums(count, capacity, consume, 3)
    out += _best_fit(count, capacity)
    return out


def _exact_sums(count: dict[int, int], capacity: int, consume, terms: int) -> None:
    """For each length, longest first, fill its gap by ``terms`` lengths that are still there.

    The index is over sums: which larger length completes a pair to a given sum is looked up
    in an array of live lengths; a triple is a length and a pair index of what then is left.
    """
    live = np.zeros(capacity + 1, bool)
    for k, n in count.items():
        live[k] = n > 0

    def refresh(lengths: tuple[int, ...]) -> None:
        for x in lengths:
            live[x] = count.get(x, 0) > 0

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(lengths.count(x) <= count.get(x, 0) for x in lengths)

    def pair(total: int, most: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """(b, c), b >= c, that are left besides ``taken``, with b + c = total and b as long as it can be."""
        high, low = min(most, total - 1), (total + 1) // 2
        if high < low or not enough(taken):
            return None
        b = np.arange(high, low - 1, -1)
        hit = np.flatnonzero(live[b] & live[total - b])
        # only pairs with equal lengths, or with one of those taken, can be short of copies
        return next((x for x in ((int(i), int(total - i)) for i in b[hit]) if enough((*taken, *x))), None)

    for first in sorted((k for k, n in count.items() if n > 0), reverse=True):
        gap = capacity - first
        while count[first] > 0 and gap >= terms:
            found = None
            if terms == 2:
                found = pair(gap, min(first, gap), (first,))
            else:
                for b in np.flatnonzero(live[: min(first, gap - 2) + 1])[::-1].tolist():
                    if 3 * b < gap:
                        break
                    rest = pair(gap - b, b, (first, b))
                    if rest:
                        found = (b, *rest)
                        break
            if found is None:
                break
            consume((first, *found))
            refresh((first, *found))


def _best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes: open sequences of equal gap and pattern move together."""
    gaps: list[int] = []  # sorted gaps that have open sequences
    open_at: dict[int, list[list]] = {}  # gap -> [pattern, number]

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_at:
            open_at[gap] = []
            bisect.insort(gaps, gap)
        open_at[gap].append([pattern, n])

    for length in sorted((k for k, n in count.items() if n > 0), reverse=True):
        left = count[length]
        while left:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put((length,) * per, full)
                if rest:
                    put((length,) * rest, 1)
                break
            gap = gaps[i]
            group = open_at[gap][-1]
            per = gap // length
            if per * group[1] <= left:
                put_n, add = group[1], per
            elif left >= per:
                put_n, add = left // per, per
            else:
                put_n, add = 1, left
            group[1] -= put_n
            if not group[1]:
                open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    gaps.pop(i)
            put((*group[0], *(length,) * add), put_n)
            left -= put_n * add
        count[length] = 0
    return [(pattern, n) for g in gaps for pattern, n in open_at[g]]


@dataclass(frozen=True)
class Slots:
    """The plan as intervals: numbers ``begin``.. of a length go to consecutive sequences."""

    length: np.ndarray
    begin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> Slots:
    used: dict[int, int] = {}
    rows = []
    base = 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            begin = used.get(x, 0)
            rows.append((x, begin, base, at))
            used[x] = begin + times
            at += x
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*(np.ascontiguousarray(table[:, i]) for i in range(4)))


def look_up(slots: Slots, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the piece with this number among the pieces of its length."""
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stride = int(max(slots.begin.max(), number.max())) + 1
    at = np.searchsorted(slots.length * stride + slots.begin, length * stride + number, side="right") - 1
    return slots.sequence[at] + number - slots.begin[at], slots.offset[at]


def pack(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """All pieces of all rows with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and ids are packed one by one; null ids stay null. The plan broadcast to
    the executors has a few entries per distinct length, at most some 10^5 in all. Pieces of
    one length are spread over ``salts`` groups, each numbered on its own, so a length that
    a third of the corpus has is no single task; the groups' starts come from their counts.
    """
    spark = docs.sparkSession
    salted = tokenize(docs, p).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(p.salts)).cast("int"))
    # written once: the text is tokenized once, and both passes see the same salts
    pieces = cut(salted)
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most capacity x salts rows, whatever the corpus
    local = counts.toPandas().sort_values(["length", "salt"], kind="stable")
    histogram = local.groupby("length")["n"].sum()
    slots = slot_table(plan_patterns({int(k): int(v) for k, v in histogram.items()}, p.capacity))
    begins = (local.groupby("length")["n"].cumsum() - local["n"]).to_numpy(np.int64)
    keys = local["length"].to_numpy(np.int64) * p.salts + local["salt"].to_numpy(np.int64)
    numbered = pieces.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)
    plan = spark.sparkContext.broadcast((keys, begins, slots))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys_, begins_, slots_ = plan.value
        length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        salt = batch.column("salt").to_numpy(zero_copy_only=False).astype(np.int64)
        number = begins_[np.searchsorted(keys_, length * p.salts + salt)] + batch.column("k").to_numpy(zero_copy_only=False)
        sequence, offset = look_up(slots_, length, number)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(numbered, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place)
