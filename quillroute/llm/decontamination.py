"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Every window of ``window`` words of every benchmark text is a pattern, as its normalised words
between single blanks. The automaton holds all patterns at once, so a document is read once
whatever the number of test items, and overlapping windows are all found. Places in the normalised
text are word numbers; these lead back to places in the text as it was given.

The documents are only mapped: no shuffle, so a source, a passage or a copy that is everywhere
costs what its rows cost. Patterns are made, deduplicated and counted in Spark. Where they are
more than one automaton may hold, they are dealt over several by a hash, and the documents, with
what was found so far, pass them one after another through the shared folder.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, release_memory, text_bytes, worker_cache

#: A-Z become a-z; other ASCII characters than letters and digits separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    #: bytes of patterns and their item ids in one automaton; it takes some forty times as much memory
    automaton_bytes: int = 3_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """The normalised words of UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def _pattern(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def patterns(benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams(), columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """pattern, n (its words), items (ids of the test items that have it, without nulls), of all ``columns``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pattern, n, item = [], [], []
        for i, *cells in zip(batch.column(0).to_pylist(), *(text_bytes(c) for c in batch.columns[1:]), strict=True):
            for cell in cells:
                w = words_of(cell)
                made = {_pattern(w[k : k + p.window]) for k in range(max(1, len(w) - p.window + 1))} if w else ()
                pattern += made
                n += [min(len(w), p.window)] * len(made)
                item += [i] * len(made)
        return pa.RecordBatch.from_arrays([pa.array(pattern, pa.binary()), pa.array(n, pa.int32()), pa.array(item, pa.int64())], names=["pattern", "n", "item"])

    rows = map_batches(benchmark.select(F.col("item_id").cast("long"), *(F.col(c).cast("string") for c in columns)), "pattern binary, n int, item long", run)
    return rows.groupBy("pattern", "n").agg(F.collect_set("item").alias("items"))


_automaton: dict[str, ahocorasick.Automaton] = {}


def _clear() -> bool:
    held = bool(_automaton)
    _automaton.clear()
    return held


worker_cache("decontamination", _clear)


def _built(key: str, packed: bytes) -> ahocorasick.Automaton:
    """The automaton over packed (pattern, n, items) rows; each worker builds it once and keeps the last one."""
    if key not in _automaton:
        if _clear():
            release_memory()
        a = ahocorasick.Automaton()
        for pattern, n, items in pickle.loads(zstandard.ZstdDecompressor().decompress(packed)):
            a.add_word(pattern.decode("latin-1"), (n, items))
        a.make_automaton()
        _automaton[key] = a
    return _automaton[key]


def find(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The number of words, the places of all windows found (first word, word after the last) and their items."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    found, items = [], set()
    for end, (n, its) in automaton.iter(_pattern(words).decode("latin-1")):
        found.append((end, n))
        items.update(its)
    if not found:
        return len(words), [], items
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where the blank after each word stands
    last = np.searchsorted(ends, [e for e, _ in found])
    return len(words), [(int(w) + 1 - n, int(w) + 1) for w, (_, n) in zip(last, found, strict=True)], items


def stretches(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places that overlap or touch, as one each, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(places)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_original(text: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in words as places in the code points of the given text."""
    if not places:
        return []
    word = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    before = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))  # code points before each byte
    return [(int(before[edge[2 * a]]), int(before[edge[2 * b - 1]])) for a, b in places]


_HITS = "n_words long, n_hit long, items array<long>, spans array<struct<begin: long, end: long>>"
_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams(), columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, text, n_words, n_hit, items and spans of every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window of any benchmark text, ``items``
    has the ids of the items with such windows in ascending order, and ``spans`` the stretches of
    hit words in code points of the given text. An item with fewer words than a window is one
    window; one without words (or null) has none. An item with a null id hits words and is not
    listed; a repeated id is listed once. Null and empty texts have no words. Repeated rows are
    answered one by one; an empty table gives an empty result, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    table = cut(patterns(benchmark, p, columns))
    held = table.agg(F.sum(F.octet_length("pattern") + 8 * F.size("items"))).first()[0] or 0
    shards = max(1, -(-held // p.automaton_bytes))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for shard in range(shards):
        rows = table.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard).collect()  # automaton_bytes at most, about
        packed = zstandard.ZstdCompressor().compress(pickle.dumps([(bytes(r["pattern"]), r["n"], tuple(r["items"])) for r in rows]))
        sent, key = spark.sparkContext.broadcast(packed), uuid.uuid4().hex
        carried = shard > 0

        def run(batch: pa.RecordBatch, sent=sent, key=key, carried=carried) -> pa.RecordBatch:
            automaton = _built(key, sent.value)
            n_words, n_hit, all_items, spans = [], [], [], []
            before = zip(batch.column("items").to_pylist(), batch.column("places").to_pylist(), strict=True) if carried else [((), ())] * batch.num_rows
            places = []
            for text, (items, old) in zip(text_bytes(batch.column("text")), before, strict=True):
                n, more, new = find(text or b"", automaton)
                hit = stretches([*((x["begin"], x["end"]) for x in old), *more])
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in hit))
                all_items.append(sorted(new.union(items)))
                places.append([{"begin": a, "end": b} for a, b in hit])
                spans.append([{"begin": a, "end": b} for a, b in in_original(text or b"", hit)])
            arrays = [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(all_items, pa.list_(pa.int64())), pa.array(spans, _SPAN), pa.array(places, _SPAN)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_words", "n_hit", "items", "spans", "places"])

        found = map_batches(found, f"doc_id long, text string, {_HITS}, places array<struct<begin: long, end: long>>", run, keep="decontamination")
        if shard < shards - 1:
            found = cut(found)
    return found.drop("places")


def contamination_report(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; edge cases as in contamination()."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return contamination(docs, benchmark, p).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_passages(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id and text, with the stretches that occur in the benchmark cut out of the texts; null texts stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is not None and spans:
                ends = [0, *(s["end"] for s in spans)]
                text = "".join(text[a:b] for a, b in zip(ends, [*(s["begin"] for s in spans), len(text)], strict=True))
            out.append(text)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_batches(contamination(docs, benchmark, p).select("doc_id", "text", "spans"), "doc_id long, text string", run)
