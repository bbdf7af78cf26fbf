"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (ASCII letters lower-cased). A line of at least ``min_tokens``
distinct words (queries: one) is removed if an earlier line, by (doc_id, place in the text), has a Jaccard
similarity of ``threshold`` or more with it. The earlier line counts whether or not it is
removed itself, so the result does not depend on the order of work.

1. Texts are turned into compact blocks once: distinct words and, per distinct line, its
   words and a 128-bit hash of its set. Equal sets are settled by that hash alone: over the
   whole corpus only the first place of each set goes on.
2. Word counts over those lines (in a table sized by the corpus) order words by rarity.
3. Each line is listed under the rarest words of its prefix: two lines of the needed
   similarity share one of them. Lists travel as packed arrays.
4. In a list, ordered by set size, the length filter, the positional filter and a bound from
   128-bit parity maps rule pairs out. Each list names the best candidates of a line, and
   says if there were more.
5. The sets of a line and of its best candidate are compared exactly. Lines that this does
   not settle though they have more candidates go another round, with more of them named
   each time, until every line is settled or has no candidate left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bits, bits_of, cut, drop_caches, fresh_name, map_batches, number_rows, pack_arrays, release_memory, run_starts, ship_package, text_bytes, unpack_arrays


@dataclass(frozen=True)
class LineParams:
    threshold: float = 0.75
    min_tokens: int = 5
    #: the table of word counts has 2**rarity_bits entries at most
    rarity_bits: int = 24
    #: a line stops looking in a list once so many candidates are likely to be similar
    enough: int = 2
    likely: float = 0.85
    block_bytes: int = 1_200_000
    list_rows: int = 150_000
    #: candidates of a line that a part names at once; many times as many in each further round
    named: int = 8
    #: pairs that a part holds before it drops all but the best of each line
    held_pairs: int = 500_000
    #: words in more lines than this have their lists cut by set size
    heavy: int = 100_000


#: What the query and the pipeline run with: no line is too short.
EVERY_LINE = LineParams(min_tokens=1)

_NO_ID = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(n.dtype) + 1


# -- 1. blocks ------------------------------------------------------------------------

_SEGMENT = 1 << 18
_LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(3)


def _space(part: np.ndarray) -> np.ndarray:
    return (part == 32) | ((part >= 9) & (part <= 13))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


_POWERS = _powers(_SEGMENT + 1)


def words_in(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a text, ASCII letters lower-cased.

    Words of up to 64 bytes are hashed all at once, as differences of one running sum per
    segment; longer ones one by one.
    """
    buf = np.frombuffer(raw.lower(), np.uint8)
    all_starts, all_hashes = [], []
    at = 0
    while at < len(buf):
        end = min(len(buf), at + _SEGMENT)
        if end < len(buf) and not _space(buf[end - 1]):
            back = np.flatnonzero(_space(buf[at:end]))
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a segment
                while end < len(buf) and not _space(buf[end]):
                    end += 1
        part = buf[at:end]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = _space(part)
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        if len(start):
            power, inverse = _POWERS if len(part) <= _SEGMENT else _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], dtype=np.uint64, out=total[1:])
            size = (stop - start).astype(np.uint64)
            h = mix((total[stop] - total[start]) * inverse[start] + size, 9)
            for i in np.flatnonzero(size > _LONG_WORD).tolist():
                h[i] = xxhash.xxh3_64_intdigest(part[start[i] : stop[i]].tobytes())
            all_starts.append(start + at)
            all_hashes.append(h)
        at = end
    if not all_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(all_starts), np.concatenate(all_hashes)


def block_of(rows: list[int], doc_ids: list[int], column: list[bytes], first: list[int] | None = None) -> dict[str, np.ndarray]:
    """The lines of some texts: distinct lines with their words, and where each occurs.

    ``first`` has the number of each text's first line, if that is not 0.
    """
    raw = b"\n".join(column) + b"\n"
    at, h = words_in(raw)
    newline = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    per_line = np.diff(np.searchsorted(at, newline), prepend=0)
    text_ends = np.cumsum(np.array([len(b) + 1 for b in column], np.int64)) - 1
    lines_to = np.searchsorted(newline, text_ends) + 1
    begins = np.concatenate(([0], lines_to[:-1])) - np.array(first if first is not None else [0] * len(column), np.int64)
    full = np.flatnonzero(per_line)
    where = np.searchsorted(lines_to, full, side="right")
    number_ = full - begins[where]
    counts = per_line[full]
    hashes, tok = np.unique(h, return_inverse=True)
    line = np.repeat(np.arange(len(counts)), counts)
    key = np.sort(line * max(1, len(hashes)) + tok)
    key = key[run_starts(key)]
    line, tok = np.divmod(key, max(1, len(hashes)))
    starts = run_starts(line)
    sizes = np.diff(np.append(starts, len(line)))
    if len(starts):
        h1 = np.add.reduceat(mix(hashes, 1)[tok], starts)
        h2 = np.add.reduceat(mix(hashes, 2)[tok], starts)
    else:
        h1 = h2 = np.zeros(0, np.uint64)
    # distinct sets of this block, each at its first place by (doc_id, row, line)
    row_, doc_ = np.array(rows, np.int64)[where], np.array(doc_ids, np.int64)[where]
    order = np.lexsort((number_, row_, doc_, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    keep = order[new]
    # words of the distinct lines, in the order of `keep`
    size_f, start_f = sizes[keep], starts[keep]
    take = np.arange(size_f.sum()) + np.repeat(start_f - np.concatenate(([0], np.cumsum(size_f)[:-1])), size_f) if len(keep) else np.zeros(0, np.int64)
    words = tok[take]
    per_text = np.diff(lines_to, prepend=0)
    return {"hash": hashes, "times": np.bincount(words, minlength=len(hashes)).astype(np.uint32), "tok": words.astype(np.uint32), "size": size_f.astype(np.uint32), "h1": h1[keep], "h2": h2[keep], "row": row_[keep], "doc": doc_[keep], "line": number_[keep].astype(np.int32), "o_row": row_, "o_line": number_.astype(np.int32), "o_size": size_f.astype(np.uint32)[group], "t_row": np.array(rows, np.int64), "t_doc": np.array(doc_ids, np.int64), "t_lines": per_text.astype(np.int64)}


#: The columns of a block: a pass reads only those it needs.
_COLUMNS = {"words": ("hash", "times"), "sets": ("tok", "size", "row", "doc", "line"), "keys": ("h1", "h2", "size", "row", "doc", "line"), "places": ("o_row", "o_line", "o_size", "t_row", "t_doc", "t_none", "t_lines")}


def pieces_of(raw: bytes, most: int):
    """A text in pieces of whole lines, of about ``most`` bytes unless a line is longer: (number of the first line, piece)."""
    if len(raw) <= most:
        yield 0, raw
        return
    at = line = 0
    while at <= len(raw):
        end = raw.rfind(b"\n", at, at + most) if len(raw) - at > most else len(raw)
        if end < 0:
            end = raw.find(b"\n", at + most)
            end = len(raw) if end < 0 else end
        yield line, raw[at:end]
        line += raw.count(b"\n", at, end) + 1
        at = end + 1


def blocks(numbered: DataFrame, p: LineParams) -> DataFrame:
    """tokens and distinct lines of some texts, as packed arrays."""

    def made(rows: list[int], ids: list[int | None], column: list[bytes], first: list[int] | None = None) -> pa.RecordBatch:
        a = block_of(rows, [_NO_ID if x is None else x for x in ids], [b or b"" for b in column], first)
        a["t_lines"][[b is None for b in column]] = 0
        a["t_none"] = np.array([x is None for x in ids], np.uint8)
        packed = [pa.array([pack_arrays(**{k: a[k] for k in names})], pa.binary()) for names in _COLUMNS.values()]
        return pa.RecordBatch.from_arrays([pa.array([len(a["tok"])], pa.int64()), *packed], names=["tokens", *_COLUMNS])

    def run(batch: pa.RecordBatch):
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:  # about block_bytes of text at a time
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + p.block_bytes, side="right")))
            part = batch.slice(begin, end - begin)
            rows, ids, column = part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2))
            if len(rows) == 1 and column[0]:
                for first, piece in pieces_of(column[0], p.block_bytes):
                    yield made(rows, ids, [piece], [first])
            else:
                yield made(rows, ids, column)
            begin = end

    return cut(map_batches(numbered.select("row", "doc_id", "text"), "tokens long, " + ", ".join(f"{k} binary" for k in _COLUMNS), run))


def firsts(table: DataFrame, p: LineParams) -> DataFrame:
    """row, line of the first place of each distinct set in the corpus, by (doc_id, row, line)."""

    def run(batch: pa.RecordBatch):
        for raw in batch.column(0).to_pylist():
            a = unpack_arrays(raw)
            a = {k: v[a["size"] >= p.min_tokens] for k, v in a.items()}
            yield pa.RecordBatch.from_arrays([pa.array(a["h1"].view(np.int64)), pa.array(a["h2"].view(np.int64)), pa.array(a["doc"]), pa.array(a["row"]), pa.array(a["line"])], names=["h1", "h2", "doc", "row", "line"])

    places = map_batches(table.select("keys"), "h1 long, h2 long, doc long, row long, line int", run)
    return places.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "line")).alias("at")).select("at.row", "at.line")


# -- 2. rarity ------------------------------------------------------------------------


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 steps that keeps their order: 0, 1, and eight steps for each doubling."""
    return np.where(counts <= 1, counts, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def rarity(table: DataFrame, bits: int) -> np.ndarray:
    """Levels of the counts of word hashes over the distinct lines of all blocks: 2**bits numbers."""
    size, pieces = 1 << bits, 64
    shift = np.uint64(64 - bits)

    def summed(some: list[tuple[np.ndarray, np.ndarray]]):
        at, times = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(at)
        at, times = at[order], times[order]
        starts = run_starts(at)
        at, times = at[starts], np.add.reduceat(times, starts)
        bounds = np.searchsorted(at, np.arange(pieces + 1) * (size // pieces))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[i], bounds[i + 1])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack_arrays(i=(at[part] - i * (size // pieces)).astype(np.uint32), c=times[part])], pa.binary())], names=["piece", "counts"])

    def local(batches):
        drop_caches()
        some, held = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                a = unpack_arrays(raw)
                some.append(((a["hash"] >> shift).astype(np.int64), a["times"].astype(np.uint64)))
                held += len(a["hash"])
                if held >= 1_000_000:
                    yield from summed(some)
                    some, held = [], 0
        if held:
            yield from summed(some)
        del some
        release_memory()

    def merge(key, pdf):
        total = np.zeros(size // pieces, np.uint64)
        for raw in pdf["counts"]:
            a = unpack_arrays(raw)
            total[a["i"]] += a["c"]
        return pd.DataFrame({"piece": [key[0]], "counts": [pack_arrays(c=levels(total))]})

    schema = "piece int, counts binary"
    out = np.zeros(size, np.uint8)
    for r in table.select("words").mapInArrow(local, schema).groupBy("piece").applyInPandas(merge, schema).collect():
        out[r["piece"] * (size // pieces) : (r["piece"] + 1) * (size // pieces)] = unpack_arrays(bytes(r["counts"]))["c"]
    return out


def level_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    bits = len(counts).bit_length() - 1
    return counts[(hashes >> np.uint64(64 - bits)).astype(np.int64)]


# -- 3. lists -------------------------------------------------------------------------


def subset(a: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    """Some of a block's distinct lines, in the same order, with their words."""
    return {"hash": a["hash"], "tok": a["tok"][np.repeat(keep, a["size"])], **{k: a[k][keep] for k in ("size", "row", "doc", "line")}}


def postings_of(a: dict[str, np.ndarray], counts: np.ndarray, p: LineParams) -> dict[str, np.ndarray]:
    """The prefix words of a block's lines, rarest first."""
    # a set too small to be similar to any other but an equal one is settled by its hash alone
    a = subset(a, (a["size"] >= p.min_tokens) & (a["size"] * (1 - p.threshold) >= p.threshold - 1e-9))
    n = a["size"].astype(np.int64)
    level = level_of(a["hash"], counts)
    order = np.lexsort((a["hash"], level))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n_words = max(1, len(order))
    line = np.repeat(np.arange(len(n)), n)
    key = np.sort(line * n_words + rank[a["tok"]])
    word = order[key - line * n_words]
    starts = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64)
    bit = a["hash"] & np.uint64(127)
    one = np.left_shift(np.uint64(1), bit & np.uint64(63))
    maps = [np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0))[word], starts) if len(starts) else np.zeros(0, np.uint64) for half in (bit < 64, bit >= 64)]
    width = prefix_length(n, p.threshold)
    pos = np.arange(width.sum()) - np.repeat(np.concatenate(([0], np.cumsum(width)[:-1])), width) if len(n) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(n)), width)
    word = word[starts[line] + pos]
    # a word counted once in the whole corpus leads to no other line
    keep = level[word] > 1
    line, pos, word = line[keep], pos[keep], word[keep]
    return {"token": a["hash"][word], "level": level[word], "doc": a["doc"][line], "row": a["row"][line], "line": a["line"][line], "n": a["size"][line], "pos": pos.astype(np.uint32), "b0": maps[0][line], "b1": maps[1][line]}


def size_class(n: np.ndarray, t: float) -> np.ndarray:
    """Sets of the needed similarity are of one class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1 / min(t, 0.99)) + 1e-9).astype(np.int64)


def spread(a: dict[str, np.ndarray], p: LineParams) -> dict[str, np.ndarray]:
    """Lists of heavy words cut by size class: a line is in the list of its own class and,
    for the sake of larger ones only, in that of the next. ``guest`` marks the latter."""
    heavy = a.pop("level") > levels(np.array([p.heavy]))[0]
    guest = np.zeros(len(heavy), bool)
    if not heavy.any():
        return {**a, "guest": guest}
    at = np.flatnonzero(heavy)
    kind = size_class(a["n"][at], p.threshold).astype(np.uint64)
    a = {k: np.concatenate((v, v[at])) for k, v in a.items()}
    a["token"][at] = mix(a["token"][at] + kind + np.uint64(1), 11)
    later = np.arange(len(heavy), len(heavy) + len(at))
    a["token"][later] = mix(a["token"][later] + kind + np.uint64(2), 11)
    return {**a, "guest": np.concatenate((guest, np.ones(len(at), bool)))}


def lists(table: DataFrame, counts, first, parts: int, p: LineParams, only: Bits | None = None) -> DataFrame:
    """part, data: the prefix words of all ``first`` lines, dealt by word; of ``only`` some words if given."""

    def dealt(some: list[dict[str, np.ndarray]]):
        a = {k: np.concatenate([x[k] for x in some]) for k in some[0]}
        part = (mix(a["token"], 3) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = run_starts(part)
        a["token"] = (mix(a["token"], 4) & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # within a part; a clash adds candidates only
        for i, j in zip(starts.tolist(), np.append(starts, len(part))[1:].tolist(), strict=True):
            at = order[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([part[i]], pa.int32()), pa.array([pack_arrays(**{k: v[at] for k, v in a.items()})], pa.binary())], names=["part", "data"])

    def run(batches):
        drop_caches()
        some, held = [], 0
        for batch in batches:
            for words, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = unpack_arrays(words) | unpack_arrays(sets)
                keep = first.value.has(line_id(a["row"], a["line"]))
                if only is not None and len(keep):
                    hit = only.has(a["hash"])[a["tok"]]
                    keep &= np.bitwise_or.reduceat(hit, np.cumsum(a["size"].astype(np.int64)) - a["size"])
                a = postings_of(subset(a, keep), counts.value, p)
                if only is not None:
                    a = {k: v[only.has(a["token"])] for k, v in a.items()} if len(a["token"]) else a
                some.append(spread(a, p))
                held += len(some[-1]["token"])
                if held >= p.list_rows:
                    yield from dealt(some)
                    some, held = [], 0
        if held:
            yield from dealt(some)
        del some
        release_memory()

    ship_package(table.sparkSession)
    return table.select("words", "sets").mapInArrow(run, "part int, data binary")


# -- 4. candidates --------------------------------------------------------------------


_LOW32 = np.uint64(0xFFFFFFFF)


def in_list_order(a: dict[str, np.ndarray], t: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Lists one after the other, each by set size, with numbers that order places by (doc, row, line).

    Lines without another of a fitting size in their list are left out.
    """
    key = (a["token"].astype(np.uint64) << np.uint64(32)) | a["n"].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    size = (key & _LOW32).astype(np.float32)
    close = (key[1:] >> np.uint64(32) == key[:-1] >> np.uint64(32)) & (size[:-1] >= t * size[1:] - 1e-3)
    pad = np.zeros(1, bool)
    order = order[np.concatenate((close, pad)) | np.concatenate((pad, close))] if len(order) else order
    a = {k: v[order] for k, v in a.items()}
    doc, line = a["doc"], a["line"].astype(np.int64)
    if len(doc) and doc.min() >= 0 and doc.max() < 1 << 42 and line.max() < 1 << 20:
        place = (doc << 20) | line
        by = np.argsort(place)
        if not ((place[by][1:] == place[by][:-1]) & (a["row"][by][1:] != a["row"][by][:-1])).any():
            return a, place
    by = np.lexsort((a["line"], a["row"], doc))  # an id in several rows, or none
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (a["row"][by][1:] != a["row"][by][:-1]) | (line[by][1:] != line[by][:-1])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new)
    return a, place


class _Filters:
    """What rules out pairs of a list: positions, sizes and parity maps, in this order of cost."""

    def __init__(self, a: dict[str, np.ndarray], p: LineParams):
        self.n, self.left = a["n"].astype(np.float32), a["n"].astype(np.float32) - a["pos"].astype(np.float32)
        self.b0, self.b1, self.p = a["b0"], a["b1"], p

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pairs stay, their estimated similarity (in thousandths), and whether that is likely to be enough."""
        t = self.p.threshold
        total = self.n[i] + self.n[j]
        need = np.ceil(t / (1 + t) * total - 1e-3)
        ok = np.flatnonzero(np.minimum(self.left[i], self.left[j]) >= need)
        i, j, total, need = i[ok], j[ok], total[ok], need[ok]
        differ = np.bitwise_count(self.b0[i] ^ self.b0[j]) + np.bitwise_count(self.b1[i] ^ self.b1[j])
        good = total - differ >= 2 * need
        ok, total, differ = ok[good], total[good], differ[good]
        # the maps' difference, corrected for clashes, estimates that of the sets
        apart = -64 * np.log1p(np.minimum(differ.astype(np.float32), 60) / -64)
        share = (total - apart) / (total + apart)
        # the more words, the less 128 bits tell
        bar = np.where(total <= 200, self.p.likely, np.where(total <= 1000, 0.95, 2.0))
        return ok, (1000 * np.maximum(share, 0)).astype(np.int32), share >= bar


class _Best:
    """The best candidates of each line of one part, and which lines had more than ``named`` different ones.

    Pairs beyond ``named`` of a line go whenever many are held: one that is not among the best of
    those seen so far is not among the best of all. So memory follows the lines, not their pairs.
    """

    def __init__(self, who: np.ndarray, named: int | None, held: int):
        self.who, self.named, self.held = who, named, held
        self.parts, self.n, self.limit = [], 0, held
        self.more = np.zeros(int(who.max()) + 1 if len(who) else 0, bool)

    def add(self, later: np.ndarray, earlier: np.ndarray, share: np.ndarray) -> None:
        if not len(later):
            return
        self.parts.append((later.astype(np.int32), earlier.astype(np.int32), share.astype(np.int16)))
        self.n += len(later)
        if self.named is not None and self.n > self.limit:
            self._thin()
            self.limit = max(self.held, 2 * self.n)

    def _thin(self) -> None:
        y, x, share = self.all()
        by_y, by_x = self.who[y], self.who[x]
        order = np.lexsort((by_x, -share, by_y))
        new = np.ones(len(order), bool)  # a pair of two lists has the same share in both
        new[1:] = (by_y[order][1:] != by_y[order][:-1]) | (by_x[order][1:] != by_x[order][:-1])
        order = order[new]
        starts = run_starts(by_y[order])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        self.more[by_y[order[rank >= self.named]]] = True
        order = order[rank < self.named]
        self.parts, self.n = [(y[order], x[order], share[order])], len(order)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, self.parts = self.parts, []
        self.parts = [tuple(np.concatenate(o) for o in zip(*parts, strict=True))] if parts else [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16))]
        return self.parts[0]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """later, earlier, share, by line and from the best candidate on."""
        self._thin()
        return self.parts[0]


def candidates_in(a: dict[str, np.ndarray], p: LineParams, enough: int | None, wanted: Bits | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Pairs (later, earlier) of one part that no filter rules out, and which later lines stopped early."""
    y, x, _, stopped, a = scored_candidates(a, p, enough, wanted)
    return y, x, np.flatnonzero(stopped), a


def scored_candidates(a: dict[str, np.ndarray], p: LineParams, enough: int | None, wanted: Bits | None, named: int | None = None):
    """later, earlier, estimated similarity of the pairs of one part, or of the ``named`` best of each line; the places of lines that have more (without ``named``, that stopped early); the lists."""
    a, place = in_list_order({"guest": np.zeros(len(a["token"]), bool), **a}, p.threshold)
    m = len(a["token"])
    n, guest = a["n"].astype(np.float32), a["guest"]
    starts = run_starts(a["token"])
    sizes = np.diff(np.append(starts, m))
    end = np.repeat(starts + sizes, sizes)
    begin = np.repeat(starts, sizes)
    found = np.zeros(m, np.int32)
    done = np.zeros(m, bool) if wanted is None else ~wanted.has(line_id(a["row"], a["line"]))
    stopped = np.zeros(m, bool)
    accept = _Filters(a, p)
    by = np.lexsort((a["line"], a["row"]))
    who = np.empty(m, np.int32)  # a number of each line, by (row, line)
    who[by] = np.cumsum(np.concatenate(([False], place[by][1:] != place[by][:-1]))) if m else who
    out = _Best(who, named, p.held_pairs)

    def look(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs i, j of one list, the smaller set first."""
        nonlocal done
        later, earlier = np.where(place[i] > place[j], i, j), np.where(place[i] > place[j], j, i)
        # a guest meets the larger class only, and there is but one line at a place
        use = np.flatnonzero(~(done[later] | guest[j]) & (place[i] != place[j]))
        later, earlier = later[use], earlier[use]
        ok, share, likely = accept(later, earlier)
        out.add(later[ok], earlier[ok], share)
        if enough is not None and likely.any():
            np.add.at(found, later[ok][likely], 1)
            stopped[found >= enough] = True
            done = done | stopped

    i = np.arange(m)
    d = 0
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        i = i[n[i] >= p.threshold * n[i + d] - 1e-3]
        if not len(i):
            break
        if d % 64 == 0:
            open_ = ~done
            inside = np.unique(begin[i])
            some = np.add.reduceat(open_, starts)[np.searchsorted(starts, inside)]
            width = sizes[np.searchsorted(starts, inside)]
            # where few lines of a long list still look, go by line instead of by distance
            for lo, hi in ((int(s), int(s + w)) for s, w, k in zip(inside, width, some, strict=True) if k * 8 < w):
                for y in (lo + np.flatnonzero(open_[lo:hi])).tolist():
                    x = np.arange(lo, hi)
                    x = x[(place[x] < place[y]) & (np.minimum(n[x], n[y]) >= p.threshold * np.maximum(n[x], n[y]) - 1e-3)]
                    x = x[np.abs(x - y) >= d]
                    if len(x):
                        look(np.minimum(x, y), np.maximum(x, y))
                i = i[begin[i] != lo]
            if not len(i):
                break
        look(i, i + d)
    if named is None:
        return *out.all(), stopped, a
    y, x, share = out.best()
    out.more[who[stopped]] = True
    return y, x, share, out.more[who], a


def line_id(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A 64-bit key of a place, for Bits only."""
    return mix(row.astype(np.uint64), 5) ^ mix(line.astype(np.uint64), 6)


_PAIRS = "y_row long, y_line int, x_row long, x_line int, share int, more boolean"


def candidate_pairs(posted: DataFrame, p: LineParams, named: int, enough: int | None, wanted: Bits | None = None) -> DataFrame:
    """For each line and part the ``named`` best candidates, and whether the part has more of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drop_caches()
        some = [unpack_arrays(raw) for raw in pdf["data"]]
        y, x, share, more, a = scored_candidates({k: np.concatenate([s.pop(k) for s in some]) for k in tuple(some[0])}, p, enough, wanted, named)
        f = pd.DataFrame({**{f"{side}_{k}": a[k][at] for side, at in (("y", y), ("x", x)) for k in ("row", "line")}, "share": share.astype(np.int32), "more": more[y]})
        release_memory()
        return f

    return posted.groupBy("part").applyInPandas(run, _PAIRS)


# -- 5. verification ------------------------------------------------------------------


def line_sets(table: DataFrame, wanted) -> DataFrame:
    """row, line, words (64-bit hashes) of the distinct lines that ``wanted`` may hold."""

    def run(batch: pa.RecordBatch):
        for words, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a = unpack_arrays(packed)
            hit = np.flatnonzero(wanted.value.has(line_id(a["row"], a["line"])))
            if not len(hit):
                continue
            n = a["size"][hit].astype(np.int64)
            begin = np.cumsum(a["size"].astype(np.int64))[hit] - n
            ends = np.cumsum(n)
            raw = unpack_arrays(words, ("hash",))["hash"][a["tok"][np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]].tobytes()
            sets = [raw[8 * i : 8 * j] for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            for lo in range(0, len(hit), 5000):
                at = hit[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(a["row"][at]), pa.array(a["line"][at]), pa.array(sets[lo : lo + 5000], pa.binary())], names=["row", "line", "words"])

    return map_batches(table.select("words", "sets"), "row long, line int, words binary", run)


def similar(x: bytes, y: bytes, t: float) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= t * (len(a) + len(b) - common) - 1e-9


def verified(pairs: DataFrame, table: DataFrame, p: LineParams) -> tuple[DataFrame, DataFrame]:
    """y_row, y_line of the lines that one of their candidates matches; and the sets of all lines compared."""
    spark = pairs.sparkSession
    ends = pairs.select(F.explode(F.array(F.struct(F.col("y_row").alias("r"), F.col("y_line").alias("l")), F.struct(F.col("x_row").alias("r"), F.col("x_line").alias("l")))).alias("e")).select("e.r", "e.l").distinct()

    wanted = spark.sparkContext.broadcast(bits_of(ends, ["r", "l"], line_id))
    sets = cut(line_sets(table, wanted))
    x = sets.select(F.col("row").alias("x_row"), F.col("line").alias("x_line"), F.col("words").alias("x_words"))
    y = sets.select(F.col("row").alias("y_row"), F.col("line").alias("y_line"), F.col("words").alias("y_words"))
    both = pairs.join(x, ["x_row", "x_line"]).join(y, ["y_row", "y_line"]).select("y_row", "y_line", "x_words", "y_words")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [similar(a, b, p.threshold) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["y_row", "y_line"]).filter(pa.array(hit, pa.bool_()))

    return map_batches(both, "y_row long, y_line int", check).distinct(), sets


def prefix_words(sets: DataFrame, counts, p: LineParams) -> DataFrame:
    """key: the prefix words of some lines, of (row, line, words)."""

    def run(batch: pa.RecordBatch):
        for raw in batch.column(0).to_pylist():
            h = np.frombuffer(raw, np.uint64)
            h = h[np.lexsort((h, level_of(h, counts.value)))][: int(prefix_length(np.array([len(h)]), p.threshold)[0])]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    return map_batches(sets.select("words"), "key long", run)


# -- whole ----------------------------------------------------------------------------


def removed_lines(numbered: DataFrame, p: LineParams = LineParams(), table: DataFrame | None = None) -> DataFrame:
    """row, line (numbers from 0) of the lines to be removed.

    ``numbered`` has row (a distinct number for each row), doc_id and text; ``table`` its
    blocks, if they are made already. Null texts have no lines; lines without words, or with
    fewer distinct words than min_tokens, are never removed and match nothing; rows that
    repeat an id are documents of their own, in the order of (doc_id, row); null ids come last.
    """
    spark = numbered.sparkSession
    ship_package(spark)
    table = blocks(numbered, p) if table is None else table
    total = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    parts = int(min(1 << 20, max(64, total * 0.3 // p.list_rows)))
    bits = int(min(p.rarity_bits, max(12, np.ceil(np.log2(max(total, 1))) - 2)))
    y, pair = ["y_row", "y_line"], ["y_row", "y_line", "x_row", "x_line"]
    unique = cut(firsts(table, p))
    counts, first = spark.sparkContext.broadcast(rarity(table, bits)), spark.sparkContext.broadcast(bits_of(unique, ["row", "line"], line_id))
    found = cut(candidate_pairs(lists(table, counts, first, parts, p), p, p.named, p.enough))
    # the best candidate settles most lines
    best = cut(found.groupBy(*y).agg(F.max(F.struct("share", F.negate("x_row").alias("r"), F.negate("x_line").alias("l"))).alias("b")).select(*y, F.negate("b.r").alias("x_row"), F.negate("b.l").cast("int").alias("x_line")))
    near = cut(verified(best, table, p)[0])
    rest = cut(found.join(near, y, "left_anti"))
    named = p.named
    while not rest.isEmpty():
        more, sets = verified(rest.select(*pair).distinct(), table, p)
        near = cut(near.union(more))
        again = cut(rest.filter("more").select(*y).distinct().join(near, y, "left_anti"))
        if again.isEmpty():
            break
        # few lines as a rule: only the lists of their words are built again
        at = again.select(F.col("y_row").alias("row"), F.col("y_line").alias("line"))
        wanted = bits_of(again, y, line_id)
        only = bits_of(prefix_words(sets.join(at, ["row", "line"], "left_semi"), counts, p), ["key"])
        named *= 64
        rest = cut(candidate_pairs(lists(table, counts, first, parts, p, only), p, named, None, wanted).join(again, y, "left_semi"))
    # of equal sets only the first place stays, unless an earlier line is similar to it
    keepers = unique.join(near.select(F.col("y_row").alias("row"), F.col("y_line").alias("line")), ["row", "line"], "left_anti")
    return long_lines(table, p).join(keepers, ["row", "line"], "left_anti")


def long_lines(table: DataFrame, p: LineParams) -> DataFrame:
    """row, line of every line with at least min_tokens distinct words."""

    def run(batch: pa.RecordBatch):
        for raw in batch.column(0).to_pylist():
            a = unpack_arrays(raw)
            at = np.flatnonzero(a["o_size"] >= p.min_tokens)
            yield pa.RecordBatch.from_arrays([pa.array(a["o_row"][at]), pa.array(a["o_line"][at])], names=["row", "line"])

    return map_batches(table.select("places"), "row long, line int", run)


def line_counts(table: DataFrame) -> DataFrame:
    """row, doc_id, lines: the number of lines of each text (null: 0), or of each piece of a long one."""

    def run(batch: pa.RecordBatch):
        for raw in batch.column(0).to_pylist():
            a = unpack_arrays(raw, ("t_row", "t_doc", "t_none", "t_lines"))
            yield pa.RecordBatch.from_arrays([pa.array(a["t_row"]), pa.array(a["t_doc"], mask=a["t_none"] > 0), pa.array(a["t_lines"])], names=["row", "doc_id", "lines"])

    return map_batches(table.select("places"), "row long, doc_id long, lines long", run)


def _number(docs: DataFrame) -> tuple[DataFrame, str]:
    """A number for each row, the same in every run over the same parts, and its column's name."""
    name = fresh_name(docs, "line_row")
    return number_rows(docs, name), name


def line_report(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, ascending) of every row of ``docs``; see removed_lines()."""
    rows, name = _number(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumnRenamed(name, "row")
    table = blocks(rows, p)
    counts = line_counts(table).select("row", "doc_id", "lines", F.lit(None).cast("int").alias("line"))
    gone = removed_lines(rows, p, table).select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("lines"), "line")
    whole = counts.union(gone).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("lines").cast("int").alias("n_lines"), F.array_sort(F.collect_list("line")).alias("removed"))
    return whole.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def drop_repeated_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``docs`` with the repeated lines cut out of text, and n_chars, if there, counted anew.

    Documents that lose every line keep their row with an empty text; null and empty texts and
    null ids stay as they are. Other columns may have any name. Cutting is linear in the lines.
    """
    rows, row = _number(docs)
    lost = fresh_name(rows, "line_gone")
    gone = removed_lines(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), p).groupBy("row").agg(F.collect_list("line").alias(lost)).withColumnRenamed("row", row)
    joined = rows.join(gone, row, "left")

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost).cast("array<int>"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # an array of one, so that the text is split once
    left = F.get(F.transform(F.array(F.split("text", "\n", -1)), kept), 0)
    out = joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
