"""Hard-negative mining: vantage-point trees over norm-augmented vectors, score windows as distance annuli.

With M the greatest length, a vector v becomes the point (v, sqrt(M^2 - |v|^2)) and an anchor q the
point (q, 0), so that their squared distance is |q|^2 + M^2 - 2 q.v: higher scores are nearer points,
and the rows whose score lies in a window are the points of an annulus around the anchor.

A vantage-point tree of a bounded sample deals all vectors into cells; each cell has, in its task,
a tree of its own. Anchors visit only cells that may meet one of their annuli, and there take the
leaves nearest first, starting at the annulus's inner edge, until the k-th row found is
nearer than any leaf left. Distances only order and prune; scores are compared as integers.

Two searches run this way: the positives (same label, no window) and the negatives (another label,
a window for each positive). Each goes through the vectors in parts that grow by ``growth``, dealt
by a hash: what a part finds is the floor for the next, so a later part names few rows however
many cells there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, pack_arrays, ship_package, unpack_arrays
from .topk import LEAST, MOST, Best, exact_products, matrix


@dataclass(frozen=True)
class NegativeParams:
    scale: int = 256
    anchor_modulus: int = 100
    noise_modulus: int = 7  # rows whose id it divides get the next label
    labels: int = 10
    positives: int = 5
    negatives: int = 10
    #: a negative's score lies between these shares (in tenths) of the positive's
    low_tenths: int = 3
    high_tenths: int = 9
    sample: int = 4096
    cells: int = 128
    cell_rows: int = 8192
    leaf_rows: int = 256
    anchors: int = 16_384
    growth: int = 8


_SHORT = 1  # vectors of 16-bit integers, else of doubles


def encode(v: np.ndarray) -> bytes:
    """A vector of whole numbers as bytes: two each where they are small."""
    small = not v.size or np.abs(v).max() < 2**15
    return bytes([_SHORT if small else 0]) + v.astype("<i2" if small else "<f8").tobytes()


def decode(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Encoded vectors as rows of doubles; shorter ones are filled up with zeros."""
    return matrix([np.frombuffer(r, "<i2" if r[0] == _SHORT else "<f8", offset=1).astype("<f8").tobytes() for r in rows], width)


def scaled_rows(embeddings: DataFrame, p: NegativeParams) -> DataFrame:
    """vec_id, label (with the noise), v, norm2, width, deal of the rows that take part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, x, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i is None or label is None or x is None or any(c is None for c in x):
                continue
            v = np.asarray(x, np.float64)
            if not np.isfinite(v).all():
                continue
            with np.errstate(over="ignore"):
                v = np.nan_to_num(np.floor(p.scale * v))
                out.append((i, (label + 1) % p.labels if i % p.noise_modulus == 0 else label, encode(v), float(v @ v), len(v)))
        columns = zip(*out, strict=True) if out else [()] * 5
        types = pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["vec_id", "label", "v", "norm2", "width"])

    rows = map_batches(embeddings.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")), "vec_id long, label long, v binary, norm2 double, width int", run)
    return rows.withColumn("deal", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / (1 << 30))


# -- trees ------------------------------------------------------------------------------


def augmented(v: np.ndarray, most2: float) -> np.ndarray:
    """Points of one length: each vector and what it lacks of the greatest length."""
    return np.column_stack([v, np.sqrt(np.maximum(0, most2 - (v**2).sum(axis=1)))])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - t) ** 2).sum(axis=1)) for t in to], axis=1) if len(to) else np.zeros((len(points), 0))


def anchor_distances(q: np.ndarray, points: np.ndarray, most2: float) -> np.ndarray:
    """Distances from anchors, whose own last coordinate is 0, to augmented points."""
    return np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + most2 - 2 * (q @ points[:, :-1].T)))


def most_or_none(most2: float) -> float | None:
    """The greatest squared length, unless sums of such squares leave the range of doubles."""
    return most2 if most2 < 1e280 else None


@dataclass
class Tree:
    """Leaves of a vantage-point tree: their members, and on each leaf's way (vantage point, least, greatest distance)."""

    vantage: np.ndarray
    members: list[np.ndarray]
    ways: list[list[tuple[int, float, float]]]

    @classmethod
    def of(cls, v: np.ndarray, most2: float, leaf_rows: int) -> Tree:
        if most_or_none(most2) is None:  # no distances: leaves in order of the rows
            members = np.split(np.arange(len(v)), range(leaf_rows, len(v), leaf_rows))
            return cls(np.zeros((0, v.shape[1] + 1)), members, [[] for _ in members])
        points = augmented(v, most2)
        tree = cls(points[:0], [], [])
        chosen: list[np.ndarray] = []
        todo: list[tuple[np.ndarray, list]] = [(np.arange(len(points)), [])]
        while todo:
            rows, way = todo.pop()
            if len(rows) > leaf_rows:
                at = rows[np.argmax(distances(points[rows], points[rows[:1]])[:, 0])]  # far out, so its distances spread
                d = distances(points[rows], points[at : at + 1])[:, 0]
                near = d <= np.median(d)
                if not near.all():
                    chosen.append(points[at])
                    todo += [(rows[side], [*way, (len(chosen) - 1, float(d[side].min()), float(d[side].max()))]) for side in (~near, near)]
                    continue
            tree.members.append(rows)  # few rows, or rows that no distance tells apart
            tree.ways.append(way)
        tree.vantage = np.array(chosen) if chosen else tree.vantage
        return tree

    def leaf_of(self, d: np.ndarray) -> np.ndarray:
        """The leaf for each row of distances to the vantage points; between two sides, the nearer one."""
        miss = np.zeros((len(d), len(self.ways)))
        for leaf, way in enumerate(self.ways):
            for q, least, most in way:
                miss[:, leaf] = np.maximum(miss[:, leaf], np.maximum(least - d[:, q], d[:, q] - most))
        return np.argmin(miss, axis=1)

    def score_range(self, q: np.ndarray, most2: float) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least score of each anchor (rows) in each leaf (columns), with slack for rounding."""
        near, far = np.zeros((len(q), len(self.ways))), np.full((len(q), len(self.ways)), np.inf)
        if most_or_none(most2) is None:
            return far, -far
        d = anchor_distances(q, self.vantage, most2)
        for leaf, way in enumerate(self.ways):
            for at, least, most in way:
                near[:, leaf] = np.maximum(near[:, leaf], np.maximum(least - d[:, at], d[:, at] - most))
                far[:, leaf] = np.minimum(far[:, leaf], d[:, at] + most)
        whole = (q**2).sum(axis=1)[:, None] + most2
        slack = 1e-6 * (1 + whole)
        return (whole - near**2) / 2 + slack, (whole - far**2) / 2 - slack


# -- one cell ---------------------------------------------------------------------------


@dataclass
class Anchors:
    """Anchors (rows) and their windows (columns): score limits, both included, and floors."""

    key: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray

    def pack(self) -> bytes:
        return pack_arrays(**{k: x.reshape(-1) for k, x in vars(self).items()})

    @classmethod
    def unpack(cls, raw: bytes) -> Anchors:
        a = unpack_arrays(raw)
        n = len(a["key"])
        return cls(**{k: x.reshape(n, -1) if k in ("v", "low", "high", "floor") else x for k, x in a.items()})

    def some(self, rows: np.ndarray) -> Anchors:
        return Anchors(**{k: x[rows] for k, x in vars(self).items()})

    def meets(self, top: np.ndarray, bottom: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which anchors have a window, as far out as it is still open, that scores from ``bottom`` to ``top`` reach."""
        return ((top[:, None] >= np.maximum(self.low.astype(float), floor)) & (bottom[:, None] <= self.high.astype(float)) & (self.low <= self.high)).any(axis=1)

    def fitting(self, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, floor: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, window and candidate of all that windows may take."""
        ok = ((labels[None, :] == self.label[:, None]) == same) & (ids[None, :] != self.vec_id[:, None])
        least = np.maximum(self.low, floor)
        ok &= (score >= least.min(axis=1)[:, None]) & (score <= self.high.max(axis=1)[:, None])
        at, c = np.nonzero(ok)
        s = score[at, c][:, None]
        pair, win = np.nonzero((s >= least[at]) & (s <= self.high[at]))
        return at[pair], win, c[pair]


class Cell:
    """The rows of one cell with their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most2: float, leaf_rows: int):
        self.ids, self.labels, self.v, self.most2 = ids, labels, v, most2
        self.tree = Tree.of(v, most2, leaf_rows)

    def search(self, a: Anchors, k: int, same: bool) -> Best:
        """The k best candidates of each window (numbered anchor by anchor), none below its floor."""
        w = a.low.shape[1]
        best = Best(len(a.key) * w, k, a.floor.reshape(-1))
        top, bottom = self.tree.score_range(a.v, self.most2)
        # nearest first: from the inner edge of an anchor's outermost start on
        order = np.argsort(-np.minimum(top, a.high.max(axis=1).astype(float)[:, None]), axis=1, kind="stable")
        done, step = 0, 1
        while done < order.shape[1]:
            now = order[:, done : done + step]
            for leaf in np.unique(now):
                rows = np.flatnonzero((now == leaf).any(axis=1))
                rows = rows[a.some(rows).meets(top[rows, leaf], bottom[rows, leaf], best.bar().reshape(-1, w)[rows])]
                if len(rows):
                    part = self.tree.members[leaf]
                    score = exact_products(a.v[rows], self.v[part])
                    at, win, c = a.some(rows).fitting(score, self.ids[part], self.labels[part], best.floor.reshape(-1, w)[rows], same)
                    best.add(rows[at] * w + win, self.ids[part[c]], score[at, c])
            done += step
            step *= 2
        return best


# -- all cells --------------------------------------------------------------------------


@dataclass
class Space:
    """What tasks know of all rows: their number, the greatest squared length, the longest vector's size, the cells and a sample."""

    n: int
    most2: float
    width: int
    tree: Tree
    pieces: dict[int, int]
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]


def space(rows: DataFrame, p: NegativeParams) -> tuple[DataFrame, Space]:
    """The rows with their cells, and these. Cells come from a sample of at most ``p.sample`` rows; a cell of more than ``cell_rows`` rows is dealt in pieces by a hash."""
    n, most2, width = rows.agg(F.count("*"), F.coalesce(F.max("norm2"), F.lit(0.0)), F.coalesce(F.max("width"), F.lit(0))).first()
    width = max(1, width)
    drawn = rows.filter(F.col("deal") < F.lit(p.sample / max(1, n))).limit(p.sample).collect()
    sample = np.array([r["vec_id"] for r in drawn], np.int64), np.array([r["label"] for r in drawn], np.int64), decode([bytes(r["v"]) for r in drawn] or [encode(np.zeros(width))], width)[: len(drawn)]
    cells = max(1, min(p.cells, n // p.cell_rows, len(drawn) // 8))
    tree = Tree.of(sample[2], most2, max(1, -(-len(drawn) // cells)))
    if most_or_none(most2) is None:
        tree = Tree(tree.vantage, [np.arange(len(drawn))], [[]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, dist = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows
        if len(tree.vantage):
            d = distances(augmented(decode(batch.column("v").to_pylist(), width), most2), tree.vantage)
            cell = tree.leaf_of(d)
            dist = [[float(d[i, q]) for q, _, _ in tree.ways[c]] for i, c in enumerate(cell)]
        names = ["vec_id", "label", "v", "deal"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cell), pa.array(dist, pa.list_(pa.float64()))], names=[*names, "cell", "dist"])

    dealt = cut(map_batches(rows.select("vec_id", "label", "v", "deal"), "vec_id long, label long, v binary, deal double, cell long, dist array<double>", run))
    deep = max(map(len, tree.ways), default=0)
    edges = [f(F.get("dist", F.lit(i))).alias(f"{name}{i}") for i in range(deep) for name, f in (("low", F.min), ("high", F.max))]
    found = dealt.groupBy("cell").agg(F.count("*").alias("n"), *edges).collect()  # a row a cell
    for r in found:
        tree.ways[r["cell"]] = [(q, r[f"low{i}"], r[f"high{i}"]) for i, (q, _, _) in enumerate(tree.ways[r["cell"]])]
    return dealt.drop("dist"), Space(n, most2, width, tree, {r["cell"]: -(-r["n"] // p.cell_rows) for r in found}, sample)


def _floors(a: Anchors, sample: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, same: bool) -> np.ndarray:
    """Scores that the k-th best row of each window reaches, as far as the sample shows."""
    ids, labels, v = sample
    floor = a.floor.copy()
    for lo in range(0, len(a.key), 256):
        part = a.some(np.arange(lo, min(lo + 256, len(a.key))))
        score = exact_products(part.v, v)
        at, win, c = part.fitting(score, ids, labels, part.floor, same)
        best = Best(part.low.size, k, part.floor.reshape(-1))
        best.add(at * part.low.shape[1] + win, ids[c], score[at, c])
        floor[lo : lo + 256] = best.floor.reshape(part.low.shape)
    return floor


def search(table: DataFrame, s: Space, asked: DataFrame, k: int, same: bool, p: NegativeParams) -> DataFrame:
    """key, win, vec_id, score: the k best rows of each window of ``asked`` (key, vec_id, label, v, low, high).

    ``asked`` is a written table; its anchors are the stated query set, and meet the cells in blocks.
    """
    anchors = asked.count()
    parts = max(1, -(-anchors // p.anchors))
    shares = []
    while (share := max(1, len(s.sample[0])) * p.growth ** (len(shares) + 1) / max(1, s.n)) < 1:
        shares.append(share)
    known = None
    begin = 0.0
    windows = "key long, win int, vec_id long, score long"
    piece_of = F.create_map(*(F.lit(x) for c, n in s.pieces.items() for x in (c, n))) if s.pieces else None
    for share in [*shares, 1.0]:
        with_floor = asked.withColumn("floor", F.lit(None).cast("map<int,long>"))
        if known is not None:
            full = known.groupBy("key", "win").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
            floors = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("win", "least"))).alias("floor"))
            with_floor = cut(asked.join(floors, "key", "left"))  # written: visits are dealt by their place in batches

        def visit(batch: pa.RecordBatch, first=known is None):
            low, high = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("low", "high"))
            floor = np.full(low.shape, LEAST)
            for i, m in enumerate(batch.column("floor").to_pylist()):
                for win, least in m or ():
                    floor[i, win] = least
            key, vec_id, label = (batch.column(c).to_numpy() for c in ("key", "vec_id", "label"))
            a = Anchors(key, vec_id, label, decode(batch.column("v").to_pylist(), s.width), low, high, floor)
            if first and len(s.sample[0]):
                a.floor = _floors(a, s.sample, k, same)
            top, bottom = s.tree.score_range(a.v, s.most2)
            bar = Best(a.floor.size, k, a.floor.reshape(-1)).bar().reshape(a.floor.shape)
            part = key // 2000 % parts
            for cell, pieces in s.pieces.items():
                able = a.meets(top[:, cell], bottom[:, cell], bar)
                for n in np.unique(part[able]):
                    packed = a.some(np.flatnonzero(able & (part == n))).pack()
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell] * pieces), "piece": pa.array(range(pieces), pa.int32()), "part": pa.array([n] * pieces, pa.int64()), "anchors": pa.array([packed] * pieces, pa.binary())})

        def meet(rows: pa.Table, visits: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if rows.num_rows and visits.num_rows:
                cell = Cell(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), decode(rows["v"].to_pylist(), s.width), s.most2, p.leaf_rows)
                for raw in visits["anchors"].to_pylist():
                    a = Anchors.unpack(raw)
                    best = cell.search(a, k, same)
                    out.append((a.key[best.q // a.low.shape[1]], (best.q % a.low.shape[1]).astype(np.int32), best.id, best.score))
            empty = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            return pa.table(dict(zip(("key", "win", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)) if out else empty, strict=True)))

        visits = map_batches(with_floor, "cell long, piece int, part long, anchors binary", visit)
        rows = table.filter((F.col("deal") >= begin) & ((F.col("deal") < share) | F.lit(share >= 1)))
        if piece_of is not None:
            rows = rows.withColumn("piece", F.pmod(F.xxhash64("deal", "vec_id"), piece_of[F.col("cell")]).cast("int"))
        else:
            rows = rows.withColumn("piece", F.lit(0))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).selectExpr("cell", "piece", "cast(part as long) part", "vec_id", "label", "v")
        found = rows.groupBy("cell", "piece", "part").cogroup(visits.groupBy("cell", "piece", "part")).applyInArrow(meet, windows)
        best = Window.partitionBy("key", "win").orderBy(F.desc("score"), "vec_id")
        found = found if known is None else found.union(known)
        known = cut(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n"))
        begin = share
    return known


def hard_negatives(embeddings: DataFrame, p: NegativeParams = NegativeParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.
    Anchors are rows whose id ``anchor_modulus`` divides; rows that repeat id, label and vector are
    one anchor, and count one by one as candidates, though positives of one id and score are one.
    A row of the anchor's own id is no candidate. Vectors of different lengths are compared as if
    zeros filled up the shorter. Scores beyond a long's range are given as the nearest long. Ties go
    to the smaller id. A window without rows gives none; an empty table gives an empty result.
    """
    ship_package(embeddings.sparkSession)
    rows = cut(scaled_rows(embeddings, p))
    table, s = space(rows, p)
    chosen = rows.filter(F.col("vec_id") % p.anchor_modulus == 0).select("vec_id", "label", "v").distinct()
    anchors = cut(cut(chosen).withColumn("key", F.monotonically_increasing_id()))  # numbered in a written table, and written
    limits = {"low": LEAST, "high": MOST}
    asked = cut(anchors.select("key", "vec_id", "label", "v", *(F.array(F.lit(x)).alias(c) for c, x in limits.items())))
    positives = search(table, s, asked, p.positives, True, p)
    found = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), lambda x: F.struct((-x["s"]).alias("score"), x["vec_id"].alias("positive_id"))))
    windows = cut(positives.groupBy("key").agg(found.alias("found")))

    # so many tenths of a score, without leaving the range of longs
    tenths = "transform(found, x -> (x.score - pmod(x.score, 10)) div 10 * {n} + cast({f}(pmod(x.score, 10) * {n} / 10) as long))"
    # as many windows for every anchor: those it has no positive for are empty
    pad = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(p.positives - 1)), lambda i: F.coalesce(F.get(c, i), F.lit(x)))
    low, high = F.expr(tenths.format(n=p.low_tenths, f="ceil")), F.expr(tenths.format(n=p.high_tenths, f="floor"))
    asked = cut(anchors.join(windows, "key").select("key", "vec_id", "label", "v", pad(low, MOST).alias("low"), pad(high, LEAST).alias("high")))
    negatives = search(table, s, asked, p.negatives, False, p)
    pairs = windows.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key").select("key", "anchor_id", F.posexplode("found").alias("win", "x"))
    rank = F.row_number().over(Window.partitionBy("key", "win").orderBy(F.desc("negative_score"), "negative_id"))
    named = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return named.join(pairs, ["key", "win"]).select("anchor_id", F.col("x.positive_id"), rank.alias("rank"), "negative_id", F.col("x.score").alias("positive_score"), "negative_score")
