"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a signature of
   ``trees * depth`` MinHashes. Equal sets are one node from here on.
2. Each tree sorts the signatures in an order of columns of its own. Nodes whose longest
   common prefix reaches ``depth`` form a region, and sets in it whose sizes allow a link,
   directly or through others, a run. In a run, neighbours in the sorted order are candidates:
   where signatures lie dense they agree on ``deeper`` more columns, where they lie sparse
   the least depth does. A region of more than ``region_limit`` nodes is dealt over tasks
   with overlapping borders. A pair at similarity 0.75 shares a region of depth 4 in one of
   32 trees with probability 1 - (1 - 0.75**4)**32 = 0.999995.
3. Candidates connect nodes to clusters. In each cluster the whole sets are compared
   through an index of their shingles; big clusters are cut into blocks that meet in pairs.
   Every link found is exact, and no pair of a cluster goes unseen.
4. Links connect nodes to components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, connected_components, cut, drop_caches, fresh_name, map_batches, number_rows, pack_arrays, release_memory, ship_package, text_bytes, unpack_arrays, worker_cache


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    numerator: int = 75  # similarity threshold, in hundredths
    trees: int = 32
    depth: int = 4
    deeper: int = 2  # further columns that a tree's order goes by, two at most
    region_limit: int = 4096
    heavy_share: int = 64  # nodes of heavy_rows in one region that make it one to be counted
    heavy_rows: int = 50_000
    block: int = 768
    seed: int = 12


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


_words = _Words()


def _clear() -> bool:
    held = bool(_words)
    _words.clear()
    return held


worker_cache("neardup", _clear)


def shingles(b: bytes | None, p: NearDupParams) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with too few words, of all of them."""
    words = (b or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(p.shingle, len(w))
    odd = np.random.default_rng(p.seed).integers(1, 1 << 62, p.shingle + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64) * odd[-1]
    for j in range(k):
        h += w[j : j + m] * odd[j]
        h ^= h >> np.uint64(31)
    return np.unique(mix(h))


def signature(s: np.ndarray, p: NearDupParams) -> np.ndarray:
    """The least value of each of trees * depth hash functions over a set."""
    a = (np.random.default_rng(p.seed + 1).integers(0, 1 << 31, p.trees * p.depth) * 2 + 1).astype(np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 1024):
        z = h[lo : lo + 1024, None] * a[None, :]
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        np.minimum(out, z.min(axis=0), out=out)
    return out


def signatures(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """row, doc_id, n, h1, h2, signature of every row of (row, doc_id, text)."""

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sets = [shingles(b, p) for b in text_bytes(part.column(2))]
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([int(mix(s ^ np.uint64(1)).sum()) for s in sets], np.uint64)
            h2 = np.array([int(mix(s ^ np.uint64(2)).sum()) for s in sets], np.uint64)
            sig = [signature(s, p).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sig, pa.binary())], names=["row", "doc_id", "n", "h1", "h2", "signature"])

    return map_batches(rows.select("row", "doc_id", "text"), "row long, doc_id long, n long, h1 long, h2 long, signature binary", run, keep="neardup")


# -- candidates -----------------------------------------------------------------------


def region_keys(sig: np.ndarray, tree: int, p: NearDupParams) -> np.ndarray:
    """Hashes of a tree's own columns: nodes of equal hashes form a region."""
    h = np.full(len(sig), tree + 1, np.uint64)
    for i in range(tree * p.depth, (tree + 1) * p.depth):
        h = mix(h ^ (sig[:, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return h


def order_keys(sig: np.ndarray, tree: int, p: NearDupParams) -> np.ndarray:
    """What a tree's order goes by behind the columns of the regions: the columns of the next tree, in turn."""
    h = np.zeros(len(sig), np.uint64)
    for i in range(min(p.deeper, 2)):
        h = (h << np.uint64(32)) | sig[:, ((tree + 1) * p.depth + i) % sig.shape[1]].astype(np.uint64)
    return h


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), -1)


def heavy_regions(nodes: DataFrame, total: int, p: NearDupParams) -> tuple[dict[int, int], int]:
    """Keys and sizes of regions so large that they are dealt over several tasks, and the size from which they are.

    That size grows with the corpus once it has some 10**7 texts, so there are never more
    than 65,536 such regions. Only regions that hold a share of some ``heavy_rows`` rows are
    counted; the others are small enough for a task.
    """
    limit = max(p.region_limit, total * p.trees >> 16)

    def run(batches):
        drop_caches()

        def counted(some: list[np.ndarray]):
            sig = np.concatenate(some)
            for t in range(p.trees):
                k, n = np.unique(region_keys(sig, t, p), return_counts=True)
                big = n >= p.heavy_share
                if big.any():
                    yield pa.RecordBatch.from_arrays([pa.array(k[big].view(np.int64)), pa.array(n[big])], names=["key", "n"])

        some, held = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(_matrix(batch.column(0)))
                held += batch.num_rows
            if held >= p.heavy_rows:
                yield from counted(some)
                some, held = [], 0
        if held:
            yield from counted(some)
        del some
        release_memory()

    found = nodes.select("signature").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).collect()
    return {r["key"]: r["n"] for r in found}, limit


def size_class(n: np.ndarray, p: NearDupParams) -> np.ndarray:
    """Sets of one class differ in size by less than sets of the needed similarity may."""
    return np.floor(np.log(n) / max(np.log(100 / p.numerator), 1e-9)).astype(np.int64)


def hubs(nodes: DataFrame, heavy: np.ndarray, p: NearDupParams) -> np.ndarray:
    """Hashes of (key, row) of the least node, by (n, row), of each size class of each heavy region."""

    def run(batch: pa.RecordBatch):
        rows, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        sig, size = _matrix(batch.column(2)), size_class(n, p)
        for t in range(p.trees):
            key = region_keys(sig, t, p)
            at = np.flatnonzero(np.isin(key, heavy))
            at = at[np.lexsort((rows[at], n[at], size[at], key[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (key[at][1:] != key[at][:-1]) | (size[at][1:] != size[at][:-1])
            at = at[new]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(size[at]), pa.array(n[at]), pa.array(rows[at])], names=["key", "size", "n", "row"])

    found = map_batches(nodes.select("row", "n", "signature"), "key long, size long, n long, row long", run).groupBy("key", "size").agg(F.min(F.struct("n", "row")).alias("hub")).select("key", "hub.row").collect()
    key, row = (np.array([r[name] for r in found], np.int64).view(np.uint64) for name in ("key", "row"))
    return np.sort(mix(key ^ mix(row)))


def regions(nodes: DataFrame, total: int, parts: int, p: NearDupParams) -> DataFrame:
    """part, data: the nodes of all trees, dealt by region as packed arrays.

    A heavy region is dealt into parts of about region_limit nodes by a hash of the row, and
    its hubs go to all of them. That loses no pair: take sets a, b of the needed similarity,
    a the smaller. The hub of b's class, no longer than b, is of a's class too or lies
    between a and b. Either way the neighbours in a's part connect a with it, and those in
    b's part connect b with it.
    """
    sizes, limit = heavy_regions(nodes, total, p)
    heavy = np.sort(np.array(list(sizes), np.int64).view(np.uint64))
    pieces = np.array([-(-sizes[k] // limit) for k in heavy.view(np.int64).tolist()], np.uint64)
    shared = hubs(nodes, heavy, p) if len(heavy) else heavy

    def run(batch: pa.RecordBatch):
        rows, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
        sig, salt = _matrix(batch.column(2)), mix(rows.astype(np.uint64))
        all_ = {"key": [], "row": [], "n": [], "deep": []}
        for t in range(p.trees):
            key, at = region_keys(sig, t, p), np.arange(len(rows))
            hot = np.flatnonzero(np.isin(key, heavy))
            if len(hot):
                whole = key[hot]
                of = pieces[np.searchsorted(heavy, whole)]
                key[hot] = mix(whole ^ (salt[hot] % of + np.uint64(1)))
                hub = np.flatnonzero(np.isin(mix(whole ^ salt[hot]), shared))
                for i in hub.tolist():
                    key = np.concatenate((key, mix(whole[i] ^ np.arange(1, int(of[i]) + 1, dtype=np.uint64))))
                    at = np.concatenate((at, np.full(int(of[i]), hot[i])))
            for name, v in zip(all_, (key, rows[at], n[at], order_keys(sig, t, p)[at]), strict=True):
                all_[name].append(v)
        a = {k: np.concatenate(v) for k, v in all_.items()}
        part = (a["key"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[i] : ends[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack_arrays(**{k: v[at] for k, v in a.items()})], pa.binary())], names=["part", "data"])

    return map_batches(nodes.select("row", "n", "signature"), "part int, data binary", run)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges with the least node it is connected to (others than itself)."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def neighbours(a: dict[str, np.ndarray], p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges of the regions of one part.

    By set size a region falls into runs: two sets of the needed similarity differ in size
    by a factor of 0.75 at most, and so do the sizes between them, so no pair is in two runs.
    In each run the nodes lie in the tree's order, and neighbours in it are edges: those with
    the longest common prefixes. They connect the run, so every pair of it is compared.
    """
    order = np.lexsort((a["row"], a["n"], a["key"]))
    key, n = a["key"][order], a["n"][order].astype(np.int64)
    run = np.zeros(len(order), np.int64)
    run[1:] = np.cumsum((key[1:] != key[:-1]) | (100 * n[:-1] < p.numerator * n[1:]))
    order = order[np.lexsort((a["row"][order], a["deep"][order], run))]
    row = a["row"][order]
    near = run[1:] == run[:-1]  # runs keep their places
    return row[:-1][near], row[1:][near]


def candidate_edges(nodes: DataFrame, total: int, p: NearDupParams) -> DataFrame:
    parts = int(min(1 << 20, max(32, total * p.trees // 500_000)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = [unpack_arrays(raw) for raw in pdf["data"]]
        u, v = forest(*neighbours({k: np.concatenate([s[k] for s in some]) for k in some[0]}, p))
        return pd.DataFrame({"src": u, "dst": v})

    return regions(nodes, total, parts, p).groupBy("part").applyInPandas(run, "src long, dst long").distinct()


# -- links ----------------------------------------------------------------------------


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, through an index of y's elements."""
    size_x, size_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    ex, ey = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), size_x), np.repeat(np.arange(len(y)), size_y)
    values, at = np.unique(np.concatenate((ex, ey)), return_inverse=True)
    ix, iy = at[: len(ex)], at[len(ex) :]
    cx, cy = np.bincount(ix, minlength=len(values)), np.bincount(iy, minlength=len(values))
    both = (cx > 0) & (cy > 0)
    out = np.zeros((len(x), len(y)), np.int64)
    matches = int((cx * cy)[both].sum())
    if matches * 8 > len(x) * len(y) * int(both.sum()):  # dense: as a product of 0/1 matrices
        number = np.cumsum(both) - 1
        ix_, rx_ = number[ix[both[ix]]], rx[both[ix]]
        iy_, ry_ = number[iy[both[iy]]], ry[both[iy]]
        width = int(both.sum())
        step = 4096
        for lo in range(0, width, step):
            mx, my = np.zeros((len(x), step), np.float32), np.zeros((len(y), step), np.float32)
            k = (ix_ >= lo) & (ix_ < lo + step)
            mx[rx_[k], ix_[k] - lo] = 1
            k = (iy_ >= lo) & (iy_ < lo + step)
            my[ry_[k], iy_[k] - lo] = 1
            out += (mx @ my.T).astype(np.int64)
        return out
    order = np.argsort(iy, kind="stable")
    ends = np.concatenate(([0], np.cumsum(cy)))
    ry = ry[order]
    bounds = np.concatenate(([0], np.cumsum(size_x)))
    for i in range(len(x)):
        e = ix[bounds[i] : bounds[i + 1]]
        e = e[both[e]]
        n = cy[e]
        if n.sum():
            pick = np.arange(n.sum()) + np.repeat(ends[e] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            out[i] = np.bincount(ry[pick], minlength=len(y))
    return out


def exact_links(rows_x: np.ndarray, x: list[np.ndarray], rows_y: np.ndarray, y: list[np.ndarray], p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    both = overlaps(x, y)
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
    i, j = np.nonzero(100 * both >= p.numerator * union)
    u, v = rows_x[i], rows_y[j]
    return u[u != v], v[u != v]


def links(sets: DataFrame, clusters: DataFrame, p: NearDupParams) -> DataFrame:
    """src, dst: a spanning forest of the links inside each pair of blocks of each cluster."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    # a block number for each node of a large cluster, by a hash, so that no task has them all
    member = clusters.join(sizes, "component").select(F.col("node").alias("row"), "component", F.greatest(F.lit(1), F.ceil(F.col("members") / p.block)).cast("int").alias("blocks"))
    member = member.withColumn("b", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # block pairs (i, j) with i <= j; a node goes to all pairs that its block is part of
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    held = member.join(sets, "row").withColumn("pair", F.explode(pair)).select("component", "blocks", "b", "row", "words", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    # many small clusters share a task, a pair of blocks of a large one has a group of its own
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(256))).otherwise(F.xxhash64("component", "i", "j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drop_caches()
        out = []
        for (_, i, j), g in pdf.groupby(["component", "i", "j"], sort=False):
            x, y = g[g["b"] == i], g[g["b"] == j]
            if not len(x) or not len(y) or len(g) < 2:
                continue
            sx = [np.frombuffer(w, np.uint64) for w in x["words"]]
            sy = sx if i == j else [np.frombuffer(w, np.uint64) for w in y["words"]]
            u, v = forest(*exact_links(x["row"].to_numpy(np.int64), sx, y["row"].to_numpy(np.int64), sy, p))
            if len(u):
                out.append(pd.DataFrame({"src": u, "dst": v}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})

    return held.withColumn("g", group).groupBy("g").applyInPandas(run, "src long, dst long")


def shingle_sets(rows: DataFrame, wanted, p: NearDupParams) -> DataFrame:
    """row, words (packed shingle hashes) of the rows that ``wanted`` may hold."""

    def run(batch: pa.RecordBatch):
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        hit = wanted.value.has(rows)
        if not hit.any():
            return
        some = batch.filter(pa.array(hit))
        for lo in range(0, some.num_rows, 500):
            part = some.slice(lo, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(b, p).tobytes() for b in text_bytes(part.column(1))], pa.binary())], names=["row", "words"])

    return map_batches(rows.select("row", "text"), "row long, words binary", run, keep="neardup")


# -- whole ----------------------------------------------------------------------------


def components(rows: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """row, doc_id, n_shingles, component_id, keep_row of every row of (row, doc_id, text).

    ``row`` is a distinct number for each row. Null and empty texts have no shingles and are
    linked with nothing. Rows that repeat an id are nodes of their own. component_id is the
    least doc_id of the component (null if all are null); keep_row marks one row of each
    component, the one of the least (doc_id, row), null ids last.
    """
    spark = rows.sparkSession
    ship_package(spark)
    sigs = cut(signatures(rows, p))
    reps = cut(sigs.filter("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")))
    nodes = sigs.join(reps.select(F.col("rep").alias("row")), "row", "left_semi")
    total = reps.count()
    clusters = cut(connected_components(cut(candidate_edges(nodes, total, p))))
    wanted = spark.sparkContext.broadcast(bits_of(clusters, ["node"]))
    found = connected_components(cut(links(shingle_sets(rows, wanted, p), clusters, p)))
    of_rep = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ends = of_rep.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("best"))
    named = of_rep.join(ends, "component").select("h1", "h2", "component_id", F.col("best.row").alias("best"))
    out = sigs.select("row", "doc_id", "n", "h1", "h2").filter("n > 0").join(named, ["h1", "h2"]).select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("best")).alias("keep_row"))
    alone = sigs.filter("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep_row"))
    return out.unionByName(alone)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    name = fresh_name(docs, "dup_row")
    return number_rows(docs, name), name


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every row of ``docs``; see components()."""
    rows, name = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    c = components(rows.withColumnRenamed(name, "row"), p)
    return c.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all columns; see components()."""
    rows, name = _numbered(docs)
    c = components(rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), p)
    gone = c.filter("not keep_row").select(F.col("row").alias(name))
    return rows.join(gone, name, "left_anti").select(*docs.columns)
