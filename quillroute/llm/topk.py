"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are integers (floor of 64 times each component). Candidates are dealt into levels of
descending length and, within a level, evenly into blocks; queries are dealt into blocks of
their own. A query block meets, once and as two packed arrays in one task, each candidate
block whose longest vector can still reach the k-th best score known of one of its queries.
Within a candidate block vectors go by descending length. A chunk
of them is skipped when its longest times the query's length cannot reach the query's k-th
best score; for the rest, the first rotated coordinates give a partial sum, and the lengths
of what remains bound the rest of the product (Cauchy-Schwarz). Only pairs whose bound
reaches the k-th best are scored exactly, in integers.

The rotation comes from the SVD of a bounded sample; it sharpens bounds and never changes
results. The first k-th best scores come from the ``seeds`` longest vectors, a bounded set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, run_starts, ship_package

#: Scores beyond a long's range are given as the nearest long.
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: int = 64
    query_modulus: int = 20
    seeds: int = 1024
    sample: int = 20_000
    candidate_block: int = 4096
    query_block: int = 1024
    chunk: int = 512
    levels: int = 256
    head: int = 16


def scaled_vectors(embeddings: DataFrame, p: TopKParams) -> DataFrame:
    """vec_id, v (packed doubles that hold integers), norm2, deal: rows whose vector takes part.

    Null ids, null vectors and vectors with a null or non-finite component are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out_id, out_v, norm = batch.column(0), [], [], []
        for i, x in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or x is None or any(c is None for c in x):
                continue
            v = np.asarray(x, np.float64)
            if not np.isfinite(v).all():
                continue
            v = np.floor(p.scale * v)
            if not np.isfinite(v).all():  # finite before it was scaled
                v = np.nan_to_num(v)
            out_id.append(i)
            out_v.append(v.astype("<f8").tobytes())
            with np.errstate(over="ignore"):
                norm.append(float(v @ v))
        return pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_v, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "v", "norm2"])

    rows = map_batches(embeddings.selectExpr("cast(vec_id as long) vec_id", "embedding"), "vec_id long, v binary, norm2 double", run)
    return rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))


def matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled up with zeros."""
    sizes = {len(r) for r in rows}
    width = max([width, *(s // 8 for s in sizes)])
    if len(sizes) == 1 and sizes == {8 * width}:
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors: coordinates in order of the energy they hold."""
    if not sample.size:
        return np.eye(sample.shape[1])
    sample = sample / max(1.0, float(np.abs(sample).max()))
    _, basis = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(basis[:, ::-1])


def exact_products(q: np.ndarray, c: np.ndarray, paired: bool = False) -> np.ndarray:
    """Integer inner products of all rows, or row by row: in doubles where these are exact, else in 64 bits, else in Python's integers."""
    if not q.size or not c.size:
        return np.zeros(len(q) if paired else (len(q), len(c)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if most >= 2**63:
        wide = np.frompyfunc(int, 1, 1)
        q, c = wide(q), wide(c)
        exact = (q * c).sum(axis=1) if paired else q @ c.T
        return np.clip(exact, LEAST, MOST).astype(np.int64)
    if most >= 2**53:
        q, c = q.astype(np.int64), c.astype(np.int64)
    return (np.einsum("ij,ij->i", q, c) if paired else q @ c.T).astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.floor = floor.copy()
        self.floor_id = np.full(n, np.iinfo(np.int64).max)
        self.q = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def bar(self) -> np.ndarray:
        """The floors as doubles that are no higher; minus infinity where nothing is known."""
        x = self.floor.astype(float)
        return np.where(self.floor <= LEAST, -np.inf, x - 1e-12 * np.abs(x))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        better = (score > self.floor[q]) | (score == self.floor[q]) & (ids <= self.floor_id[q])
        if not better.any():
            return
        q, ids, score = (np.concatenate(x) for x in ((self.q, q[better]), (self.id, ids[better]), (self.score, score[better])))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        starts = run_starts(q)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = rank == self.k - 1
        self.floor[q[last]] = score[last]
        self.floor_id[q[last]] = ids[last]
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, basis: np.ndarray, p: TopKParams) -> Best:
    """The best candidates of one block for each query; ``floor`` is a score known to be reached."""
    best = Best(len(q), p.k, floor)
    width = max(q.shape[1], c.shape[1], len(basis))
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    if len(basis) < width:
        wide = np.eye(width)
        wide[: len(basis), : len(basis)] = basis
        basis = wide
    order = np.argsort(-(c**2).sum(axis=1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    qr, cr = q @ basis, c @ basis
    h = min(p.head, width)
    q_norm, c_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    q_rest, c_rest = np.sqrt((qr[:, h:] ** 2).sum(axis=1)), np.sqrt((cr[:, h:] ** 2).sum(axis=1))
    bounded = len(q) and len(c) and max(q_norm.max(), c_norm.max()) < 1e140  # else products of lengths may overflow
    for lo in range(0, len(c), p.chunk):
        part = slice(lo, lo + p.chunk)
        other = q_ids[:, None] != c_ids[None, part]
        if bounded:
            floor = best.bar()
            slack = 1e-6 * (1 + q_norm * c_norm[lo])
            alive = np.flatnonzero(q_norm * c_norm[lo] + slack >= floor)
            if not len(alive):
                break  # the vectors that follow are no longer
            bound = qr[alive, :h] @ cr[part, :h].T
            bound += np.outer(q_rest[alive], c_rest[part])
            maybe = (bound + slack[alive, None] >= floor[alive, None]) & other[alive]
        else:
            alive, maybe = np.arange(len(q)), other
        at_q, at_c = np.nonzero(maybe)
        if not len(at_q):
            continue
        if len(at_q) > 0.02 * maybe.size:
            score = exact_products(q[alive], c[part])[at_q, at_c]
        else:
            score = exact_products(q[alive[at_q]], c[lo + at_c], paired=True)
        best.add(alive[at_q], c_ids[lo + at_c], score)
    return best


def _pack(df: DataFrame, group: str, columns: str, more: str = "", extra=None) -> DataFrame:
    """One row per group: its ids and vectors as packed bytes, and what ``extra`` makes of them. Groups are of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(list(pdf["v"]))
        ids = pdf["vec_id"].to_numpy(np.int64)
        row = {group: [pdf[group].iloc[0]], f"{columns}_ids": [ids.tobytes()], f"{columns}_v": [np.ascontiguousarray(v).tobytes()]}
        return pd.DataFrame(row | (extra(ids, v) if extra else {}))

    return df.groupBy(group).applyInPandas(run, f"{group} int, {columns}_ids binary, {columns}_v binary{more}")


def blocks_by_length(rows: DataFrame, n: int, p: TopKParams) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with a block number, longer vectors in earlier blocks, and the greatest squared length of each block.

    Levels are cut at quantiles of the lengths; a level that many vectors of one length fill
    has as many blocks as it needs.
    """
    levels = max(1, min(p.levels, n // p.candidate_block))
    at = [i / levels for i in range(1, levels)]
    cuts = (rows.agg(F.percentile_approx("norm2", at, 10_000).alias("c")).first()["c"] or []) if at else []
    cuts = sorted(set(cuts), reverse=True)
    level = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c >= F.col("norm2"))) if cuts else F.lit(0)
    rows = rows.withColumn("level", level)
    found = {r["level"]: r for r in rows.groupBy("level").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).collect()}
    begins, counts, most, next_ = [], [], [], 0
    for i in range(len(cuts) + 1):
        count = max(1, round(found[i]["n"] / p.candidate_block)) if i in found else 1
        begins.append(next_)
        counts.append(count)
        if i in found:
            most += [found[i]["most"]] * count
            next_ += count
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("level") + 1)
    return rows.withColumn("block", (pick(begins) + F.pmod("deal", pick(counts))).cast("int")).drop("level"), np.array(most, float)


def top_k(embeddings: DataFrame, p: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score for every query row's id divisible by ``query_modulus``.

    A query's own id is no candidate, in no row that has it; rows that repeat an id with
    the same vector ask one query, and count one by one as candidates. Vectors of different
    lengths are compared as if zeros filled up the shorter. Scores beyond a long's range are
    given as the nearest long. No vectors: an empty result.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = cut(scaled_vectors(embeddings, p))
    n = rows.count()
    queries = rows.filter(F.col("vec_id") % p.query_modulus == 0).dropDuplicates(["vec_id", "v"])
    nq = queries.count()
    q_blocks = max(1, -(-nq // p.query_block))
    dealt, most = blocks_by_length(rows, n, p)
    share = min(1.0, p.sample / max(1, n))
    drawn = rows.filter(F.pmod("deal", F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(p.sample)
    basis = rotation(matrix([bytes(r["v"]) for r in drawn.collect()] or [b""]))
    seeds = rows.orderBy(F.desc("norm2"), "vec_id", "deal").limit(p.seeds).collect()
    seed_ids, seed_v = np.array([r["vec_id"] for r in seeds], np.int64), matrix([bytes(r["v"]) for r in seeds] or [b""])

    def floors(ids: np.ndarray, v: np.ndarray) -> dict:
        """Scores that each query's k-th best reaches, and the last candidate block that can hold a better one."""
        width = max(v.shape[1], seed_v.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, seed_v[: len(seed_ids)]))
        score = exact_products(a, b)
        score[ids[:, None] == seed_ids[None, :]] = LEAST
        known = np.full(len(ids), LEAST) if score.shape[1] < p.k else np.partition(score, score.shape[1] - p.k, axis=1)[:, score.shape[1] - p.k]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.outer(np.sqrt((a**2).sum(axis=1)), np.sqrt(most))
            able = ~(reach * (1 + 1e-6) + 1e-6 < known[:, None].astype(float)) | (known <= LEAST)[:, None]
        last = np.flatnonzero(able.any(axis=0))
        return {"floor": [known.tobytes()], "last": [int(last[-1]) if len(last) else -1]}

    candidates = _pack(dealt, "block", "c")
    asked = _pack(queries.withColumn("q_block", F.pmod("deal", F.lit(q_blocks)).cast("int")), "q_block", "q", ", floor binary, last int", floors)
    # each query block, a packed row, visits each candidate block that it can gain from: a join on the block number
    visits = F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.col("last")))
    pairs = asked.withColumn("block", F.explode(visits)).join(candidates, "block")

    def search(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
            q, c = (np.frombuffer(r[x], float).reshape(len(i), -1) for x, i in (("q_v", q_ids), ("c_v", c_ids)))
            best = search_block(q_ids, q, np.frombuffer(r["floor"], np.int64), c_ids, c, basis, p)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    found = map_batches(pairs, "query_id long, vec_id long, score long", search)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
