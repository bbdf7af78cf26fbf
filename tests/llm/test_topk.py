import math
import random

import pytest

from quillroute.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k, modulus=20):
    usable = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(64 * x) for x in v]))
    out = set()
    for i, v in {(i, tuple(v)) for i, v in usable if i % modulus == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def run(spark, rows, **p):
    got = K.top_k(spark.createDataFrame(rows, SCHEMA), K.TopKParams(**p)).collect()
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.gauss(0, 1 + i % 5)]) for _ in range(8)], 0, None, None) for i in range(150)]
    rows = [(i, [struct_float(x) for x in v], *rest) for i, v, *rest in rows]
    got = run(spark, rows, candidate_block=32, query_block=3, chunk=8, head=3, seeds=25)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_ties_nulls_and_few_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same, 0, None, None) for i in range(0, 60)]
    rows += [(100, None, 0, None, None), (101, [1.0, None], 0, None, None), (102, [float("nan"), 1.0], 0, None, None), (103, [float("inf"), 1.0], 0, None, None), (None, same, 0, None, None), (104, [3.0], 0, None, None), (105, [], 0, None, None)]
    got = run(spark, rows, candidate_block=16, chunk=4, seeds=5)
    assert set(got) == brute(rows, 20)
    assert set(run(spark, rows[:3])) == brute(rows[:3], 20)
    assert run(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(i, [1000.0 * (i % 7), -2000.0, float(i)], 0, None, None) for i in range(50)]
    assert set(run(spark, rows)) == brute(rows, 20)


def test_no_finite_vector_is_left_out(spark):
    """Products beyond doubles' integers, and beyond a long."""
    r = random.Random(4)
    rows = [(i, [struct_float(r.choice([3e6, -5e7, 1.5, 7e8]) * r.random()), float(i), 2.0**20], 0, None, None) for i in range(60)]
    assert set(run(spark, rows, candidate_block=16, chunk=4, seeds=30)) == brute(rows, 20)
    rows += [(60 + i, [struct_float(10.0 ** (15 + i)), 1.0, -1.0], 0, None, None) for i in range(6)]
    most = 2**63 - 1
    got = run(spark, rows, candidate_block=16, chunk=4, seeds=8)
    scores = {}
    for q, _, v, s in got:
        scores.setdefault(q, []).append((-s, v))
    scaled = {i: [math.floor(64 * x) for x in v] for i, v, *_ in rows}
    for q in (0, 20, 40, 60):
        want = sorted((-max(-most, min(most, sum(a * b for a, b in zip(scaled[q], w)))), i) for i, w in scaled.items() if i != q)[:20]
        assert sorted(scores[q]) == want


def test_short_vectors_are_not_visited(spark):
    """A level of one length fills several blocks, and blocks go by descending length."""
    rows = K.scaled_vectors(spark.createDataFrame([(i, [1.0 if i % 3 else float(i)] * 2, 0, None, None) for i in range(300)], SCHEMA), K.TopKParams())
    dealt, most = K.blocks_by_length(rows, 300, K.TopKParams(candidate_block=20, levels=8))
    found = [(r["block"], r["norm2"]) for r in dealt.collect()]
    assert list(most) == sorted(most, reverse=True)
    assert all(n <= most[b] for b, n in found) and {b for b, _ in found} <= set(range(len(most)))
    assert sum(n == 2 * 64.0**2 for n in most) >= 10
