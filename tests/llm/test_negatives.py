import math
import random
import struct

import pytest

from quillroute.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, win int"
SMALL = {"sample": 40, "cells": 8, "cell_rows": 16, "leaf_rows": 6, "growth": 2, "anchors": 3, "anchor_modulus": 10}


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, modulus=10):
    usable = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in {u for u in usable if u[0] % modulus == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in usable if j != i)
        positives = sorted({(s, j) for s, j, m in [x for x in scored if x[2] == label][:5]})
        for s, j in positives:
            fit = [(t, n) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **p):
    got = N.hard_negatives(spark.createDataFrame(rows, SCHEMA), N.NegativeParams(**(SMALL | p))).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    """Clusters and ties, with limits so low that cells, pieces, parts and floors are all used."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [single(c + r.choice([0.0, 0.25, r.gauss(0, 0.4)])) for c in r.choice(centres)], r.randrange(4), None, None, 1) for i in range(300)]
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows) == want


def test_edges(spark):
    same = [1.0, 0.5]
    rows = [(i, same, i % 3, None, None, 1) for i in range(40)]  # all scores tie, so no negative is low enough
    rows += [(100 + i, [0.5, 0.25 + i / 100], i % 3, None, None, 1) for i in range(20)]
    rows += [(200, None, 1, None, None, 1), (210, [1.0, None], 1, None, None, 1), (220, [float("inf"), 1.0], 1, None, None, 1), (230, same, None, None, None, 1), (None, same, 1, None, None, 1)]
    rows += [(240, [3.0], 1, None, None, 1), (250, [], 1, None, None, 1), (260, [0.25, 0.5, 9.0], 2, None, None, 1), (270, [-1.0, 0.0], 8, None, None, 1)]
    rows += [rows[10], rows[10], rows[45]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == run(spark, []) == []


def test_large_components(spark):
    r = random.Random(5)
    rows = [(i, [single(r.choice([2e4, 9e5, 3.0]) * r.random()), single(1000.0 * r.random())], i % 2, None, None, 1) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_tree_bounds_hold():
    import numpy as np

    g = np.random.default_rng(1)
    v = np.floor(g.normal(size=(500, 5)) * 100)
    most2 = float((v**2).sum(axis=1).max())
    tree = N.Tree.of(v, most2, 20)
    assert sorted(np.concatenate(tree.members)) == list(range(500)) and len(tree.members) >= 25
    q = np.floor(g.normal(size=(30, 5)) * 150)
    top, bottom = tree.score_range(q, most2)
    for leaf, rows in enumerate(tree.members):
        s = q @ v[rows].T
        assert (s.max(axis=1) <= top[:, leaf]).all() and (s.min(axis=1) >= bottom[:, leaf]).all()
    # among vectors of one length few leaves can hold the best rows
    v = g.normal(size=(500, 3))
    v = np.floor(v / np.sqrt((v**2).sum(axis=1))[:, None] * 1000)
    most2 = float((v**2).sum(axis=1).max())
    top, _ = N.Tree.of(v, most2, 20).score_range(v[:30], most2)
    best = np.sort(v[:30] @ v.T, axis=1)[:, -10]
    assert (top >= best[:, None]).mean() < 0.6
