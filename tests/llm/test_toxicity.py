import math
import random

import numpy as np

from quillroute.llm import toxicity as T


def corpus(n=400):
    texts, labels = [], []
    r = random.Random(4)
    for i in range(n):
        words = ["".join(r.choice("abdeginorstu") for _ in range(6)) for _ in range(30)]
        if i % 4 == 0:
            words[5] = "foulish" + "abcdefghijk"[i % 11]  # one stem, many endings
            words[9] = "rotten" if i % 8 == 0 else "vile"
            labels.append(1)
        else:
            labels.append(0)
        texts.append(" ".join(words))
    return texts, labels


def test_held_out_accuracy(spark, docs_of):
    texts, y = corpus()
    labels = spark.createDataFrame([(i, 1, y[i]) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in T.toxicity_grades(docs_of(texts, extra=True), labels).collect()}
    assert all(out[i]["toxic"] == bool(y[i]) for i in range(200, 400))
    assert all(0 <= r["severity"] <= 3 for r in out.values())
    assert min(out[i]["severity"] for i in range(400) if y[i]) > max(out[i]["severity"] for i in range(400) if not y[i])
    kept = T.drop_toxic(docs_of(texts), labels)
    assert kept.count() == sum(v == 0 for v in y)


def test_edges(spark, docs_of):
    texts, y = corpus(120)
    rows = [*enumerate(texts), (200, None), (201, ""), (202, "vile foulishd " * 9000), (202, "plain words"), (203, "1 2 3 !")]
    labels = spark.createDataFrame([(i, 1, y[i]) for i in range(120)] + [(None, 1, 1), (3, None, None), (200, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    out = T.toxicity_grades(docs_of(rows), labels).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["toxic"])
    assert by[200] == by[201] == by[203] == [False] and sorted(by[202]) == [False, True]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in T.toxicity_grades(docs_of(texts), none).collect())
    assert T.toxicity_grades(docs_of([]), labels).count() == 0


def test_thresholds_are_ordered_and_fit_recovers_order():
    r = np.random.default_rng(0)
    w = np.array([2.0, 1.0, 0.5])
    x = r.random((3000, 3)) < 0.4
    score = x @ w + r.logistic(size=3000)
    y = np.searchsorted([1.0, 2.5], score)
    got, b = T.fit_ordinal([np.flatnonzero(v) for v in x], y, 3, 2, T.ToxicityParams())
    assert b[0] < b[1] and got[0] > got[1] > got[2] > 0


def test_gradient_equals_differences():
    """One step's direction against numeric differences of the log-likelihood."""
    x = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], int)]
    y = np.array([1, 2, 1, 0])
    w, b = T.fit_ordinal(x, y, 2, 2, T.ToxicityParams(steps=2000, l2=1.0))

    def loss(w, b):
        share = np.where(y > 0, 0.5 / 3, 0.5)
        s = np.array([w[i].sum() for i in x])
        up = np.column_stack([np.ones(4), *(1 / (1 + np.exp(-(s - t))) for t in b), np.zeros(4)])
        own = up[np.arange(4), y] - up[np.arange(4), y + 1]
        return (share * np.log(own)).sum() - (w**2).sum() / 2 / 2

    for i in range(2):
        d = np.zeros(2)
        d[i] = 1e-3
        assert abs(loss(w + d, b) - loss(w - d, b)) / 2e-3 < 5e-3


def test_grades_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    assert model.index and list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in T.grade(docs, model).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = set(T._WORD.findall((text or "").lower()))
        held = [f for f in model.index if (f[1:] in words if f[0] == "=" else any(w.startswith(f) and w != f for w in words))]
        score = sum(model.weights[model.index[f]] for f in held)
        up = [1 / (1 + math.exp(-(score - t))) if text else 0.0 for t in model.thresholds]
        r = got[doc_id]
        assert math.isclose(r["severity"], sum(up), abs_tol=1e-9) and math.isclose(r["p_toxic"], up[0], abs_tol=1e-9)
        assert r["toxic"] == (r["p_toxic"] >= model.params.cutoff)
