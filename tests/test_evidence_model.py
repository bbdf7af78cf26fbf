import random

import numpy as np
from pyspark.sql import functions as F

from quillroute.operators import learning
from quillroute.operators.routing import BACKENDS

NAMES = ("route__a", "evidence__b", "evidence__c")


def pairs(spark, n=60):
    r = random.Random(5)
    rows = []
    for qid in range(n):
        gold = r.choice(BACKENDS)
        for b in BACKENDS:
            right = b == gold
            rows.append((qid, b, float(qid % 3), right + r.gauss(0, 0.4), r.random(), float(right)))
    return spark.createDataFrame(rows, "qid int, backend string, route__a double, evidence__b double, evidence__c double, label double")


def newton(x, y, w, c):
    n = len(y)
    x1 = np.column_stack([x, np.ones(n)])
    penalty = np.diag([1 / (c * n)] * x.shape[1] + [0.0])
    beta = np.zeros(x1.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x1 @ beta))
        grad = x1.T @ (w * (p - y)) / n + penalty @ beta
        beta -= np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 / n + penalty, grad)
    return beta


def test_weights_are_the_optimum(spark):
    d = pairs(spark)
    weights, intercept = learning.evidence_model(d, NAMES)
    rows = d.collect()
    x, y = np.array([[r[n] for n in NAMES] for r in rows]), np.array([r["label"] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert np.allclose([*(weights[n] for n in NAMES), intercept], newton(x, y, w, 0.7), atol=1e-5)
    gradient = {r["feature"]: r["gradient"] for r in learning.model_gradient(d, weights, intercept).collect()}
    assert set(gradient) == {*NAMES, "intercept"} and all(abs(g) < 1e-6 for g in gradient.values())
    off = learning.model_gradient(d, weights | {"evidence__b": 0.0}, intercept)
    assert abs(off.filter("feature = 'evidence__b'").first()["gradient"]) > 1e-3


def test_candidates_of_a_question_share_a_fold_and_one_is_chosen(spark):
    d = pairs(spark)
    assert learning.group_folds(d, "qid", 4, 71).groupBy("qid").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    routes = learning.evidence_routes_out_of_fold(d, NAMES).join(d.select("qid", "backend", "label"), ["qid", "backend"]).collect()
    chosen = [r for r in routes if r["selected"]]
    assert len(routes) == 240 and len(chosen) == len({r["qid"] for r in chosen}) == 60
    assert sum(r["label"] for r in chosen) / 60 > 0.6
    assert len({r["fold"] for r in routes}) == 4
