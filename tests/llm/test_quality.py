import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillroute.llm import quality as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x85\x1c", max_size=60))
def test_statistics_equal_a_plain_count(text):
    assert Q.word_statistics(text.encode()) == plain(text)


def test_binomial_bound():
    assert abs(Q.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-6
    assert Q.binomial_upper(5, 5, 0.05) == 1.0 and Q.binomial_upper(0, 0, 0.05) == 1.0
    assert 0.05 < Q.binomial_upper(5, 100, 0.05) < 0.11


def test_cutoffs_bound_false_rejection():
    r = np.random.default_rng(0)
    n = 4000
    good = r.random(n) < 0.8
    values = r.random((n, len(Q.FEATURES))) * 0.1
    values[~good, 0] += 0.5  # bad documents stand out in one feature
    cuts = Q.choose_cutoffs(values, good, np.zeros(n, int), Q.QualityParams())
    assert 0.1 < cuts[0, 0] < 0.5 and np.isinf(cuts[1:]).all()
    assert ((values > cuts[0]).any(axis=1) & good).sum() / good.sum() <= 0.05
    few = Q.choose_cutoffs(values[:40], good[:40], np.zeros(40, int), Q.QualityParams())
    assert np.isinf(few).all()  # too few labels prove nothing


def test_verdicts(spark, docs_of):
    rich = " ".join(f"word{i}" for i in range(80))
    texts = [rich, None, "", "short", "a b c " * 40, rich, "x" * 100_000, (3, rich)]
    docs = docs_of(texts, extra=True)
    labels = spark.createDataFrame([(0, 1, None), (1, None, 0), (None, 1, 1), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality_verdicts(spark, docs, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        if r["doc_id"] in (1, 2, 4, 6):
            assert r["base_failed"] and not r["kept"]
    assert [r["kept"] for r in out if r["doc_id"] in (0, 5)] == [True, True]
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3
    empty = docs_of([])
    assert Q.quality_verdicts(spark, empty, labels).count() == 0


def test_rules_find_the_bad_ones(spark, docs_of):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(300)]
    bad = [" ".join(f"w{i}x{j}###" for j in range(60)) for i in range(100)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in Q.quality_verdicts(spark, docs, labels).collect()}
    assert all(out[i] for i in range(300)) and not any(out[i] for i in range(300, 400))


def test_fit_counts_every_label(spark, docs_of):
    """The ranks are exact, and no label is left out, however many there are."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) + " #" * (i % 7) for i in range(400)]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i % 7 < 5), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert not hasattr(Q.QualityParams(), "max_labelled")
    rows = spark.createDataFrame([(1, 0, 0, *[float((i * 37) % 101 - 50) / 3] * len(Q.FEATURES)) for i in range(101)], "quality int, half int, stratum int, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    want = sorted((i - 50) / 3 for i in range(101))
    got = Q._order_statistics(rows, {0: [0, 50, 99, 100], 3: [7]})
    assert got == {(0, r): want[r] for r in (0, 50, 99, 100)} | {(3, 7): want[7]}
    cuts = Q.fit(docs, labels)
    assert np.isfinite(cuts[0, 0]) and np.isinf(cuts[1:]).all()
