import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillroute.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        close = sorted((-n[x], x) for x in n if near(w, x))
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n[w] else None
        out[w] = (n[w], len(close), form[w], -close[0][0] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def corpus(seed, docs=60):
    r = random.Random(seed)
    stems = ["aaaaa", "aaaaaa", "colour", "color", "colours", "Maße", "straße", "été", "ÀÉÎÕÜ", "aaaba", "naïveté", "a" * 40, "b" * 300 + "c" + "b" * 300]

    def variant(w):
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]]) or "a"
        return w

    # the shares differ so that forms chain
    vocabulary = [variant(r.choice(stems)) for _ in range(150)]
    weights = [2 ** r.randrange(6) for _ in vocabulary]
    sep = [" ", ", ", "1", "-", "\n", "Ðx ", "日"]
    texts = [r.choice(sep).join(r.choices(vocabulary, weights, k=40)) for _ in range(docs)]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0]), (5, texts[5])]


def rows(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"key_words": 4, "bin_words": 50, "held": 5}, {"key_bytes": 100}])
def test_against_brute_force(spark, docs_of, limits):
    """Also with limits so low that keys are halved down to single positions."""
    docs = corpus(len(limits))
    want = brute(docs)
    assert sum(w[2] is not None for w in want.values()) > 15 and any(w[4] != w[2] for w in want.values() if w[2])
    assert rows(V.spelling_variants(docs_of(docs, extra=True), V.VariantParams(**limits))) == want


def test_empty(spark, docs_of):
    assert V.spelling_variants(docs_of([])).collect() == []
    assert V.spelling_variants(docs_of(["abcdef abcdef", None])).collect() == []


def test_wavelet_tree_reports_rectangles():
    g = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        values = g.permutation(n + 5)[:n]
        tree = V.WaveletTree(values)
        begin, low = g.integers(0, n + 1, 50), g.integers(0, n + 5, 50)
        end, high = np.minimum(n, begin + g.integers(0, n + 1, 50)), low + g.integers(0, n + 1, 50)
        q, v = tree.report(begin, end, low, high)
        want = sorted((i, x) for i in range(50) for x in values[begin[i] : end[i]] if low[i] <= x < high[i])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_pairs_are_reported_once_over_all_ranges():
    r = random.Random(1)
    for _ in range(200):
        size = r.randrange(1, 6)
        short = sorted({"".join(r.choices("ab", k=size)) for _ in range(10)})
        long = sorted({"".join(r.choices("ab", k=size + 1)) for _ in range(10)})
        got = []
        for low in range(size + 1):
            x, y = V.near_pairs([w.encode() for w in short], [w.encode() for w in long], low, low + 1)
            got += zip(x.tolist(), y.tolist(), strict=True)
        words = short + long
        want = sorted((i, j) for i in range(len(short)) for j in range(len(words)) if near(words[i], words[j]))
        assert sorted(got) == want
