import random

import numpy as np
import pytest

from quillroute.llm import linededup as L


def brute(rows, t=0.75, least=5):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = [], {}
    for i in order:
        gone[i] = []
        for j, line in enumerate((rows[i][1] or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if len(s) < least:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-12 for o in seen):
                gone[i].append(j)
            seen.append(s)
    return sorted((str(rows[i][0]), gone[i]) for i in gone)


def corpus(seed):
    r = random.Random(seed)
    pool = [[f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(r.randint(1, 30))] for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = f"z{r.randint(0, 30)}"
            lines.append(r.choice([" ", "  "]).join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,params", [(0, {}), (1, {"enough": 1, "block_bytes": 800, "list_rows": 50}), (2, {"block_bytes": 1}), (3, {"likely": 0.0, "enough": 1}), (5, {"heavy": 1, "likely": 0.0, "enough": 1, "named": 1})])
def test_against_brute_force(spark, docs_of, seed, params):
    rows = corpus(seed)
    out = L.line_report(docs_of(rows, extra=True).coalesce(1), L.LineParams(**params)).collect()
    assert sorted((str(r["doc_id"]), list(r["removed"])) for r in out) == brute(rows)
    for r in out:
        assert r["n_removed"] == len(r["removed"])


def test_edges(spark, docs_of):
    line = "one two three four five six"
    rows = [(3, line), (1, line + "\n\n" + line), (2, None), (4, ""), (5, "a b"), (6, "a b"), (None, line.upper()), (3, "x\n" + line), (7, " ".join(f"t{i}" for i in range(30_000)))]
    out = L.line_report(docs_of(rows).coalesce(1)).collect()
    assert sorted((str(r["doc_id"]), list(r["removed"])) for r in out) == brute(rows)
    assert {r["doc_id"]: r["n_lines"] for r in out}[2] == 0
    cut = L.drop_repeated_lines(docs_of(rows).coalesce(1))
    assert cut.columns == docs_of(rows).columns
    texts = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in cut.collect() if r["doc_id"] in (1, 3, 2))
    assert texts == [("1", line + "\n", len(line) + 1), ("2", None, None), ("3", "", 0), ("3", "x", 1)]
    assert L.line_report(docs_of([])).count() == 0


def test_filters_never_lose_a_pair():
    """All pairs of a list above the threshold are among the candidates, whatever the order."""
    r = np.random.default_rng(1)
    lines = ["\n".join(" ".join(f"w{x}" for x in r.choice(40, r.integers(5, 25), replace=False)) for _ in range(120))]
    p = L.LineParams()
    a = L.block_of([0], [0], [lines[0].encode()])
    sets = [frozenset(x.split()) for x in lines[0].split("\n")]
    post = L.postings_of(a, np.full(1 << p.rarity_bits, 9, np.uint32), p)
    y, x, _, kept = L.candidates_in(post, p, None, None)
    got = {(kept["line"][i], kept["line"][j]) for i, j in zip(y, x)}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert want <= got


def test_the_query_knows_no_line_that_is_too_short(spark, docs_of, monkeypatch):
    from quillroute.llm import queries

    import corpus_pipeline

    rows = corpus(4) + [(100, "a b\nA  b\nc"), (101, "c\nb a b\nx y z"), (102, "x y z w\nx y\n\n"), (103, "漢字仮名交じり文"), (104, "漢字仮名交じり文\nx y z v"), (105, "p q r s\nb a b c d"), (106, "r q p\nd c b a e")]
    docs = docs_of(rows).coalesce(1).cache()
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: docs)
    out = queries.op10_line_dedup(spark, "").collect()
    want = brute(rows, least=1)
    assert sorted((str(r["doc_id"]), list(r["removed"])) for r in out) == want
    gone = dict(want)
    kept = {str(r["doc_id"]): r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {str(d): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[str(d)]) for d, t in rows}


def test_words_are_told_apart_as_split_does():
    texts = [b"", b" ", b"A b\tA\x0bb c\r\nA", "Äb äb \u00a0x".encode(), b"x" * 70 + b" " + b"X" * 70 + b" " + b"x" * 71, b"w" * (1 << 18) + b" q " + b"r " * (1 << 18), b"ab ba"]
    for raw in texts:
        at, h = L.words_in(raw)
        words = raw.lower().split()
        assert len(words) == len(h)
        assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))
        assert all(raw[i : i + len(w)].lower() == w for i, w in zip(at.tolist(), words))


def test_long_texts_are_cut_between_lines():
    raw = b"a\n\n" + b"b" * 50 + b"\nc d\n\n"
    for most in (1, 3, 10, 200):
        got = list(L.pieces_of(raw, most))
        assert b"\n".join(x for _, x in got) == raw
        assert [n for n, _ in got] == [raw[: sum(len(x) + 1 for _, x in got[:i])].count(b"\n") for i in range(len(got))]


def test_few_lines_that_still_look_are_served_by_line():
    """A long list of moderately similar lines, in which all but some stop early."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(12)]
    lines = [" ".join(base + [f"x{r.randint(0, 3)}"]) + f" y{i}" for i in range(150)] + [" ".join(base[:9] + [f"z{i}_{j}" for j in range(2)]) for i in range(150)]
    r.shuffle(lines)
    p = L.LineParams()
    a = L.block_of([0], [0], ["\n".join(lines).encode()])
    post = L.postings_of(a, np.full(1 << 12, 9, np.uint8), p)
    y, x, stopped, kept = L.candidates_in(dict(post), p, p.enough, None)
    every_y, every_x, none, every = L.candidates_in(dict(post), p, None, None)
    assert not len(none)
    pairs = {(kept["line"][i], kept["line"][j]) for i, j in zip(y, x)}
    whole = {(every["line"][i], every["line"][j]) for i, j in zip(every_y, every_x)}
    early = set(kept["line"][stopped])
    assert pairs <= whole
    assert {i for i, _ in whole} == {i for i, _ in pairs}
    assert {(i, j) for i, j in whole if i not in early} <= pairs


def test_what_a_part_holds_follows_its_lines_not_their_pairs():
    """A large group of near copies of one line, none of them likely enough to stop at: all pairs pass the filters."""
    import tracemalloc

    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]

    def copy():
        at = set(r.sample(range(60), 6))
        return " ".join(f"x{r.randint(0, 10**9)}" if i in at else w for i, w in enumerate(base))

    text = "\n".join(copy() for _ in range(1200)).encode()
    p = L.LineParams(held_pairs=5_000)
    post = L.postings_of(L.block_of([0], [0], [text]), np.full(1 << 12, 9, np.uint8), p)
    y, x, share, stopped, a = L.scored_candidates(dict(post), p, None, None)
    every = {}
    for i, j, s in zip(y.tolist(), x.tolist(), share.tolist()):
        every.setdefault(int(a["line"][i]), set()).add((-s, int(a["line"][j])))
    assert len(y) > 500_000 and not stopped.any()
    tracemalloc.start()
    y, x, share, more, a = L.scored_candidates(dict(post), p, None, None, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000  # all pairs: 20 bytes each, and as much again to put them together
    got = {}
    for i, j, s in zip(y.tolist(), x.tolist(), share.tolist()):
        got.setdefault(int(a["line"][i]), []).append((-s, int(a["line"][j])))
        assert more[i] == (len(every[int(a["line"][i])]) > 3)
    assert got == {k: sorted(v)[:3] for k, v in every.items()}
