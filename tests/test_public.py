import random

import pytest

from quillroute.operators import lexical, public

RECORD = "doc_id long, title string, canonical_identifiers array<string>, aliases array<string>, lead_summary string, text string, extra string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], RECORD)


ROWS = [
    (1, "Torch Tensor Guide", ["RFC-72"], ["torch", "rfc-72", "abc"], "lead", "body of torch"),
    (2, "Guide", ["45 CFR 164.512", "rfc-72"], ["CFR.164", "cfr.164", "c++ x"], None, "other words"),
    (3, None, None, None, None, None),
    (4, "", [], [""], "", ""),
    (5, "Data data", ["a_b.c"], ["§§§§", "data"], "", "nothing shared"),
]
ASKED = [
    (1, "What is RFC-7231 of the torch guide?"),
    (2, "xcfr.164 and cfr.164!"),
    (3, None),
    (4, ""),
    (5, "data and §§§§"),
    (6, "pytorch tensorflow"),
    (7, "c++ x"),
]


def brute(rows, asked):
    """Every question against every record, by plain string search."""
    import re

    out = {}
    for qid, question in asked:
        low = (question or "").lower()
        inside = lambda a: any((i == 0 or not re.match("[a-z0-9]", low[i - 1])) and not re.match("[a-z0-9]", low[i + len(a) : i + len(a) + 1]) for i in range(len(low)) if low.startswith(a, i))  # noqa: E731, B023
        said = set(re.findall("[a-z0-9]+", low))
        for doc_id, title, ids, aliases, *_ in rows:
            n_ids = sum(1 for x in set(ids or []) if x and x.lower() in low)
            n_aliases = sum(1 for a in set(aliases or []) if len(a) >= 4 and inside(a.lower()))
            words = [w for w in re.findall("[a-z0-9]+", (title or "").lower()) if len(w) >= 4]
            hits = [w for w in words if w in said]
            titled = bool(hits) and len(hits) >= min(2, len(words))
            boost = 8.0 * n_ids + 4.0 * min(2, n_aliases) + 3.0 * titled
            if boost:
                out[qid, doc_id] = (n_ids, n_aliases, titled, boost)
    return out


def boosts(spark, rows, asked):
    found = public.public_boosts(records(spark, rows), spark.createDataFrame(asked, "qid long, question string")).collect()
    return {(r["qid"], r["doc_id"]): (r["n_identifiers"], r["n_aliases"], r["title_hit"], r["boost"]) for r in found}


def test_boosts_of_fields(spark):
    got = boosts(spark, ROWS, ASKED)
    assert got == brute(ROWS, ASKED)
    assert got[1, 1] == (1, 1, True, 15.0)  # an identifier inside a longer one counts, the alias rfc-72 does not
    assert got[2, 2] == (0, 2, False, 8.0) and got[5, 5] == (0, 2, True, 11.0)
    assert not any(q in (3, 4, 6) for q, _ in got)


@pytest.mark.parametrize("small", [True, False])
def test_boosts_equal_brute_force(spark, monkeypatch, small):
    """Also without broadcasts."""
    if not small:
        monkeypatch.setattr(public, "beside", lambda d: lexical.beside(d, 0))
    r = random.Random(7)
    word = lambda: "".join(r.choices("ab1-. ", k=r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(r.randrange(n)))
    rows = [(i, text(5), [word() for _ in range(r.randrange(4))], [text(4) for _ in range(r.randrange(4))], text(5), text(9)) for i in range(60)]
    asked = [(i, text(12)) for i in range(60)]
    want = brute(rows, asked)
    assert boosts(spark, rows, asked) == want and len(want) > 100


def test_ranked_whole_with_boosts(spark):
    rows = [(i, f"T{i}", [], [], "", "torch " * i + "filler") for i in range(1, 30)] + [(99, "Zzz", ["RFC-7"], [], "", "unrelated")]
    asked = spark.createDataFrame([(1, "torch of rfc-72"), (2, "nothing known"), (3, None)], "qid long, question string")
    got = public.public_top_k(records(spark, rows), asked, 3).orderBy("qid", "rank").collect()
    assert [r["qid"] for r in got] == [1, 1, 1]
    # the identifier's document shares no token with the question, and is first by its boost alone
    assert (got[0]["doc_id"], got[0]["base"], got[0]["boost"], got[0]["fields"]) == (99, 0.0, 8.0, "identifier")
    plain = lexical.top_k(lexical.bm25_scores(public.enriched(records(spark, rows)), asked), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["base"]) for r in got[1:]] == [(r["doc_id"], r["score"]) for r in plain]


def test_arbitration(spark):
    rows = [(1, "Tensor Guide", ["RFC-72"], [], "", "tensor"), (2, "Other Guide", [], ["alias word"], "", "tensor tensor")]
    asked = [(1, "bridge of RFC-72", "hybrid", "relational", "bm25"), (2, "alias word", "dense", "semantic", "dense"), (3, "jsonb alias word", "dense", "semantic", "dense"), (4, "RFC-999", "kg", "deductive", "bm25"), (5, None, "dense", "semantic", "dense"), (6, "rfc-72", "bm25", "lexical", "bm25")]
    routed = spark.createDataFrame(asked, "qid long, question string, route string, family string, gold string")
    done = public.arbitrated_routes(routed, public.public_top_k(records(spark, rows), routed, 1))
    got = {r["qid"]: (r["about_identifiers"], r["decides"], r["confidence"], r["arbitrated_route"], r["overrode"]) for r in done.collect()}
    assert got == {1: (True, True, 1.0, "bm25", True), 2: (False, True, 0.5, "dense", False), 3: (True, True, 0.5, "bm25", True), 4: (True, False, 0.0, "kg", False), 5: (False, False, 0.0, "dense", False), 6: (True, True, 1.0, "bm25", False)}
    effect = {r["family"]: tuple(r)[1:] for r in public.arbitration_effect(done).collect()}
    assert effect["all"] == (6, round(4 / 6, 6), round(4 / 6, 6), 2, 1, 1) and effect["relational"] == (1, 0.0, 1.0, 1, 1, 0)


def test_empty_tables(spark):
    none, asked = records(spark, []), spark.createDataFrame(ASKED, "qid long, question string")
    assert public.public_boosts(none, asked).collect() == [] and public.public_top_k(none, asked, 3).collect() == []
    assert public.public_top_k(records(spark, ROWS), asked.limit(0), 3).collect() == []
