import random

from quillroute.operators import lexical, pruned, resident
from quillroute.sources import files
from quillroute.sources.shared import written


def corpus(spark, seed=1, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, f"t{i % 5}", " ".join(r.choices(words, weights, k=r.randrange(0, 60)))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", ""), (n + 2, "w250 w250", "w0 w1"), (n + 3, "w250 w250", "w0 w1")]
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def asked(spark):
    texts = ["w0 w1 w40 w90", "w250 w0 w0", "w0", "unheard of", None, "", "w3 w120 w121 w122 w1 w2 w0 w299", "t3"]
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_same_as_scoring_every_match(spark, tmp_path):
    """Also from saved tables, with blocks and runs so short that tokens have several, and without broadcasts."""
    c, q = corpus(spark), asked(spark)
    scored = lexical.bm25_scores(c, q).collect()
    want = sorted(map(tuple, lexical.top_k(lexical.bm25_scores(c, q), 3).select("qid", "doc_id", "score", "rank").collect()))
    files.save_index(pruned.lexical_index(c, block=4, run=50), str(tmp_path))
    index = files.load_index(spark, str(tmp_path), pruned.TABLES)
    assert index["postings"].filter("part_no > 1 and block > 2").count() > 0
    for most in (200_000, 0):
        got = sorted(map(tuple, pruned.pruned_top_k(index, q, 3, broadcast_up_to=most).select("qid", "doc_id", "score", "rank").collect()))
        assert got == want
    tried = pruned.candidates(index, q, 3).count()
    assert tried < 0.25 * len(scored)


def test_postings_are_made_where_documents_lie(spark):
    """Runs hold every posting once, in descending order, whatever the length of runs; the plan has no shuffle."""
    c = corpus(spark, n=120)
    counts = written(resident.document_counts(c))
    want = sorted((t, r["doc_id"]) for r in counts.collect() for t in r["tokens"])
    for run, most in ((65_536, 4_000_000), (7, 4_000_000), (65_536, 50)):
        made = pruned._postings(counts, 30.0, 4, run, lexical.K1, lexical.B, most)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        rows = made.collect()
        assert sorted((r["token"], x["doc_id"]) for r in rows for x in r["items"]) == want
        assert all(r["n"] == len(r["items"]) <= 4 and r["most"] == max(x["part"] for x in r["items"]) for r in rows)
        last = {(r["token"], r["part_no"], r["block"]): min(x["part"] for x in r["items"]) for r in rows}
        assert len(last) == len(rows) and all(r["most"] <= last.get((r["token"], r["part_no"], r["block"] - 1), 9e9) for r in rows)


def test_empty(spark):
    index = pruned.lexical_index(corpus(spark).limit(0))
    assert pruned.pruned_top_k(index, asked(spark), 3).collect() == []
    assert pruned.pruned_top_k(pruned.lexical_index(corpus(spark, n=5)), asked(spark).limit(0), 3).collect() == []


def test_variants_share_one_scan(spark):
    c, q = corpus(spark), asked(spark)
    features = lexical.bm25_features(c, q)
    variants = {"plain": (0.0, 0.0), "boosted": (5.0, 0.05)}
    got = {v: sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in lexical.variant_top_k(features, variants, 3).collect() if r["variant"] == v) for v in variants}
    rows = lambda d: sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in lexical.top_k(d, 3).collect())
    assert got["plain"] == rows(lexical.bm25_scores(c, q)) and got["boosted"] == rows(lexical.bm25_with_boosts(c, q)) != got["plain"]


def test_variants_by_split(spark):
    from quillroute.operators.evaluation import variants_by_split

    ranked = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 2, 12, 1), ("b", 1, 11, 1), ("b", 2, 13, 3)], "variant string, qid int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, "dev", 11), (1, "dev", 10), (2, "test", 13), (3, "test", 99)], "qid int, split string, doc_id int")
    got = {(r["variant"], r["split"]): (r["n"], r["top1"], r["hit_rate"]) for r in variants_by_split(ranked, gold).collect()}
    assert got == {("a", "dev"): (1, 1.0, 1.0), ("a", "test"): (2, 0.0, 0.0), ("b", "dev"): (1, 1.0, 1.0), ("b", "test"): (2, 0.0, 0.5)}
