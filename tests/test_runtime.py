from quillroute.operators import lexical, runtime
from quillroute.sources import files

DOCS = "doc_id long, title string, text string"


def test_counts_after_an_upsert_equal_a_full_rebuild(spark, tmp_path):
    before = spark.createDataFrame([(1, "a", "bats fly at night"), (2, "b", "owls fly"), (3, "c", ""), (4, None, None), (5, "e", "rfc-7231 section 6"), (6, "f", "gone soon")], DOCS)
    changes = spark.createDataFrame([(2, "b", "first", 1), (2, "b", "owls fly and swim at night", 3), (2, "b", "second", 2), (3, "c", "now with bats", 1), (6, "f", None, 1), (9, "new", "bats and rfc-7231", 1), (10, "x", None, 1), (5, "e", "", 7)], DOCS + ", position int")
    after = runtime.upserted(before, changes, "position")
    assert {(r["doc_id"], r["text"]) for r in after.collect()} == {(1, "bats fly at night"), (2, "owls fly and swim at night"), (3, "now with bats"), (4, None), (5, ""), (9, "bats and rfc-7231")}
    files.save_index(runtime.counted(before), str(tmp_path))
    saved = files.load_index(spark, str(tmp_path), runtime.TABLES)
    want = runtime.counted(after)
    rows = lambda d: sorted(map(tuple, d.collect()))
    asked = spark.createDataFrame([(1, "bats at night"), (2, "rfc 7231 owls"), (3, "gone")], "qid long, question string")
    for many in (200_000, 1):
        got = runtime.recounted(saved, before, changes, "position", many)
        for name in runtime.TABLES:
            assert rows(got[name].select(*want[name].columns)) == rows(want[name]), name
    assert rows(runtime.counted_scores(got, asked)) == rows(lexical.bm25_scores(after, asked)) != []


def test_no_changes_and_no_corpus(spark):
    none = spark.createDataFrame([], DOCS)
    changes = spark.createDataFrame([(1, "a", "x y", 1)], DOCS + ", position int")
    assert runtime.upserted(none, changes, "position").collect()[0]["text"] == "x y"
    got = runtime.recounted(runtime.counted(none), none, changes, "position")
    assert got["stats"].first()["n"] == 1 and got["df"].count() == 3
    assert runtime.recounted(runtime.counted(none), none, changes.limit(0), "position")["df"].collect() == []


def test_counts_stay_with_their_documents(spark):
    """A document's counts are one row that no shuffle makes, and rankings come from the counts as from all pairs."""
    docs = spark.createDataFrame([(1, "a", "co-op coop RFC 7231 section 6 a.b a_b"), (2, None, None), (3, "", "- -- bats bats"), (4, "d", "bats at night rfc-7231")], DOCS)
    counts = runtime.counted(docs)
    got = {r["doc_id"]: dict(zip(r["tokens"], r["tfs"])) for r in counts["tf"].collect()}
    want = {i: {} for i in got}
    for r in lexical.term_frequencies(lexical.tokenized(docs, runtime.lexical_tokens(runtime.F.concat_ws(" ", "title", "text"))), "doc_id").collect():
        want[r["doc_id"]][r["token"]] = r["tf"]
    assert got == want and got[1]["coop"] == 2 and got[2] == {}
    changes = spark.createDataFrame([(2, "b", "bats at section 6", 1), (1, "a", None, 1)], DOCS + ", position int")
    plan = runtime.recounted(counts, docs, changes, "position")["tf"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    after = runtime.recounted(counts, docs, changes, "position")
    asked = spark.createDataFrame([(1, "bats at night"), (2, "rfc 7231 section 6"), (3, "unknown"), (4, None)], "qid long, question string")
    rows = lambda d: sorted(tuple(r[c] for c in ("qid", "doc_id", "score", "rank")) for r in d.collect())
    assert rows(runtime.counted_top_k(after, asked, 2)) == rows(lexical.top_k(runtime.counted_scores(after, asked), 2)) != []
