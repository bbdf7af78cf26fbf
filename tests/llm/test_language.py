import zlib

import pytest
from quillroute.llm import language as L
from pyspark.sql import functions as F

TEXTS = {"en": "the cat sat on the mat and the dog ran away with it", "de": "der hund und die katze sind nicht im haus gewesen", "fr": "le chat est dans la maison avec les enfants et une souris"}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")


def test_predicts_and_holds_out(spark):
    rows = [(i, TEXTS[k], k, "x", "y") for i, k in enumerate(["en", "de", "fr"] * 20)]
    out = L.language_predictions(table(spark, rows)).collect()
    assert len(out) == 60
    want = {r[0]: r[2] for r in rows}
    for r in out:
        assert r["lang_pred"] == want[r["doc_id"]] and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_edges(spark):
    rows = [(i, TEXTS[k], k, None, None) for i, k in enumerate(["en", "de"] * 10)]
    rows += [(100, None, "en", None, None), (101, "", "en", None, None), (102, "123 !!", None, None, None), (103, TEXTS["en"] * 4000, None, None, None), (None, TEXTS["de"], "de", None, None), (103, TEXTS["de"], None, None, None)]
    out = L.language_predictions(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (100, 101, 102))
    assert sorted(r["lang_pred"] for r in by[103]) == ["de", "en"]
    assert by[None][0]["held_out"] is False and by[None][0]["lang_pred"] == "de"


def test_nothing_to_learn_from(spark):
    assert L.language_predictions(table(spark, [])).count() == 0
    out = L.language_predictions(table(spark, [(1, "hello", None, None, None)])).collect()
    assert out[0]["lang_pred"] == "und"


def test_scores_equal_a_plain_count(spark):
    """The batch scoring against a loop over the n-grams of each text."""
    rows = [(i, TEXTS[k], k, None, None) for i, k in enumerate(["en", "de", "fr"] * 8)]
    m = L.train(table(spark, rows), F.lit(True))
    for text in ["das ist ein haus", "a b", "été là", "x"]:
        x, _ = L.code_points([text])
        logp = m.log_prior.copy()
        for _, h, ok in L.grams(x, m.params.orders, m.params.bits):
            for b, use in zip(h, ok):
                if use:
                    logp = logp + m.log_prob[b]
        pred, _ = L.predict([text, "zzz", text], m)
        assert pred[0] == pred[2] == m.languages[int(logp.argmax())]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    out = L.language_predictions(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() / out.count() > 0.97


def test_many_languages_fold_buckets(spark, docs_of):
    """Far more labels than usual: no failure, and a matrix of bounded size."""
    texts = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30) for i in range(300)]
    docs = docs_of(texts).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    model = L.train(docs, F.lit(True), L.LanguageParams(entry_bits=18))
    assert len(model.languages) == 300 and model.log_prob.size <= 1 << 18
    pred, _ = L.predict([t for _, t in texts], model)
    assert sum(p == f"l{i}" for i, p in enumerate(pred)) > 200
