import re
from collections import defaultdict

import corpus_pipeline
from quillroute.llm import queries


def test_stages_work_on_what_came_before(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name in ("quality_rules", "toxicity"):
            assert docs.exceptAll(before).isEmpty()
        if name == "line_dedup":
            assert counts[-1] == counts[-2]
        if name == "near_dedup":
            assert docs.exceptAll(before).isEmpty() and counts[-1] <= counts[-2]
    kept = {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    fill = defaultdict(int)
    for r in docs.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))


def through(spark, docs, sf_dir, folder):
    """The rows after each stage, each stage's written and read again."""
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = after[name] = spark.read.parquet(str(folder / name))
    return after


def test_nulls_repeats_and_clashing_names(spark, tmp_path, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = " ".join(f"word{i} of a calm and ordinary report" for i in range(40))
    long = "\n".join(f"line {i} tells of thing {i * i} in place {i * 7}" for i in range(3000))
    rows = [(None, None, None, None, None), (900001, None, "en", None, None), (900002, "", None, "s", 0), (900003, " \n\n ", "en", "s", 4),
            (900004, clean, "en", "s", None), (900004, clean, "en", "s", None), (900005, clean, None, None, 9), (None, clean, "en", "s", 1), (900006, long, "en", "s", None)]
    docs = given.unionByName(spark.createDataFrame(rows, given.schema))
    docs = docs.selectExpr("*", "1 as row", "true as kept", "'x' as line_gone", "array(2) as words", "3.5 as score", "doc_id as component_id", "4 as piece", "'y' as labels")
    after = through(spark, docs, sf_dir, tmp_path)
    for name in list(after)[:4]:
        assert after[name].columns == docs.columns, name
    copies = after["toxicity"].filter(f"text = '{clean}'").count()
    assert copies in (0, 4)  # equal texts share one verdict, whatever their ids
    if copies:
        assert after["near_dedup"].filter("text like 'word0 of%'").count() == 1
    short = after["quality_rules"].filter("text is null or trim(text) = ''")
    assert short.isEmpty()  # fewer than 50 words fail the base rules
    assert after["best_fit_packing"].select("doc_id").distinct().count() == after["near_dedup"].select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    after = through(spark, docs, sf_dir, tmp_path)
    assert all(rows.isEmpty() for rows in after.values())
    assert after["near_dedup"].columns == docs.columns
