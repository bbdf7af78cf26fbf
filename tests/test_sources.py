import json

import pytest
from pyspark.sql import functions as F

from quillroute.sources import files as S


def test_jsonl_round_trip_and_strictness(spark, tmp_path):
    d = spark.createDataFrame([("a", "t", "x", "s")], S.DOCUMENT)
    S.write_jsonl(d, str(tmp_path / "d"))
    assert S.read_documents(spark, str(tmp_path / "d")).collect() == d.collect()
    (tmp_path / "bad.jsonl").write_text(json.dumps({"doc_id": "a", "title": "t", "text": "x"}) + "\n")
    with pytest.raises(Exception, match="missing field: source"):
        S.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "my_note.txt").write_text("# Title\nsome text")
    (tmp_path / "sub" / "page.html").write_text("<p>hello &amp; bye</p>")
    (tmp_path / "data.json").write_text('{"a": 1, "b": "two"}')
    (tmp_path / "skip.bin").write_text("no")
    got = {r["title"]: r for r in S.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"My Note", "Page", "Data"}
    assert got["Page"]["text"] == "hello & bye" and got["Data"]["text"] == "a: 1 b: two" and got["My Note"]["sections"] == ["Title"]


def test_headed_text_graph_and_model(spark, tmp_path):
    (tmp_path / "a.txt").write_text('META {"id": "x"}\nbody\nmore')
    (tmp_path / "b.txt").write_text("plain")
    got = {r["file"]: (r["meta"], r["body"]) for r in S.read_headed_text(spark, str(tmp_path / "*.txt"), "META ").collect()}
    assert got == {"a.txt": ({"id": "x"}, "body\nmore"), "b.txt": ({}, "plain")}
    e = spark.createDataFrame([("t", "a b", "is-a", "c", "s")], "triple_id string, subject string, predicate string, object string, source string")
    S.write_turtle(e, str(tmp_path / "g"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert "ex:a_b ex:is_a ex:c ." in lines and any(x.startswith("@prefix") for x in lines)
    w = spark.createDataFrame([("bm25", "x", 0.5)], S.MODEL)
    S.save_model(w, str(tmp_path / "m"))
    assert S.load_model(spark, str(tmp_path / "m")).collect() == w.collect()
    S.save_index({"w": w}, str(tmp_path / "i"))
    assert S.load_index(spark, str(tmp_path / "i"), ("w",))["w"].collect() == w.collect()


def test_generated_documents_and_union(spark):
    a = S.filler_documents(spark, 5, ("x", "y"))
    assert [r["doc_id"] for r in S.union_sorted(a, a.withColumn("doc_id", F.concat(F.lit("a"), "doc_id"))).collect()][:1] == ["afiller_000"]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    from quillroute.streaming import router

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    router.stream_route_counts(spark, str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got = {(r["window_start"], r["route"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["route"]): r["n"] for r in router.route_counts(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())  # windows behind the watermark are out
