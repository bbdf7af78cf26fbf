import pytest

from quillroute.operators import evaluation as E

FOUND = "qid string, backend string, rank int, final_rank int, applied boolean, item_id string, ids array<string>, content string"
ROUTES = "qid string, system string, route string, override boolean, rescue boolean"


@pytest.fixture()
def items(spark):
    sources = {
        "curated": spark.createDataFrame([("lexical", 1, "Q one", "bm25", "forty two", ["d1", "d9"])], "slice string, id int, query string, gold_route string, gold_answer string, gold_evidence_ids array<string>"),
        "adversarial": spark.createDataFrame([("a1", "Q two", "dev", "kg", "owls", [], ["t7"], "", ["bait", "hard"])], "id string, query string, split string, intended_route_family string, gold_answer string, gold_source_doc_ids array<string>, gold_triple_ids array<string>, gold_evidence_text string, ambiguity_tags array<string>"),
        "external": spark.createDataFrame([("e1", "Q three", "dense", "alpha beta gamma", "")], "id string, query string, route_family string, gold_answer string, gold_evidence_text string"),
        "generalization": spark.createDataFrame([("g1", "Q four", "test", "hybrid", "x", "one two three four", "")], "id string, query string, split string, route_family string, gold_answer string, gold_evidence_text string, tag string"),
        "public": spark.createDataFrame([("p1", None, "test", "bm25", None, None, "one two three four")], "id string, query string, split string, route_family string, gold_answer string, gold_source_doc_ids array<string>, gold_evidence_text string"),
    }
    return E.eval_items(sources)


def test_five_schemas_become_one(items):
    got = {r["dataset"]: r for r in items.collect()}
    assert got["curated"]["qid"] == "curated_lexical_1" and got["curated"]["split"] == "all" and got["curated"]["tags"] is None
    assert got["adversarial"]["gold_ids"] == ["t7"] and got["adversarial"]["tags"] == ["bait", "hard"]
    assert got["external"]["gold_ids"] is None and got["generalization"]["tags"] is None and got["public"]["question"] is None


def test_hits_depth_overrides_and_rescues(spark, items):
    c = "curated_lexical_1"
    found = [(c, "bm25", i, (i % 4) + 1, True, f"d{i + 6}", [f"x{i}"], "answer is forty-two" if i == 3 else "nothing") for i in range(1, 5)]
    found += [(c, "hybrid", i, i, False, f"h{i}", None, "y") for i in range(1, 6)] + [("a1", "kg", 1, 1, False, "path:t7->t8", ["t7", "t8"], "owl is_a bird"), ("e1", "dense", 1, 1, False, "z", None, "Beta!"), ("g1", "hybrid", 1, 1, False, "z", None, "three four"), ("p1", "bm25", 1, 1, False, "z", None, "two four five"), ("p1", "dense", 1, 1, False, "z", None, "two")]
    routes = [(c, "base", "bm25", False, False), (c, "rescued", "bm25", True, True), (c, "fused", "hybrid", False, False), (c, "none", "kg", False, True)]
    routes += [(q, "base", r, False, False) for q, r in (("a1", "kg"), ("e1", "dense"), ("g1", "hybrid"), ("p1", "bm25"))] + [("p1", "other", "dense", True, False)]
    judged = E.judged_records(items, spark.createDataFrame(routes, ROUTES), spark.createDataFrame(found, FOUND))
    got = {(r["dataset"], r["system"]): r for r in judged.collect()}
    base, rescued, none = (got["curated", s] for s in ("base", "rescued", "none"))
    assert base["retrieved"] == 3 and got["curated", "fused"]["retrieved"] == 5 and none["retrieved"] == 0
    # d9 is third: among the first three, not the first
    assert base["evidence_ok"] and not base["top1_ok"] and base["route_ok"] and not base["answer_ok"]
    # a re-ranking moves the three retrieved items only
    assert rescued["evidence_ok"] and rescued["rescued"] and not none["rescued"] and not none["evidence_ok"]
    assert got["adversarial", "base"]["top1_ok"]
    # shares of gold tokens: 1/3 < 0.35, 2/4 >= 0.35, 2/4 >= 0.5, 1/4 < 0.5
    assert [got[d, s]["evidence_ok"] for d, s in (("external", "base"), ("generalization", "base"), ("public", "base"), ("public", "other"))] == [False, True, True, False]
    table = {(r["system"], r["dataset"], r["scope"], r["value"]): r for r in E.evaluate_records(judged).collect()}
    assert table["base", "adversarial", "tag", "bait"]["evidence_accuracy"] == table["base", "adversarial", "all", "all"]["evidence_accuracy"] == 1.0
    assert table["rescued", "curated", "family", "bm25"]["overrides"] == 1 == table["rescued", "curated", "all", "all"]["rescues"]
    assert not any(k[2] == "tag" and k[1] != "adversarial" for k in table)
