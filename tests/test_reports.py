from quillroute.operators import evaluation

JUDGED = "dataset string, qid string, family string, system string, route string, route_ok boolean, evidence_ok boolean, top1_ok boolean, answer_ok boolean, rescued boolean"
MARGINS = "qid string, system string, margin double, route_part double, evidence_part double"
ROWS = [
    ("a", "1", "kg", "s", "kg", True, True, True, True, False),
    ("a", "2", "kg", "s", "bm25", False, True, False, False, True),
    ("a", "3", "bm25", "s", "bm25", True, False, False, False, False),
    ("b", "4", "bm25", "s", "dense", False, False, False, False, False),
    ("a", "1", "kg", "t", "kg", True, True, True, True, False),
    ("a", "2", "kg", "t", "kg", True, True, True, True, False),
]


def reports(spark):
    margins = [("1", "s", 0.2, 0.5, None), ("2", "s", 0.35, 0.1, 0.3), ("3", "s", None, None, None), ("1", "t", 0.9, None, None), ("77", "t", 0.1, 9.0, 9.0)]
    return evaluation.system_reports(spark.createDataFrame(ROWS, JUDGED), spark.createDataFrame(margins, MARGINS))


def test_report_of_a_system(spark):
    got = {(r["system"], r["dataset"]): r for r in reports(spark).collect()}
    assert set(got) == {("s", "a"), ("s", "b"), ("t", "a")}
    r = got["s", "a"]
    assert (r["n"], r["route_accuracy"], r["evidence_accuracy"], r["top1_accuracy"], r["answer_accuracy"]) == (3, 0.666667, 0.666667, 0.333333, 0.333333)
    # a margin of exactly the bound is not low; nulls have no part in the means
    assert (r["gaps"], r["rescues"], r["low_margins"], r["mean_margin"], r["mean_route_part"], r["mean_evidence_part"]) == (1, 1, 1, 0.275, 0.3, 0.3)
    assert (r["chose_bm25"], r["chose_dense"], r["chose_kg"], r["chose_hybrid"]) == (2, 0, 1, 0)
    assert r["confusion"] == "bm25->bm25=1 kg->bm25=1 kg->kg=1"
    assert (got["s", "b"]["low_margins"], got["s", "b"]["mean_margin"]) == (0, 0.0) and got["t", "a"]["mean_route_part"] == 0.0


def test_thresholds(spark):
    got = {r["system"]: (r["n"], r["failed"], r["passed"]) for r in evaluation.passed(reports(spark), {"route_accuracy": 0.5, "answer_accuracy": 0.3, "evidence_accuracy": 0.9}).collect()}
    assert got == {"s": (4, "answer_accuracy,evidence_accuracy", False), "t": (2, "", True)}


def test_recommendation(spark):
    got = {r["dataset"]: (r["base"], r["other"], r["delta"], r["recommended"]) for r in evaluation.recommendation(reports(spark), "s", "t").collect()}
    assert got == {"a": (0.333333, 1.0, 0.666667, "test_further"), "b": (0.0, None, None, "keep")}
    same = evaluation.recommendation(reports(spark), "t", "t").collect()
    assert [(r["delta"], r["recommended"]) for r in same] == [(0.0, "keep")]


def test_structure_items_and_shift(spark):
    items = [("curated", "1", "q", "all", "kg", "g", ["d1"], None, ["x"]), ("generalization", "2", "q", "dev", "hybrid", "g", ["d2"], "t", ["x"]), ("curated", "3", "q", "all", "bm25", "g", [], None, None), ("public", "4", "q", "all", "kg", "g", [], None, None)]
    got = {r["qid"]: (r["dataset"], r["gold_ids"], r["tags"]) for r in evaluation.structure_items(spark.createDataFrame(items, evaluation.ITEM)).collect()}
    assert got == {"1": ("curated_deductive", ["d1"], None), "2": ("generalization_relational", [], None)}
    judged = [(d, "1", "kg", "s", "kg", ok, True, True, ok, False) for d, ok in (("curated_deductive", True), ("curated_deductive", True), ("generalization_deductive", True), ("generalization_deductive", False), ("curated_relational", False))]
    shift = {r["kind"]: r for r in evaluation.structure_shift(spark.createDataFrame(judged, JUDGED)).collect()}
    r = shift["deductive"]
    assert (r["n_curated"], r["n_shifted"], r["route_curated"], r["route_shifted"], r["route_loss"], r["evidence_loss"], r["answer_loss"]) == (2, 2, 1.0, 0.5, 0.5, 0.0, 0.5)
    assert shift["relational"]["route_shifted"] is None and shift["relational"]["route_loss"] is None


def test_empty(spark):
    none = evaluation.system_reports(spark.createDataFrame([], JUDGED), spark.createDataFrame([], MARGINS))
    assert none.collect() == [] and evaluation.passed(none, {"route_accuracy": 0.5}).collect() == [] and evaluation.recommendation(none, "s", "t").collect() == []
