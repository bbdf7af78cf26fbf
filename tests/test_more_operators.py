from pyspark.sql import functions as F

from quillroute.functions import signals as S
from quillroute.functions import text as X
from quillroute.operators import asking, diagnostics, fusion, graph, learning, lexical, metrics, routing


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_field_boosts(spark):
    fields = spark.createDataFrame([(1, "HIPAA rule", ["HIPAA 164.512"], ["privacy rule", "abc"]), (2, "Other page", [], [])], "doc_id long, title string, ids array<string>, aliases array<string>")
    got = lexical.field_boosts(fields, ask(spark, "what does HIPAA 164.512 say, the privacy rule"))
    r = got.collect()
    assert [(x["doc_id"], x["n_ids"], x["n_aliases"], x["title_hit"], x["boost"]) for x in r] == [(1, 1, 1, True, 15.0)]
    c = lexical.lexical_confidence(got).first()
    assert c["confidence"] == 1.0 and c["arbitrate"]


def test_forms_and_ids(spark):
    aliases = {"bat": "bat", "flight": "fly"}
    f = lambda t: one(spark, X.entity_form(F.lit(t), aliases, (" class",)))
    assert [f("The Bats"), f("flight"), f("bat class"), f("big cat")] == ["bat", "fly", "bat", "big_cat"]
    ids = one(spark, X.evidence_ids(F.lit("a"), F.create_map(F.lit("component_ids"), F.lit("b,c"), F.lit("path_id"), F.lit("a"))))
    assert ids == ["a", "b", "c"]
    assert one(spark, X.provenance(F.lit("xkg_1"))) == "extracted"
    assert one(spark, S.first_listed(F.lit("Are birds mammals?"), {"mammal": "m", "bird": "b"})) == "m"
    assert one(spark, S.choice(F.lit(" TIE "))) == "Tie" and one(spark, S.choice(F.lit("c"))) is None
    assert one(spark, S.rating(F.lit("9"))) == 0 and one(spark, S.rating(F.lit("x"))) == 0
    assert one(spark, S.unknown_tags(F.array(F.lit("a"), F.lit("z")), ("a",))) == ["z"]
    assert one(spark, S.source_flags(F.lit("public:rfc"))["source_formal_spec"])


def test_replies_and_tuning(spark):
    reply = lambda t: one(spark, routing.parse_reply(F.lit(t), F.lit("dense")))
    assert [reply('sure: {"route": "KG"} ok'), reply('{"route": "x"}'), reply("no json")] == ["kg", "dense", "dense"]
    d = spark.createDataFrame([("b", "x", "x", True), ("a", "x", "x", False), ("c", "y", "x", False)], "config string, route string, gold string, changed boolean")
    assert routing.tune(d, "config", "route", "gold", "changed").first()["config"] == "a"
    assert one(spark, routing.seeded_route(F.lit(5), 1)) in routing.BACKENDS


FACTS = [("t1", "bat", "is_a", "mammal", "d"), ("t2", "mammal", "is_a", "vertebrate", "d"), ("t3", "bat", "has_property", "echolocation", "d")]


def test_graph_questions(spark):
    e = spark.createDataFrame(FACTS, "triple_id string, subject string, predicate string, object string, source string")
    qs = ask(spark, "Is a bat a mammal?", "what path links bat and vertebrate", "What property has bat?", "anything about echolocation sounds")
    got = {}
    for r in asking.graph_retrieve(qs, e).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["branch"], r["item_id"]))
    assert got[0] == [("membership", "t1")] and got[1] == [("path", "path:t1->t2")]
    assert [i for _, i in got[2]] == ["t3"] and got[3] == [("lexical", "t3")]


def test_local_graph_stops_early(spark):
    rows = [(1, 0, 0, 0, "a", "is_a", "b.", 0.8, "p"), (1, 0, 0, 1, "a", "is_a", "b", 0.8, "p"), (2, 0, 0, 0, "x", "is_a", "x", 0.8, "p"), (3, 0, 0, 0, "c", "is_a", "d", 0.8, "p"), (4, 0, 0, 0, "e", "is_a", "f", 0.8, "p")]
    d = spark.createDataFrame(rows, "doc_id long, sentence_no int, pattern_no int, match_no int, subject string, predicate string, object string, confidence double, pattern string")
    assert [r["triple_id"] for r in graph.local_graph(d, 2).orderBy("triple_id").collect()] == ["qlg_0000_1", "qlg_0001_3"]


def test_router_learns(spark):
    rows = [(i, f"find the exact code rfc {i}", "bm25") for i in range(12)] + [(100 + i, f"what bridge connects place {i}", "hybrid") for i in range(12)]
    d = spark.createDataFrame(rows, "qid long, question string, gold string")
    out = learning.out_of_fold(d, k=3)
    assert out.count() == 24 and out.filter("predicted = gold").count() >= 22
    p = learning.predict_routes(learning.fit_text_router(d), d.limit(2)).first()
    assert abs(sum(p[f"p_{b}"] for b in routing.BACKENDS) - 1) < 1e-6 and p["p_kg"] == 0.0


def test_diagnostics_and_hits(spark):
    e = spark.createDataFrame([(1, "red fox", "a", 1, "red fox runs", "t", 3.0), (1, "red fox", "b", 2, "blue sky", "t", 1.0)], "qid long, question string, item_id string, rank int, content string, title string, score double")
    r = diagnostics.evidence_diagnostics(e).first()
    assert r["top1_score"] == 0.75 and r["top1_top2_gap"] == 0.25 and r["query_overlap_top1"] == 1.0 and r["redundancy"] == 0.0
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, metrics.token_hit(a("x", "y"), a("x"), a("i"), a("g")))
    assert not one(spark, metrics.token_hit(a("x", "y", "z"), a("x"), a("i"), a("g")))
    assert one(spark, metrics.all_gold(a("g", "h"), a("g")))


def test_hybrid_adds_bundles_for_relational_questions(spark):
    ranked = spark.createDataFrame([(1, "bm25", "a", 1), (2, "bm25", "a", 1)], "qid long, backend string, item_id string, rank int")
    bundles = spark.createDataFrame([(1, "k", "a", 0.08), (2, "k", "a", 0.08)], "qid long, graph_id string, text_id string, score double")
    got = fusion.hybrid_retrieve(ranked, bundles, spark.createDataFrame([(1,)], "qid long"), 1).orderBy("qid").collect()
    assert [r["item_id"] for r in got] == ["k+a", "a"]


def test_first_two_raters_and_preferences(spark):
    from quillroute.operators import annotation

    rated = spark.createDataFrame([(1, 5, 3), (1, 2, 2), (1, 9, 1), (2, 1, 3), (3, 1, 0), (3, 2, 2), (4, 1, None), (4, 2, 1)], "item int, at int, score int")
    assert [tuple(r) for r in annotation.first_two_raters(rated, "item", "at", "score").collect()] == [(1, 2, 3)]
    votes = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "B"), (2, "A"), (3, "Tie"), (4, "A")], "item int, choice string")
    pairs = spark.createDataFrame([(1, "kg", "bm25"), (2, "kg", "bm25"), (3, "kg", "bm25"), (4, "kg", "bm25"), (5, "kg", "bm25")], "item int, route_a string, route_b string")
    won = annotation.preferred_routes(votes, pairs, "item", "choice")
    assert sorted((r["item"], r["preferred"]) for r in won.collect()) == [(2, "bm25"), (4, "kg")]
    assert tuple(annotation.human_alignment(won, "route_a", "route_b").first()) == (2, 0.5, 0.5, 0.0, 1)
    assert tuple(annotation.human_alignment(won.filter("false"), "route_a", "route_b").first()) == (0, 0.0, 0.0, 0.0, 0)


def test_comparison_tag_order(spark):
    from pyspark.sql import functions as F

    from quillroute.operators.annotation import comparison_tag

    rows = [(False, True, "a", "b", 0.0), (True, False, "a", "b", 0.0), (True, True, "a", "b", 0.0), (True, True, "a", "a", 0.15), (False, False, "a", "a", 0.2)]
    d = spark.createDataFrame(rows, "x boolean, y boolean, a string, b string, m double")
    tags = [r[0] for r in d.select(comparison_tag(*(F.col(c) for c in "xyabm"))).collect()]
    assert tags == ["computed_miss_system_b_hit", "computed_hit_system_b_miss", "route_disagreement", "computed_low_confidence", "trace_evidence_audit"]


def test_beats_and_whole_gold(spark):
    from quillroute.operators import metrics

    ranked = spark.createDataFrame([(1, "kg", "x", 1), (1, "bm25", "y", 1), (2, "kg", "y", 1), (2, "kg", "x", 2), (2, "bm25", "x", 1)], "qid int, backend string, item_id string, rank int")
    gold = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "x")], "qid int, item_id string")
    (r,) = metrics.beats(metrics.first_hits(ranked, gold), "kg", ("bm25",)).collect()
    assert tuple(r) == ("bm25", 2, 2, 1, 1, 1)
    items = spark.createDataFrame([(1, "kg", 1, ["x"]), (1, "kg", 2, ["x", "y", "z"]), (1, "bm25", 1, ["y"])], "qid int, backend string, rank int, ids array<string>")
    whole = metrics.first_whole_hits(items, spark.createDataFrame([(1, ["x", "y"])], "qid int, gold array<string>"))
    assert {x["backend"]: x["first_hit"] for x in whole.collect()} == {"kg": 2, "bm25": None}


def test_classifier_override_bounds(spark):
    from pyspark.sql import functions as F

    from quillroute.operators import routing

    cols = "calibrated_route string, classifier string, p double, confidence string, misleading_exact_cue boolean, explicit_kg_negation boolean, identifier_heavy boolean, semantic_cue boolean, relational_cue boolean"
    hard, none = (True, False, False, False, False), (False,) * 5
    rows = [("bm25", "dense", 0.6, "low", *hard), ("bm25", "dense", 0.6, "high", *hard), ("bm25", "dense", 0.6, "low", *none), ("bm25", "dense", 0.41, "low", *hard), ("bm25", "dense", None, "low", *hard), ("bm25", "dense", 0.6, "low", False, False, True, True, False)]
    d = routing.classifier_override(spark.createDataFrame(rows, cols), "classifier", {"dense": F.col("p"), "bm25": F.lit(0.1)})
    assert [r["final_route"] for r in d.collect()] == ["dense", "bm25", "bm25", "bm25", "bm25", "dense"]


def test_facts_by_shared_words_make_no_pairs(spark):
    """The best facts of questions that fall back are those of all pairs, and no question and fact is aggregated in a shuffle."""
    from quillroute.operators import asking, lexical

    rows = [(f"kg_c{i}_is_a_n{i % 7}", f"c{i}", "is_a", f"n{i % 7}", "t") for i in range(300)] + [("kg_p1_has_property_Brand#12", "p1", "has_property", "Brand#12", "t")]
    e = spark.createDataFrame(rows, "triple_id string, subject string, predicate string, object string, source string")
    texts = ["what is a thing", "who is n3 and is n3 a brand", "no common term", None, "", "has 12 a property"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, question string")
    key = lambda d: sorted(tuple(r[c] for c in ("qid", "item_id", "score", "rank")) for r in d.collect())
    got = asking.best_lexical_facts(q, e, 4)
    assert key(got) == key(lexical.top_k(asking.lexical_facts(q, e), 4, item="item_id")) != []
    answered = asking.graph_retrieve(q, e, 4)
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert "hits#" not in plan and "count(1)" not in plan
    assert {(r["qid"], r["mode"]) for r in answered.collect()} >= {(0, "fallback")}
