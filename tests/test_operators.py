import pytest
from pyspark.sql import functions as F

from quillroute.operators import asking, dense, fusion, graph, lexical, metrics, routing


def rows(df, *c):
    return sorted(tuple(r[x] for x in c) for r in df.collect())


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


@pytest.mark.parametrize("text,route", [("find RFC-7231 exact", "bm25"), ("what feels like rest", "dense"), ("Is a bat a mammal?", "kg"), ("what bridge connects bat and vertebrate", "hybrid"), ("lorem ipsum", "dense"), ("every path between classes", "kg")])
def test_routes(spark, text, route):
    assert routing.penalty_routes(ask(spark, text)).first()["route"] == route


def test_truth_table_ties(spark):
    r = routing.penalty_routes(ask(spark, "exact code and every class")).first()
    assert r["route"] == "bm25" and r["margin"] == 0.0 and r["score_kg"] == 0.4


def test_keyword_and_rules(spark):
    k = routing.keyword_routes(ask(spark, "find rfc", "bridge is a x", "nothing here")).orderBy("qid").collect()
    assert [r["keyword_route"] for r in k] == ["bm25", "hybrid", "dense"]
    assert abs(sum(k[1][f"keyword_{b}"] for b in routing.BACKENDS) - 1) < 1e-5
    v = routing.rule_routes_v2(routing.penalty_routes(ask(spark, "what path links", "is a thing", "not rfc-7231 really", "version 2.15 feels like a metaphor"))).orderBy("qid")
    assert [r["route_v2"] for r in v.collect()] == ["hybrid", "kg", "bm25", "dense"]


def test_bm25_prefers_the_exact_identifier(spark):
    c = spark.createDataFrame([(1, "HIPAA 164.510", "rule about directories"), (2, "HIPAA 164.512", "rule about disclosures"), (3, "other", "HIPAA rule text")], "doc_id long, title string, text string")
    top = lexical.top_k(lexical.bm25_with_boosts(c, ask(spark, "HIPAA 164.512")), 2).orderBy("rank").collect()
    assert top[0]["doc_id"] == 2 and top[0]["score"] > top[1]["score"]


def test_overlap_grows_with_shared_tokens(spark):
    c = spark.createDataFrame([(1, "t", "red green blue"), (2, "t", "red")], "doc_id long, title string, text string")
    s = {r["doc_id"]: r["score"] for r in lexical.overlap_scores(c, ask(spark, "red green")).collect()}
    assert s == {1: 1.0, 2: 0.5}
    j = {r["doc_id"]: r["score"] for r in lexical.jaccard_scores(c, ask(spark, "red green")).collect()}
    assert j == {1: pytest.approx(2 / 3, abs=1e-5), 2: 0.5}


FACTS = [("kg_bat_is_mammal", "bat", "is_a", "mammal", "d1"), ("kg_mammal_is_vertebrate", "mammal", "is_a", "vertebrate", "d2"), ("kg_bat_fly", "bat", "capable_of", "fly", "d3"), ("kg_whale_is_mammal", "whale", "is_a", "mammal", "d4"), ("kg_whale_not", "whale", "not_capable_of", "fly", "d5")]


def facts(spark):
    return spark.createDataFrame(FACTS, "triple_id string, subject string, predicate string, object string, source string")


def test_graph(spark):
    e = facts(spark)
    asked = spark.createDataFrame([(1, "bat", "vertebrate")], "qid long, subject string, object string")
    assert rows(graph.two_hop_paths(e, asked), "item_id", "score") == [("path:kg_bat_is_mammal->kg_mammal_is_vertebrate", 6.0)]
    asked = spark.createDataFrame([(1, "mammal", "capable_of", "fly")], "qid long, class string, predicate string, object string")
    assert rows(graph.existential(e, asked), "item_id", "score") == [("path:kg_bat_is_mammal->kg_bat_fly", 6.0)]
    assert rows(graph.universal(e, asked), "item_id", "kind") == [("path:kg_bat_is_mammal->kg_bat_fly", "support"), ("path:kg_whale_is_mammal->kg_whale_not", "counterexample")]
    assert rows(graph.without_property(e, asked), "member") == [("whale",)]
    p = spark.createDataFrame([(1, "bat", None, None), (2, None, "is_a", "mammal")], "pid int, s string, p string, o string")
    assert rows(graph.triple_match(e, p), "pid", "triple_id") == [(1, "kg_bat_fly"), (1, "kg_bat_is_mammal"), (2, "kg_bat_is_mammal"), (2, "kg_whale_is_mammal")]


def test_merge_is_idempotent(spark):
    e = facts(spark)
    once = graph.merge_graphs(e, e, "x").drop("origin")
    assert once.count() == e.count()
    assert {r["source"] for r in once.collect()} == {f"{f[4]}|x:{f[4]}" for f in FACTS}
    twice = e.unionByName(e.withColumn("triple_id", F.concat(F.lit("z_"), "triple_id")))
    assert sorted(map(tuple, graph.merge_graphs(twice, e, "x").drop("origin").collect())) == sorted(map(tuple, once.collect()))
    w = spark.createDataFrame([("kg_bat",), ("nope",)], "prefix string")
    assert rows(graph.resolve_prefix(w, e), "prefix", "ids") == [("kg_bat", ["kg_bat_fly", "kg_bat_is_mammal"]), ("nope", ["nope"])]


def test_fusion_does_not_depend_on_row_order(spark):
    ranks = [(1, "bm25", "a", 1), (1, "bm25", "b", 2), (1, "dense", "b", 1), (1, "kg", "k", 1)]
    s = "qid long, backend string, item_id string, rank int"
    one, two = (rows(fusion.rrf_fuse(spark.createDataFrame(r, s)), "item_id", "score", "backends") for r in (ranks, ranks[::-1]))
    assert one == two and dict((i, b) for i, _, b in one)["b"] == "bm25,dense"
    assert rows(fusion.ablations(spark.createDataFrame(ranks, s)).filter("variant = 'dense' and item_id = 'b'"), "score") == [(round(0.9 / 62, 8),)]


def test_rescue_promotes_the_item_that_is_not_negated(spark):
    s = "qid long, question string, item_id string, rank int, content string"
    q = "which idea explains rest, not the sleep schedule code"
    e = spark.createDataFrame([(1, q, "x", 1, "sleep schedule code table"), (1, q, "y", 2, "an idea that explains rest"), (2, "plain", "z", 1, "text")], s)
    got = {(r["qid"], r["item_id"]): (r["final_rank"], r["applied"]) for r in fusion.rescue(e).collect()}
    assert got[1, "y"] == (1, True) and got[1, "x"][0] == 2 and got[2, "z"] == (1, False)


def test_metrics(spark):
    p = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1)], "a int, b int")
    assert metrics.cohen_kappa(p, "a", "b").first()["kappa"] == 0.5
    assert metrics.cohen_kappa(p.filter("a = 1"), "a", "b").first()["kappa"] == 1.0
    v = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "A", 3), (2, "A", 4), (2, "B", 5)], "item int, choice string, at int")
    assert rows(metrics.majority_vote(v, "item", "choice"), "item", "winner") == [(1, "Tie"), (2, "A")]
    assert rows(metrics.first_seen_majority(v, "item", "choice", "at"), "item", "winner") == [(1, "A"), (2, "A")]
    assert metrics.accuracy(p.limit(0), "a", "b").first()["accuracy"] == 0.0
    m = spark.range(1).select(metrics.answer_matches(F.lit("The big Bat: a mammal."), F.lit("a bat mammal")).alias("x"), metrics.support_score(F.lit(-1.0)).alias("s"))
    assert m.first()["x"] and m.first()["s"] == 0.0


def test_vectors_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "item_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "qid long, embedding array<float>")
    for up_to in (4096, 1):
        got = rows(dense.vector_top_k(q, v, 2, block=2, broadcast_up_to=up_to), "qid", "rank", "item_id")
        assert got == sorted((i, r, 20 - r) for i in range(5) for r in (1, 2))


def test_linear_model(spark):
    f = routing.long_features(spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "qid int, x int, y int"), "qid", ("x", "y"))
    w = spark.createDataFrame([("bm25", "x", 1.0), ("kg", "x", 1.0), ("kg", "y", 2.0)], "label string, feature string, weight double")
    s = routing.linear_scores(f, w, "qid")
    assert rows(routing.best_label(s, "qid"), "qid", "route", "margin") == [(1, "bm25", 0.0), (2, "kg", 2.0)]


def test_graph_questions_take_their_branch(spark):
    """Every branch with its fall-backs, and what is answered."""
    e = facts(spark).select(*graph.EDGE).unionByName(spark.createDataFrame([("f_eats", "bat", "eats", "mosquito", "s"), ("f_wings", "bat", "has_property", "wings", "s")], graph.EDGE))
    asked = ask(spark, "Can all mammals fly?", "What property allows a bat to fly?", "What path connects bat and vertebrate?", "Is a bat a mammal?", "Is a bat a vertebrate?", "Can a mammal fly?", "What eats mosquito?", "Does the bat produce or has a feature?", "Tell about whale", "nothing at all here")
    found = asking.graph_retrieve(asked, e)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["branch"], r["mode"], r["item_id"]))
    assert got[0][0] == ("universal", "universal_counterexample", "path:kg_whale_is_mammal->kg_whale_not")
    assert got[0][1][1] == "universal_support"
    assert {x[2] for x in got[1]} == {"f_wings", "kg_bat_fly"} and got[1][0][0] == "properties"
    assert got[2][0][1] == "two_hop" and got[3][0][1] == "membership"
    assert got[4][0][:2] == ("membership", "two_hop")
    assert got[5][0] == ("existential", "existential", "path:kg_bat_is_mammal->kg_bat_fly")
    assert got[6] == [("inverse", "inverse_relation", "f_eats")]
    assert got[7] == [("relation", "relation", "f_wings")]
    assert all(x[1] == "fallback" for x in got[8]) and 9 not in got
    answers = {r["qid"]: r["answer"] for r in asking.graph_answers(asked, found).collect()}
    assert answers[0].startswith("No. Counterexample evidence: whale is_a mammal ; whale not_capable_of fly. [evidence: path:")
    assert answers[3].startswith("Yes. bat is_a mammal. [") and answers[4].startswith("Yes, indirectly: bat") and answers[5].startswith("Yes. Existential support")
    assert answers[9] == "insufficient evidence"


def test_a_pattern_that_binds_nothing_finds_every_edge(spark):
    e = facts(spark)
    p = spark.createDataFrame([(7, None, None, None)], "pid int, s string, p string, o string")
    assert graph.triple_match(e, p).count() == e.count()


def test_rescue_counts_identifiers_and_backends(spark):
    s = "qid long, question string, item_id string, rank int, content string, route string, backends string"
    q = "RFC-7231 rules, not the draft"
    e = spark.createDataFrame([(1, q, "x", 1, "draft of rules", "bm25", "dense"), (1, q, "y", 2, "see rfc-7231", "bm25", "bm25,dense")], s)
    got = {r["item_id"]: r for r in fusion.rescue(e).collect()}
    assert got["y"]["identifier_hits"] == 1 and got["y"]["applied"] and got["y"]["final_rank"] == 1
    assert got["y"]["rescue_score"] == pytest.approx(got["y"]["overlap"] + 0.18 + 0.04 - 0.015, abs=1e-6)
