"""Queries that compare systems, backends and human judgements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, dense, graph, metrics, routing
from . import registry as R
from .registry import query
from .views import SQL, corpus, questions, table

# -- human judgements -------------------------------------------------------------------

_EVENT_RATINGS = "r0 AS (SELECT event_id, event_id % 100 AS item, (event_id // 7 + user_id) % 4 AS score FROM events), rn AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY event_id) AS rn FROM r0), pairs AS (SELECT item, max(score) FILTER (rn = 1) AS a, max(score) FILTER (rn = 2) AS b FROM rn WHERE rn <= 2 GROUP BY item HAVING max(score) FILTER (rn = 1) > 0 AND max(score) FILTER (rn = 2) > 0)"


def _first_two(spark, d):
    score = (F.floor(F.col("event_id") / 7) + F.col("user_id")) % 4
    rated = table(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("item"), score.alias("score"))
    return annotation.first_two_raters(rated, "item", "event_id", "score")


@query("WITH " + _EVENT_RATINGS + " SELECT item, a AS first, b AS second FROM pairs")
def first_two_raters(spark, d):
    return _first_two(spark, d)


@query("WITH " + _EVENT_RATINGS + " SELECT count(*) AS n, round(avg((a = b)::INTEGER), 6) AS agreement FROM pairs")
def first_two_agreement(spark, d):
    return metrics.percent_agreement(_first_two(spark, d), "first", "second")


_JUDGED = "judged AS (SELECT v2.*, event_id, user_id, user_id % 4 AS answer, (event_id // 7) % 4 AS trace, (event_id + user_id) % 4 AS clarity, (event_id // 3) % 4 AS evidence FROM events JOIN v2 ON event_id % 40 = qid)"
_JUDGE = R._with(SQL["questions"], R._BENCH, R._FEATURES, R._PENALTY, R._KEYWORD, R._V2, _JUDGED)


def _versions(spark, d):
    return routing.rule_routes_v2(routing.keyword_routes(routing.penalty_routes(questions(spark, d))))


def _judged(spark, d):
    """Events read as judgements of the questions' answers; scores 0 to 3, 0 for none."""
    e, u = F.col("event_id"), F.col("user_id")
    scores = {"answer": u % 4, "trace": F.floor(e / 7) % 4, "clarity": (e + u) % 4, "evidence": F.floor(e / 3) % 4}
    events = table(spark, d, "events").select((e % 40).alias("qid"), "event_id", *(c.alias(n) for n, c in scores.items()))
    return events.join(_versions(spark, d), "qid")


@query(_JUDGE + """SELECT round(avg(trace) FILTER (trace > 0), 6) AS trace_mean, round(avg(clarity) FILTER (clarity > 0), 6) AS clarity_mean,
 round(coalesce(avg((trace >= 2)::INTEGER) FILTER (trace > 0), 0), 6) AS trace_ge_2, round(coalesce(avg((clarity >= 2)::INTEGER) FILTER (clarity > 0), 0), 6) AS clarity_ge_2,
 round(coalesce(avg((answer >= 2)::INTEGER) FILTER ('dense' <> gold AND answer > 0), 0), 6) AS supported_despite_route, count_if(trace IN (1, 2) OR clarity IN (1, 2)) AS weak_traces FROM judged""")  # fmt: skip
def trace_validity(spark, d):
    return annotation.trace_validity(_judged(spark, d).withColumn("route", F.lit("dense")))


@query(_JUDGE + "SELECT count_if('dense' = gold AND (answer <= 2 OR evidence <= 2 OR trace <= 2)) AS correct_but_weak, count_if('dense' <> gold AND answer >= 3 AND evidence >= 3) AS wrong_but_strong FROM judged")
def human_vs_automatic(spark, d):
    return annotation.human_vs_automatic(_judged(spark, d).withColumn("correct", F.lit("dense") == F.col("gold")))


_PREFERRED = """, cast_ AS (SELECT qid, CASE WHEN user_id % 5 < 2 THEN 'A' WHEN user_id % 5 < 4 THEN 'B' ELSE 'Tie' END AS choice, count(*) AS n FROM judged GROUP BY ALL),
won AS (SELECT qid, CASE WHEN count(*) > 1 THEN 'Tie' ELSE min(choice) END AS winner FROM cast_ JOIN (SELECT qid, max(n) AS n FROM cast_ GROUP BY qid) USING (qid, n) GROUP BY qid),
pref AS (SELECT qid, winner, gold, route_v2, route, CASE winner WHEN 'A' THEN 'dense' ELSE gold END AS preferred FROM won JOIN v2 USING (qid) WHERE winner IN ('A', 'B'))
"""


def _preferred(spark, d):
    # output A always answers by dense retrieval, output B by the intended route
    pairs = _versions(spark, d).select("qid", "route", "route_v2", F.lit("dense").alias("route_a"), F.col("gold").alias("route_b"))
    choice = F.when(F.col("user_id") % 5 < 2, "A").when(F.col("user_id") % 5 < 4, "B").otherwise("Tie")
    votes = table(spark, d, "events").select((F.col("event_id") % 40).alias("qid"), choice.alias("choice")).join(pairs.select("qid"), "qid")
    return annotation.preferred_routes(votes, pairs, "qid", "choice")


@query(_JUDGE + _PREFERRED + "SELECT qid, winner, preferred, route, route_v2 FROM pref")
def preferred_routes(spark, d):
    return _preferred(spark, d).select("qid", "winner", "preferred", "route", "route_v2")


@query(_JUDGE + _PREFERRED + "SELECT count(*) AS n, round(coalesce(avg(('dense' = preferred)::INTEGER), 0), 6) AS base, round(coalesce(avg((route_v2 = preferred)::INTEGER), 0), 6) AS other, round(round(coalesce(avg((route_v2 = preferred)::INTEGER), 0), 6) - round(coalesce(avg(('dense' = preferred)::INTEGER), 0), 6), 6) AS delta, coalesce(count_if(winner = 'B' AND route_v2 = preferred AND 'dense' <> preferred), 0) AS recovered FROM pref")
def human_alignment(spark, d):
    return annotation.human_alignment(_preferred(spark, d), "route_a", "route_v2")


@query(_JUDGE + "SELECT qid, CASE WHEN route <> gold AND b = gold THEN 'computed_miss_system_b_hit' WHEN route = gold AND b <> gold THEN 'computed_hit_system_b_miss' WHEN route <> b THEN 'route_disagreement' WHEN margin <= 0.15 THEN 'computed_low_confidence' ELSE 'trace_evidence_audit' END AS tag FROM (SELECT *, CASE WHEN qid % 2 = 0 THEN 'bm25' ELSE 'hybrid' END AS b FROM v2)")
def comparison_tags(spark, d):
    a, b, gold = F.col("route"), F.when(F.col("qid") % 2 == 0, "bm25").otherwise("hybrid"), F.col("gold")
    return _versions(spark, d).select("qid", annotation.comparison_tag(a == gold, b == gold, a, b, F.col("margin")).alias("tag"))


_QUOTAS = (("lexical", 3, 2), ("semantic", 2, 1), ("deductive", 2, 3), ("relational", 4, 4))


@query(R._with(SQL["questions"], "quotas(family, quota, turn) AS (VALUES " + ", ".join(f"('{f}', {n}, {t})" for f, n, t in _QUOTAS) + ")") + "SELECT family, qid, quota FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY qid) AS rn FROM questions) JOIN quotas USING (family) WHERE rn <= quota ORDER BY turn, rn LIMIT 9")
def quota_plan(spark, d):
    quotas = spark.createDataFrame(_QUOTAS, "family string, quota int, turn int")
    return annotation.quota_plan(questions(spark, d), quotas, "family", "qid", 9).select("family", "qid", "quota")


# -- backends against each other --------------------------------------------------------


@query(R._RANKED + """, hit AS (SELECT qid, backend, min(rank) FILTER (item_id % 5 = qid % 5) AS first_hit FROM ranks GROUP BY ALL),
wide AS (SELECT qid, min(first_hit) FILTER (backend = 'dense') AS p, min(first_hit) FILTER (backend = 'bm25') AS o FROM hit GROUP BY qid)
SELECT 'bm25' AS other, count(*) AS n, count_if(p IS NOT NULL) AS hits, count_if(p = 1) AS top1, count_if(o IS NOT NULL) AS other_hits, count_if(p IS NOT NULL AND o IS NULL) AS beats FROM wide""")  # fmt: skip
def dense_beats(spark, d):
    ranked = R._ranked(spark, d)
    gold = ranked.filter("item_id % 5 = qid % 5").select("qid", "item_id")
    return metrics.beats(metrics.first_hits(ranked, gold), "dense", ("bm25",))


@query(R._RANKED + """, bundle AS (SELECT qid, backend, (rank + 1) // 2 AS place, list(item_id % 7) AS ids FROM ranks GROUP BY ALL),
hit AS (SELECT qid, backend, min(place) FILTER (list_contains(ids, qid % 7) AND list_contains(ids, (qid + 1) % 7)) AS first_hit FROM bundle GROUP BY ALL),
wide AS (SELECT qid, min(first_hit) FILTER (backend = 'bm25') AS p, min(first_hit) FILTER (backend = 'dense') AS o FROM hit GROUP BY qid)
SELECT 'dense' AS other, count(*) AS n, count_if(p IS NOT NULL) AS hits, count_if(p = 1) AS top1, count_if(o IS NOT NULL) AS other_hits, count_if(p IS NOT NULL AND o IS NULL) AS beats FROM wide""")  # fmt: skip
def whole_gold_beats(spark, d):
    items = R._ranked(spark, d).groupBy("qid", "backend", F.floor((F.col("rank") + 1) / 2).alias("rank")).agg(F.collect_list(F.col("item_id") % 7).alias("ids"))
    gold = questions(spark, d).select("qid", F.array(F.col("qid") % 7, (F.col("qid") + 1) % 7).alias("gold"))
    return metrics.beats(metrics.first_whole_hits(items, gold), "bm25", ("dense",))


# -- routers against each other ---------------------------------------------------------

_CAL_CONF = R._with(SQL["questions"], SQL["user_turns"], R._ALL, R._FEATURES, R._PENALTY, R._KEYWORD, R._CONF, R._CALIBRATED)


@query(_CAL_CONF + """SELECT qid, calibrated_route, CASE WHEN keyword_route <> calibrated_route AND confidence <> 'high' AND (misleading_exact_cue OR explicit_kg_negation OR (identifier_heavy AND (semantic_cue OR relational_cue)))
 THEN keyword_route ELSE calibrated_route END AS final_route FROM cal JOIN (SELECT qid, keyword_route, confidence FROM conf) USING (qid)""")  # fmt: skip
def route_with_classifier(spark, d):
    # the keyword router stands in for a fitted classifier that is always sure of its choice
    r = routing.calibrated_routes(R._confident(spark, d, R._all_questions))
    scores = {b: F.when(F.col("keyword_route") == b, 0.55).otherwise(0.15) for b in routing.BACKENDS}
    return routing.classifier_override(r, "keyword_route", scores).select("qid", "calibrated_route", "final_route")


@query(R._with(SQL["questions"], R._BENCH, R._FEATURES, R._PENALTY, R._KEYWORD, R._V2) + """, e AS (SELECT qid, margin, [route, keyword_route, route_v2] AS routes, unnest(['computed', 'keyword', 'rules_v2']) AS version, unnest([route, keyword_route, route_v2]) AS route FROM v2)
SELECT qid, margin, (margin < 0.25 OR len(list_distinct(routes)) > 1) AS ambiguous, version, route, len(list_filter(routes, lambda r: r = route))::INTEGER AS votes FROM e""".lstrip())  # fmt: skip
def router_explanations(spark, d):
    return routing.explain_versions(_versions(spark, d), "qid", {"computed": "route", "keyword": "keyword_route", "rules_v2": "route_v2"})


# -- concepts and profiles --------------------------------------------------------------

_PHRASES = {"exact code": "concept_lookup", "feels like": "concept_feeling"}
_WORDS = {"bridge": "concept_link", "class": "concept_kind", "member": "concept_kind"}


@query(R._with(SQL["questions"], R._SIMPLE_QS) + f"""SELECT qid, array_to_string(list_concat(tokens, {', '.join(f"CASE WHEN contains(lower(question), '{p}') THEN ['{c}', '{c}', '{c}', '{c}'] ELSE [] END" for p, c in _PHRASES.items())},
 flatten(list_transform(tokens, lambda t: CASE t {' '.join(f"WHEN '{w}' THEN ['{c}', '{c}']" for w, c in _WORDS.items())} ELSE [] END))), ' ') AS tokens FROM qtok JOIN questions USING (qid)""")  # fmt: skip
def concept_expansion(spark, d):
    return questions(spark, d).select("qid", F.array_join(dense.concept_tokens(F.col("question"), _PHRASES, _WORDS), " ").alias("tokens"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'the' ELSE 'license' END AS subject, 'rated' AS predicate, 'q' || quality AS object, 0.9::DOUBLE AS confidence FROM documents JOIN labels USING (doc_id) WHERE contains(lower(concat_ws(' ', source, text)), CASE quality WHEN 1 THEN 'the' ELSE 'license' END)")
def profile_facts(spark, d):
    subject = F.when(F.col("quality") == 1, "the").otherwise("license")
    profiles = table(spark, d, "labels").select("doc_id", subject.alias("subject"), F.lit("rated").alias("predicate"), F.concat(F.lit("q"), "quality").alias("object"), F.lit(0.9).alias("confidence"))
    return graph.profile_facts(corpus(spark, d), profiles)
