"""Route features of questions, and diagnostics of retrieved evidence per question and backend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.text import content_words
from .routing import BACKENDS

# Stop words and marker terms of the diagnostics.
STOP = ("the", "a", "an", "and", "or", "to", "of", "in", "is", "are", "what", "which", "can", "does")
CONTAMINATION = ("not ", "do not", "rather than", "instead of", "despite", "distractor", "nearby", "wrong", "fallback")
EXACT = ("exact", "identifier", "code", "section", "rfc", "icd", "hipaa", "jsonb", "torch.nn", "sklearn.")
ABSTRACT = ("feels like", "meaning", "concept", "idea", "describes", "called", "why", "how", "rather than", "metaphor")
DEDUCTIVE = ("can a", "can an", "are all", "is a", "is an", "every", "property", "membership", "class")
RELATIONAL = ("bridge", "connect", "connects", "between", "path", "relation", "multi-hop", "chain")
MULTI_HOP = ("two-hop", "multi-hop", "bridge", "chain", "path")
CONTRAST = (" not ", "do not", "rather than", "instead of", "despite", "although")
NOISE = ("boilerplate", "fallback", "snapshot", "nearby", "distractor", "public page", "formatting")

ANSWERABLE = ("defines", "is a", "are", "connects", "because", "property", "means", "describes", "uses", "causes")
PUBLIC_NOISE = ("boilerplate", "navigation", "snapshot", "fallback")
IDENTIFIERS = r"\b(?:rfc-?\d+|icd-10\s+[a-z]\d{2}\.\d|hipaa\s+\d{3}\.\d{3}|[a-z_]+\.[\w.]+|jsonb_[a-z0-9_]+)\b|§\s*\d+"
STRUCTURAL = ("kg", "triple", "path")


def _route_values() -> dict[str, Column]:
    q = F.lower(F.col("question"))
    flags = sum((F.col(f).cast("int") for f in ("lexical", "semantic", "deductive", "relational")), F.lit(0))
    num = lambda c: c.cast("double")
    tokens = F.size(F.regexp_extract_all(q, F.lit(r"[a-z0-9._:/§-]+"), F.lit(0)))
    return {
        "bias": F.lit(1.0),
        "query_length_log": F.log1p(F.length("question")) / 6.0,
        "token_count_log": F.log1p(tokens) / 3.0,
        "identifier_heavy": num(q.rlike(S.IDENTIFIER)),
        "lexical_exactness": num(F.col("lexical") | S.has_any(q, EXACT)),
        "semantic_abstraction": num(F.col("semantic") | S.has_any(q, ABSTRACT)),
        "deductive_cue": num(F.col("deductive") | S.has_any(q, DEDUCTIVE)),
        "relational_bridge": num(F.col("relational") | S.has_any(q, RELATIONAL)),
        "multi_hop_cue": num(S.has_any(q, MULTI_HOP)),
        "negation_or_contrast": num(S.has_any(q, CONTRAST)),
        "route_ambiguity": F.greatest(F.lit(0.0), (flags - 1) / 3.0),
        "low_margin": num(F.col("margin") < 0.25),
        "public_document_noise": num(S.has_any(q, NOISE)),
        **{f"computed_route_{b}": num(F.col("route") == b) for b in BACKENDS},
        **{f"keyword_route_{b}": num(F.col("keyword_route") == b) for b in BACKENDS},
    }


def route_features(routed: DataFrame) -> DataFrame:
    """qid and the named features of questions that went through the penalty and keyword routers."""
    return routed.select("qid", *(F.round(v, 6).alias(k) for k, v in _route_values().items()))


def sourced_features(routed: DataFrame) -> DataFrame:
    """qid and all 31 values: those of route_features(), identifiers counted, kinds of source, a graph at hand, a chance of rescue.

    ``routed`` has, beside what the routers add, source (null: of no kind), local_graph and rescue
    (booleans; null: false). A public source counts as noise. A projection of each row.
    """
    q, values = F.lower(F.col("question")), _route_values()
    num = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = F.size(S.named_identifiers(F.col("question"))) + F.coalesce(F.size(F.regexp_extract_all(q, F.lit(S.COUNTED_AGAIN), F.lit(0))), F.lit(0))
    values |= {
        "identifier_count_log": F.log1p(F.greatest(count, F.lit(0))),
        **{k: num(v) for k, v in S.source_flags(F.col("source")).items()},
        "query_local_graph_available": num(F.col("local_graph")),
        "topk_rescue_opportunity": num(F.col("rescue")),
        "public_document_noise": F.greatest(values["public_document_noise"], num(F.contains(F.lower("source"), F.lit("public")))),
    }
    return routed.select("qid", *(F.round(v, 6).alias(k) for k, v in values.items()))


def squash(score: Column) -> Column:
    return F.when(score <= 0, 0.0).otherwise(score / (1.0 + score))


def _words(c: Column) -> Column:
    return content_words(c, 1, STOP)


def _share(q: Column, t: Column) -> Column:
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def evidence_diagnostics(evidence: DataFrame) -> DataFrame:
    """qid and measures of its evidence (qid, question, item_id, rank, content, title, score).

    The evidence of a question is at most its top k rows, kept as one sorted array; pair
    measures are sums over that array, so nothing is joined.
    """
    item = F.struct("rank", F.col("item_id").cast("string").alias("item_id"), "content", "title", "score", _words(F.col("content")).alias("words"))
    d = evidence.groupBy("qid", "question").agg(F.array_sort(F.collect_list(item)).alias("items"))
    q = _words(F.col("question"))
    scores = F.transform("items", lambda x: squash(x["score"]))
    n = F.size("items")
    sets = F.transform("items", lambda x: x["words"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.filter(sets, lambda b, j: j > i), lambda b: F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))))
    text = F.lower(F.concat_ws(" ", F.col("question"), F.array_join(F.transform(F.slice("items", 1, 3), lambda x: x["content"]), " ")))
    bad = sum((F.contains(text, F.lit(m)).cast("int") for m in CONTAMINATION), F.lit(0))
    titles = F.transform("items", lambda x: _share(q, _words(F.concat_ws(" ", x["title"], x["item_id"]))))
    values = {
        "top1_score": F.get(scores, 0),
        "topk_score_mean": total(scores) / n,
        "top1_top2_gap": F.when(n > 1, F.greatest(F.lit(0.0), F.get(scores, 0) - F.get(scores, 1))).otherwise(F.get(scores, 0)),
        "evidence_count_log": F.log1p(n) / 2.0,
        "query_overlap_top1": _share(q, F.get(sets, 0)),
        "query_overlap_topk": _share(q, F.array_distinct(F.flatten(sets))),
        "title_or_id_match": F.array_max(titles),
        "source_diversity": F.least(F.lit(1.0), F.size(F.array_distinct(F.transform("items", lambda x: x["item_id"]))) / n),
        "redundancy": F.when(n < 2, 0.0).otherwise(total(pairs) / (n * (n - 1) / 2)),
        "semantic_snippet_consistency": total(F.transform(F.slice(sets, 1, 5), lambda t: _share(q, t))) / F.least(n, F.lit(5)),
        "negation_or_distractor_contamination": F.least(F.lit(1.0), bad / 3.0),
    }
    return d.select("qid", *(F.round(v, 6).alias(k) for k, v in values.items()))


def _counted(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers a text holds, as a share of three."""
    return F.least(F.lit(1.0), sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0)) / 3.0)


def candidate_features(routed: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, backend and the measures of the evidence that each backend found: four rows a question.

    routed has qid, question, route, keyword_route and, if known, source (else empty);
    evidence has qid, backend, rank, item_id, content, title, score, kind (document, triple,
    path), backends (those that contributed) and parent (the document it comes from; null:
    itself). A backend without evidence has zeros.
    """
    if "source" not in routed.columns:
        routed = routed.withColumn("source", F.lit(""))
    item = F.struct("rank", F.col("item_id").cast("string").alias("item_id"), "content", "title", "score", "kind", "backends", F.coalesce(F.col("parent").cast("string"), F.col("item_id").cast("string")).alias("parent"), _words(F.col("content")).alias("words"))
    found = evidence.groupBy("qid", "backend").agg(F.array_sort(F.collect_list(item)).alias("found"))
    asked = routed.select("qid", "question", "route", "keyword_route", "source", F.explode(F.array(*map(F.lit, BACKENDS))).alias("backend"))
    d = asked.join(found, ["qid", "backend"], "left").withColumn("items", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    q, n = _words(F.col("question")), F.size("items")
    each = lambda f: F.transform("items", f)
    text = lambda most: F.lower(F.array_join(F.transform(F.slice("items", 1, most), lambda x: x["content"]), " "))
    scores, sets = each(lambda x: squash(x["score"])), each(lambda x: x["words"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    union = lambda a, b: F.size(F.array_union(a, b))
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.filter(sets, lambda b, j: j > i), lambda b: F.when(union(a, b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union(a, b)))))
    low = F.lower("question")
    ids = F.regexp_extract_all(low, F.lit(IDENTIFIERS), F.lit(0))
    whole = F.replace(text(1 << 20), F.lit(" "), F.lit(""))
    named = F.size(F.filter(ids, lambda x: F.contains(whole, F.replace(x, F.lit(" "), F.lit("")))))
    structural = F.size(F.filter("items", lambda x: x["kind"].isin(*STRUCTURAL)))
    path = F.exists("items", lambda x: F.contains(x["item_id"], F.lit("path")) | (x["kind"] == "path"))
    agreeing = sum((F.exists("items", lambda x: F.contains(F.concat_ws(",", x["backends"], x["kind"]), F.lit(b))).cast("int") for b in BACKENDS), F.lit(0))
    values = {
        **{f"candidate_{b}": (F.col("backend") == b).cast("double") for b in BACKENDS},
        "candidate_matches_computed_ras": (F.col("route") == F.col("backend")).cast("double"),
        "candidate_matches_keyword": (F.col("keyword_route") == F.col("backend")).cast("double"),
        "top1_score": F.get(scores, 0),
        "topk_score_mean": F.try_divide(total(scores), n),
        "top1_top2_gap": F.when(n > 1, F.greatest(F.lit(0.0), F.get(scores, 0) - F.get(scores, 1))).otherwise(F.get(scores, 0)),
        "evidence_count_log": F.log1p(n) / 2.0,
        "query_overlap_top1": _share(q, F.get(sets, 0)),
        "query_overlap_topk": _share(q, F.array_distinct(F.flatten(sets))),
        "identifier_exact_match": F.try_divide(named, F.size(ids)),
        "title_or_id_match": F.array_max(each(lambda x: _share(q, _words(F.concat_ws(" ", x["title"], x["parent"], x["item_id"]))))),
        "source_diversity": F.try_divide(F.size(F.array_distinct(each(lambda x: x["parent"]))), n),
        "redundancy": F.try_divide(total(pairs), n * (n - 1) / 2),
        "kg_fact_or_path_present": (structural > 0).cast("double"),
        "kg_path_completeness": F.when(path, 1.0).otherwise(F.least(F.lit(1.0), structural / 2.0)),
        "hybrid_component_agreement": F.least(F.lit(1.0), agreeing / 3.0),
        "semantic_snippet_consistency": F.try_divide(total(F.transform(F.slice(sets, 1, 5), lambda t: _share(q, t))), F.least(n, F.lit(5))),
        "negation_or_distractor_contamination": _counted(F.concat_ws(" ", low, text(3)), CONTAMINATION),
        "public_noise_indicator": (F.contains(F.lower("source"), F.lit("public")) | S.has_any(text(1 << 20), PUBLIC_NOISE)).cast("double"),
        "answerability_marker": _counted(text(5), ANSWERABLE),
    }
    return d.select("qid", "backend", *(F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in values.items()))


def joint_features(route: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, backend, route__* and evidence__*: the features of a question beside those of each candidate."""
    r = route.select("qid", *(F.col(c).alias(f"route__{c}") for c in route.columns if c != "qid"))
    return candidates.select("qid", "backend", *(F.col(c).alias(f"evidence__{c}") for c in candidates.columns if c not in ("qid", "backend"))).join(r, "qid")


def evidence_routes(joint: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """qid, backend, combined, route_part, evidence_part, behind, selected: a linear score of every candidate, by groups.

    ``behind`` is the distance to the question's best candidate, for that one the margin to
    the runner-up; ties go to the earlier backend.
    """

    def part(prefix: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in sorted(weights.items()) if c.startswith(prefix)], F.lit(0.0))

    d = joint.select("qid", "backend", F.round(part("route__"), 6).alias("route_part"), F.round(part("evidence__"), 6).alias("evidence_part"))
    d = d.withColumn("combined", F.round(intercept + F.col("route_part") + F.col("evidence_part"), 6))
    order = reduce(lambda w, b: w.when(F.col("backend") == b[1], b[0]), enumerate(BACKENDS), F)
    best = Window.partitionBy("qid").orderBy(F.desc("combined"), order)
    all_ = Window.partitionBy("qid")
    d = d.withColumns({"place": F.row_number().over(best), "most": F.max("combined").over(all_)}).withColumn("next", F.max(F.when(F.col("place") == 2, F.col("combined"))).over(all_))
    behind = F.when(F.col("place") == 1, F.col("combined") - F.col("next")).otherwise(F.col("most") - F.col("combined"))
    return d.select("qid", "backend", "combined", "route_part", "evidence_part", F.round(behind, 6).alias("behind"), (F.col("place") == 1).alias("selected"))


def evidence_training_pairs(joint: DataFrame, gold: DataFrame) -> DataFrame:
    """joint_features() with label: 1 where the candidate is the question's gold route; four rows a question."""
    return joint.join(gold.select("qid", "gold"), "qid").withColumn("label", (F.col("backend") == F.col("gold")).cast("double")).drop("gold")
