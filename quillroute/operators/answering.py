"""Grounded answers and their traces from retrieved evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from .metrics import support_score
from .routing import BACKENDS

# Names of the question families, and of the answer types.
FAMILY = {"bm25": "lexical/exact-match", "dense": "semantic/paraphrase", "kg": "deductive/structured", "hybrid": "relational/fused-evidence"}
ANSWER_TYPE = {"bm25": "lexical_exact_match", "dense": "semantic_summary", "kg": "deductive", "hybrid": "relational"}
NO_EVIDENCE = "insufficient evidence"


def by_backend(values: dict[str, str | Column], default: Column) -> Column:
    out = default
    for b, v in values.items():
        out = F.when(F.col("route") == b, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


def collect_evidence(evidence: DataFrame) -> DataFrame:
    """qid, items: evidence (qid, rank, item_id, title, content, score) as an array in rank order; k bounds it."""
    item = F.struct("rank", F.col("item_id").cast("string").alias("item_id"), "title", "content", "score")
    return evidence.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))


def answers(routed: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, route, answer, answer_type, evidence_ids, snippets, support: one row per routed question."""
    d = routed.join(collect_evidence(evidence), "qid", "left")
    lead = F.get(F.col("items"), 0)
    ids = F.transform("items", lambda x: x["item_id"])
    cite = F.concat(F.lit(" [evidence: "), lead["item_id"], F.lit("]"))
    text = by_backend(
        {
            "bm25": F.concat(lead["title"], F.lit(": "), lead["content"], cite),
            "dense": F.concat(lead["title"], F.lit(". "), lead["content"], cite),
            "kg": F.concat(lead["content"], F.lit("."), cite),
            "hybrid": F.concat(F.lit("Hybrid connection: "), lead["content"], F.lit(". This combines structured evidence plus text relation evidence. [fused evidence: "), F.array_join(ids, ","), F.lit("]")),
        },
        lead["content"],
    )
    none = F.col("items").isNull() | (F.size("items") == 0)
    return d.select(
        "qid", "route",
        F.when(none, NO_EVIDENCE).otherwise(text).alias("answer"),
        F.when(none, "insufficient").otherwise(by_backend(ANSWER_TYPE, F.lit("generic"))).alias("answer_type"),
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("evidence_ids"),
        F.coalesce(F.array_join(F.transform("items", lambda x: snippet(x["content"])), " | "), F.lit("")).alias("snippets"),
        support_score(F.array_max(F.transform("items", lambda x: x["score"]))).alias("support"),
    )


def rationale() -> Column:
    score = by_backend({b: F.col(f"score_{b}") for b in BACKENDS}, F.lit(None).cast("double"))
    return F.concat(F.lit("Selected "), F.col("route"), F.lit(" for "), by_backend(FAMILY, F.col("route")), F.lit(" signals with minimum penalty="), F.format_string("%.3f", score), F.lit("."))


def traces(routed: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, step_no, step, detail: the five steps from question to answer, as rows."""
    d = routed.join(collect_evidence(evidence), "qid", "left")
    flags = ("lexical", "semantic", "deductive", "relational")
    signals = F.array_join(F.array_compact(F.array(*(F.when(F.col(f), f) for f in flags))), ",")
    scores = F.array_join(F.array(*(F.concat(F.lit(f"{b}="), F.format_string("%.3f", F.col(f"score_{b}"))) for b in BACKENDS)), ",")
    ids = F.coalesce(F.array_join(F.transform("items", lambda x: x["item_id"]), ","), F.lit(""))
    steps = F.array(
        F.struct(F.lit(1).alias("step_no"), F.lit("parse_query_features").alias("step"), signals.alias("detail")),
        F.struct(F.lit(2).alias("step_no"), F.lit("score_ras").alias("step"), scores.alias("detail")),
        F.struct(F.lit(3).alias("step_no"), F.lit("select_backend").alias("step"), rationale().alias("detail")),
        F.struct(F.lit(4).alias("step_no"), F.lit("retrieve_evidence").alias("step"), ids.alias("detail")),
        F.struct(F.lit(5).alias("step_no"), F.lit("synthesize_answer").alias("step"), ids.alias("detail")),
    )
    return d.select("qid", F.explode(steps).alias("s")).select("qid", "s.*")


def trace_issues(answered: DataFrame) -> DataFrame:
    """qid, issue: what makes an answer unsound."""
    issues = F.array_compact(F.array(
        F.when(F.col("evidence_ids") == "", "no_evidence"),
        F.when(F.col("answer") == NO_EVIDENCE, "no_answer"),
        F.when(~F.col("route").isin(*BACKENDS), "unknown_backend"),
        F.when(F.col("support") <= 0, "no_support"),
    ))
    return answered.select("qid", F.explode(issues).alias("issue"))


def failure_buckets(rows: DataFrame) -> DataFrame:
    """qid, bucket: every kind of failure a result shows (route_ok, hit, top1, matched, family)."""
    buckets = F.array_sort(F.array_compact(F.array(
        F.when(~F.col("route_ok"), "route_error"),
        F.when(~F.col("hit"), "retrieval_miss"),
        F.when(F.col("hit") & ~F.col("top1"), "ranking_error"),
        F.when(F.col("hit") & ~F.col("matched"), "answer_synthesis_miss"),
        F.when((F.col("family") == "deductive") & ~F.col("hit"), "kg_incompleteness"),
        F.when(F.col("family") == "semantic", "semantic_drift"),
        F.when((F.col("family") == "relational") & ~F.col("hit"), "hybrid_fusion_miss"),
    )))
    return rows.select("qid", F.explode(buckets).alias("bucket"))


def prompt(question: Column, evidence: Column) -> Column:
    """The text that a language model would be asked with."""
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.lit("Evidence:"), F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e)), "\n"))
