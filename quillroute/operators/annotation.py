"""Human judgements beside automatic ones: raters, preferences, tags and sampling plans.

Ratings of 0 mean "not rated". Counted rates over nothing are 0, means null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import majority_vote, rate


def first_two_raters(ratings: DataFrame, item: str, position: str, score: str) -> DataFrame:
    """item, first, second: the scores of the first two raters of each item that has two, both rated."""
    d = ratings.withColumn("rn", F.row_number().over(Window.partitionBy(item).orderBy(position))).filter("rn <= 2")
    pairs = d.groupBy(item).agg(F.max(F.when(F.col("rn") == 1, F.col(score))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col(score))).alias("second"))
    return pairs.filter("first > 0 and second > 0")


def _share(hit: Column, of: Column) -> Column:
    return F.coalesce(rate(F.when(of, hit)), F.lit(0.0))


def trace_validity(judged: DataFrame) -> DataFrame:
    """One row over (answer, trace, clarity, route, gold): means, shares of 2 or more, and support despite a wrong route."""
    a, t, c = (F.col(n) for n in ("answer", "trace", "clarity"))
    return judged.agg(
        F.round(F.avg(F.when(t > 0, t)), 6).alias("trace_mean"),
        F.round(F.avg(F.when(c > 0, c)), 6).alias("clarity_mean"),
        _share(t >= 2, t > 0).alias("trace_ge_2"),
        _share(c >= 2, c > 0).alias("clarity_ge_2"),
        _share(a >= 2, (F.col("route") != F.col("gold")) & (a > 0)).alias("supported_despite_route"),
        F.count_if(t.isin(1, 2) | c.isin(1, 2)).alias("weak_traces"),
    )


def human_vs_automatic(judged: DataFrame) -> DataFrame:
    """One row over (correct, answer, evidence, trace): correct but weakly supported, wrong but strongly supported."""
    weak = (F.col("answer") <= 2) | (F.col("evidence") <= 2) | (F.col("trace") <= 2)
    strong = (F.col("answer") >= 3) & (F.col("evidence") >= 3)
    return judged.agg(F.count_if(F.col("correct") & weak).alias("correct_but_weak"), F.count_if(~F.col("correct") & strong).alias("wrong_but_strong"))


def preferred_routes(votes: DataFrame, pairs: DataFrame, item: str, choice: str) -> DataFrame:
    """The pairs (route_a, route_b) whose majority prefers A or B, with ``winner`` and ``preferred``."""
    won = majority_vote(votes, item, choice).filter("winner in ('A', 'B')").select(item, "winner")
    return pairs.join(won, item).withColumn("preferred", F.when(F.col("winner") == "A", F.col("route_a")).otherwise(F.col("route_b")))


def human_alignment(preferred: DataFrame, base: str, other: str) -> DataFrame:
    """One row: how often two routers choose the preferred route, and preferences for B that only ``other`` meets."""
    b, o = F.col(base) == F.col("preferred"), F.col(other) == F.col("preferred")
    one = _share(b, F.lit(True)), _share(o, F.lit(True))
    return preferred.agg(F.count("*").alias("n"), one[0].alias("base"), one[1].alias("other"), F.round(one[1] - one[0], 6).alias("delta"), F.count_if((F.col("winner") == "B") & o & ~b).alias("recovered"))


def comparison_tag(correct_a: Column, correct_b: Column, route_a: Column, route_b: Column, margin: Column, low: float = 0.15) -> Column:
    """Why a pair of outputs is worth a comparison: correctness first, then routes, then little margin."""
    return (
        F.when(~correct_a & correct_b, "computed_miss_system_b_hit")
        .when(correct_a & ~correct_b, "computed_hit_system_b_miss")
        .when(route_a != route_b, "route_disagreement")
        .when(margin <= low, "computed_low_confidence")
        .otherwise("trace_evidence_audit")
    )


def quota_plan(rows: DataFrame, quotas: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``quota`` rows of each group of ``quotas`` (group, quota, turn), groups by turn, at most ``most`` in all."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    # a group's largest quota is a literal bound, so that Spark prunes each task's rows before the shuffle
    d = rows.withColumn("rn", rn).filter(F.col("rn") <= most).join(quotas, group).filter("rn <= quota")
    return d.orderBy("turn", "rn").limit(most)
