"""Measures over predictions, annotations and votes. Empty groups give null, counted rates 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 6)


def accuracy(rows: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    """Rows, correct and accuracy per group; with ``by`` also the total (a rollup, group null)."""
    ok = F.col(gold) == F.col(predicted)
    grouped = rows.rollup(*by) if by else rows.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.coalesce(rate(ok), F.lit(0.0)).alias("accuracy"))


def accuracy_cube(rows: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    return rows.cube(*by).agg(F.count("*").alias("n"), F.coalesce(rate(F.col(gold) == F.col(predicted)), F.lit(0.0)).alias("accuracy"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def hit_rates(hits: DataFrame, *by: str) -> DataFrame:
    """Per group: hit at k, hit at 1 and the gap, from (rank of the first hit or null)."""
    hit, top = F.col("first_hit").isNotNull(), F.coalesce(F.col("first_hit") == 1, F.lit(False))
    return hits.groupBy(*by).agg(F.count("*").alias("n"), rate(hit).alias("hit_at_k"), rate(top).alias("top1"), F.round(F.avg(hit.cast("double")) - F.avg(top.cast("double")), 6).alias("gap"))


def tag_breakdown(rows: DataFrame, tags: str, gold: str, predicted: str) -> DataFrame:
    """Accuracy per tag; a row counts under each of its tags."""
    return rows.select(F.explode(tags).alias("tag"), gold, predicted).groupBy("tag").agg(F.count("*").alias("n"), rate(F.col(gold) == F.col(predicted)).alias("accuracy"))


def margins(rows: DataFrame, margin: str, low: float = 0.25) -> DataFrame:
    m = F.col(margin)
    return rows.agg(F.count("*").alias("n"), F.round(F.min(m), 6).alias("min_margin"), F.round(F.max(m), 6).alias("max_margin"), F.round(F.avg(m), 6).alias("mean_margin"), F.count_if(m < low).alias("low_margins"))


def percent_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), rate(F.col(a) == F.col(b)).alias("agreement"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement, and kappa (1 where expected agreement is 1).

    The cells are counted once; marginals and totals are windows over that small table.
    """
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("a").agg(F.sum("n").alias("na"))
    right = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.col("t").alias("n"), F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """Quadratically weighted kappa of two integer ratings on a known scale."""
    span = float((high - low) ** 2)
    w = lambda x, y: F.pow(F.col(x) - F.col(y), 2) / span
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    seen = cells.agg(F.sum("n").alias("t"), F.sum(F.col("n") * w("a", "b")).alias("o"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # at most (high - low + 1) ** 2 rows: the marginals of a rating scale
    chance = left.crossJoin(right).agg(F.sum(F.col("na") * F.col("nb") * w("a", "b")).alias("e"))
    o, e = F.col("o") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return seen.crossJoin(chance).select(F.col("t").alias("n"), F.round(F.when(e == 0, 1.0).otherwise(1 - o / e), 6).alias("weighted_kappa"))


def majority_vote(votes: DataFrame, item: str, choice: str, tie: str = "Tie") -> DataFrame:
    """The most frequent choice of each item, or ``tie`` where two are equally frequent."""
    counts = votes.groupBy(item, choice).agg(F.count("*").alias("n"))
    top = counts.groupBy(item).agg(F.max("n").alias("most"), F.sum("n").alias("votes"))
    best = counts.join(top, item).filter("n = most").groupBy(item, "most", "votes").agg(F.min(choice).alias("first"), F.count("*").alias("winners"))
    return best.select(item, F.when(F.col("winners") > 1, tie).otherwise(F.col("first")).alias("winner"), F.col("most").alias("n"), "votes")


def first_seen_majority(votes: DataFrame, item: str, choice: str, position: str) -> DataFrame:
    """The most frequent choice; of equally frequent ones the one seen first."""
    counts = votes.groupBy(item, choice).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    return counts.groupBy(item).agg(F.max_by(choice, F.struct(F.col("n"), (-F.col("seen")).alias("s"))).alias("winner"), F.max("n").alias("n"))


def preference_rates(votes: DataFrame, key: str, choice: str, choices: tuple[str, ...]) -> DataFrame:
    return votes.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.count_if(F.col(choice) == c) / F.count("*"), 6).alias(f"rate_{c.lower()}") for c in choices))


def adjudication_queue(votes: DataFrame, item: str, choice: str, confidence: str, low: float) -> DataFrame:
    """Items with a split vote or a vote of little confidence."""
    g = votes.groupBy(item).agg(F.count_distinct(choice).alias("choices"), F.round(F.min(confidence), 6).alias("least_confidence"))
    return g.filter((F.col("choices") > 1) | (F.col("least_confidence") <= low))


def disagreement(ratings: DataFrame, item: str, dimension: str, score: str, most: int = 20) -> DataFrame:
    """The items whose ratings are furthest apart in any dimension."""
    d = ratings.groupBy(item, dimension).agg((F.max(score) - F.min(score)).alias("spread")).groupBy(item).agg(F.max("spread").alias("spread"))
    return d.orderBy(F.desc("spread"), item).limit(most)


def group_means(ratings: DataFrame, key: str, score: str) -> DataFrame:
    """Means, medians and counts per group; a score of 0 means missing."""
    s = F.when(F.col(score) > 0, F.col(score))
    return ratings.groupBy(key).agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.median(s), 6).alias("median"))


def support_score(best: Column) -> Column:
    """m / (1 + m) of the best evidence score, 0 to 1, 0 without evidence."""
    return F.round(F.when(best.isNull() | (best <= 0), 0.0).otherwise(F.least(F.lit(1.0), best / (1.0 + best))), 6)


def answer_matches(answer: Column, gold: Column) -> Column:
    """Whether the answer holds the gold answer, or half its words or more as substrings."""
    from ..functions.text import GOLD_STOPWORDS, match_form

    a, g = match_form(answer), match_form(gold)
    tokens = F.filter(F.split(g, " "), lambda t: (t != "") & ~t.isin(*GOLD_STOPWORDS))
    hits = F.size(F.filter(tokens, lambda t: F.contains(a, t)))
    return (g != "") & (F.contains(a, g) | ((F.size(tokens) > 0) & (hits >= 0.5 * F.size(tokens))))


def deltas(rows: DataFrame, key: str, mode: str, value: str, base: str, other: str) -> DataFrame:
    """Per key the value of two modes and their difference, 0 where one is missing."""
    p = rows.groupBy(key).pivot(mode, [base, other]).agg(F.first(value))
    b, o = F.coalesce(F.col(base), F.lit(0.0)), F.coalesce(F.col(other), F.lit(0.0))
    return p.select(key, b.alias("base"), o.alias("other"), F.round(o - b, 6).alias("delta"))


def first_per_family(rows: DataFrame, family: str, order: str, k: int, interleave: bool) -> DataFrame:
    """The first k of each family; in turns over the families, or family by family (column ``place``)."""
    d = rows.withColumn("rn", F.row_number().over(Window.partitionBy(family).orderBy(order))).filter(F.col("rn") <= k)
    by = ("rn", family) if interleave else (family, "rn")
    return d.withColumn("place", F.row_number().over(Window.orderBy(*by)))


def token_hit(query_tokens: Column, text_tokens: Column, ids: Column, gold: Column, least: float = 0.45) -> Column:
    """Whether evidence is right: a gold id is among its ids, or enough of the gold tokens are in its text."""
    share = F.when(F.size(query_tokens) == 0, 0.0).otherwise(F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens))
    return F.arrays_overlap(ids, gold) | (share >= least)


def all_gold(ids: Column, gold: Column) -> Column:
    return F.size(F.array_except(gold, ids)) == 0


def claims(scores: DataFrame, stated: DataFrame) -> DataFrame:
    """claim, supported: whether a primary system's value beats a baseline's (or ties, where that is allowed)."""
    a = scores.select(F.col("system").alias("primary"), F.col("value").alias("p"))
    b = scores.select(F.col("system").alias("baseline"), F.col("value").alias("b"))
    d = stated.join(a, "primary").join(b, "baseline")
    return d.select("claim", F.when(F.col("ties"), F.col("p") >= F.col("b")).otherwise(F.col("p") > F.col("b")).alias("supported"))


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, backend, first_hit: the best rank of a gold item (qid, item_id) in each backend's list."""
    there = gold.select("qid", "item_id", F.lit(1).alias("is_gold")).dropDuplicates(["qid", "item_id"])
    return ranked.join(there, ["qid", "item_id"], "left").groupBy("qid", "backend").agg(F.min(F.when(F.col("is_gold") == 1, F.col("rank"))).alias("first_hit"))


def first_whole_hits(items: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, backend, first_hit: the best rank of *one* item (qid, backend, rank, ids) that holds all gold ids."""
    d = items.join(gold.select("qid", "gold"), "qid", "left")
    whole = F.coalesce(all_gold(F.col("ids"), F.col("gold")), F.lit(False))
    return d.groupBy("qid", "backend").agg(F.min(F.when(whole, F.col("rank"))).alias("first_hit"))


def beats(hits: DataFrame, primary: str, others: tuple[str, ...]) -> DataFrame:
    """Per other backend: the questions that ``primary`` hits and the other does not, beside both totals."""
    p = hits.groupBy("qid").pivot("backend", [primary, *others]).agg(F.min("first_hit"))
    mine = F.col(primary).isNotNull()
    cases = F.explode(F.array(*(F.struct(F.lit(o).alias("other"), F.col(o).isNotNull().alias("theirs")) for o in others)))
    d = p.select("qid", mine.alias("mine"), (F.col(primary) == 1).alias("top1"), cases.alias("c"))
    return d.groupBy(F.col("c.other").alias("other")).agg(F.count("*").alias("n"), F.count_if("mine").alias("hits"), F.count_if("top1").alias("top1"), F.count_if("c.theirs").alias("other_hits"), F.count_if(F.col("mine") & ~F.col("c.theirs")).alias("beats"))
