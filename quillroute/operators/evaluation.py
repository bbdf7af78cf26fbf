"""One evaluation of systems over records of different schemas: routes, evidence, answers, overrides and rescues in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import answer_matches

#: What every record has, whatever its source; missing parts are null.
ITEM = "dataset string, qid string, question string, split string, family string, gold_answer string, gold_ids array<string>, gold_text string, tags array<string>"
# The least share of gold tokens that counts as a hit, the words that do not count, and how many items a route retrieves.
LEAST_SHARE = {"adversarial": 0.45, "public": 0.5}
OTHER_SHARE = 0.35
STOP = ("the", "a", "an", "and", "or", "to", "of", "in", "is", "are", "what", "which", "not")
TOKEN = r"[a-z0-9._§:/-]+"
DEPTH = {"hybrid": 5}
OTHER_DEPTH = 3

#: For each schema, the parts of a record as expressions of its own columns.
SCHEMAS: dict[str, dict[str, str]] = {
    "curated": {"qid": "concat('curated_', slice, '_', cast(id as string))", "question": "query", "split": "'all'", "family": "gold_route", "gold_answer": "gold_answer", "gold_ids": "gold_evidence_ids"},
    "adversarial": {"qid": "id", "question": "query", "split": "split", "family": "intended_route_family", "gold_answer": "gold_answer", "gold_ids": "array_union(gold_source_doc_ids, gold_triple_ids)", "gold_text": "gold_evidence_text", "tags": "ambiguity_tags"},
    "external": {"qid": "id", "question": "query", "split": "'all'", "family": "route_family", "gold_answer": "gold_answer", "gold_text": "gold_evidence_text"},
    "generalization": {"qid": "id", "question": "query", "split": "split", "family": "route_family", "gold_answer": "gold_answer", "gold_text": "gold_evidence_text", "tags": "case when tag <> '' then array(tag) end"},
    "public": {"qid": "id", "question": "query", "split": "split", "family": "route_family", "gold_answer": "gold_answer", "gold_ids": "gold_source_doc_ids", "gold_text": "gold_evidence_text"},
}


def eval_items(sources: dict[str, DataFrame]) -> DataFrame:
    """The records of all sources as one table (see ITEM), by the mapping of their schema; a projection of each, no shuffle."""
    spark = next(iter(sources.values())).sparkSession
    parts = [spark.createDataFrame([], ITEM)]
    for name, rows in sources.items():
        parts.append(rows.select(F.lit(name).alias("dataset"), *(F.expr(e).alias(part) for part, e in SCHEMAS[name].items())))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*parts[0].columns)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def gold_share(gold: Column, observed: Column) -> Column:
    """The share of the gold text's tokens, without common words, that the observed text has; 0 without any."""
    g = F.filter(tokens(gold), lambda t: ~t.isin(*STOP))
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(g, tokens(observed))) / F.size(g))


def evidence_hit(items: Column, least: Column) -> Column:
    """Whether items (item_id, ids, content) are right for a record: by a gold id if it has any, else by the gold text's tokens."""
    ids = F.array_distinct(F.flatten(F.transform(items, lambda x: F.array_append(F.coalesce(x["ids"], F.array().cast("array<string>")), x["item_id"]))))
    text = F.concat_ws(" ", F.transform(items, lambda x: x["content"]), F.array_sort(ids))
    by_id = F.arrays_overlap(F.col("gold_ids"), ids)
    has_gold = F.coalesce(F.size("gold_ids") > 0, F.lit(False))
    wanted = F.when(F.coalesce("gold_text", F.lit("")) != "", F.col("gold_text")).otherwise(F.col("gold_answer"))
    return F.when(has_gold, F.coalesce(by_id, F.lit(False))).otherwise(gold_share(wanted, text) >= least)


def judged_records(items: DataFrame, routes: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each record and system: what it chose and whether route, evidence, first item and answer are right.

    ``items`` as eval_items(); ``routes`` has qid, system, route, override and rescue (whether the
    system re-ranks evidence); ``evidence`` has qid, backend, rank, final_rank (after re-ranking),
    applied, item_id, ids, content. How many items count depends on the chosen backend, row by row.
    Evidence of a question and backend is a few rows; routes meet it by an equi-join.
    """
    row = F.struct("rank", "final_rank", "item_id", "ids", "content")
    found = evidence.groupBy("qid", "backend").agg(F.array_sort(F.collect_list(row)).alias("found"), F.max("applied").alias("applied"))
    d = items.join(routes, "qid").join(found.withColumnRenamed("backend", "route"), ["qid", "route"], "left")
    depth = F.lit(OTHER_DEPTH)
    for backend, n in DEPTH.items():
        depth = F.when(F.col("route") == backend, n).otherwise(depth)
    empty = F.array().cast(found.schema["found"].dataType)
    first = F.slice(F.coalesce("found", empty), F.lit(1), depth)
    # a re-ranking moves the retrieved items only; their new order is that of the final ranks among them
    again = F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["final_rank"].alias("at"), x.alias("x")))), lambda s: s["x"])
    d = d.withColumn("items", F.when(F.col("rescue"), again).otherwise(first))
    least = F.lit(OTHER_SHARE)
    for name, share in LEAST_SHARE.items():
        least = F.when(F.col("dataset") == name, share).otherwise(least)
    answer = F.coalesce(F.get("items", 0)["content"], F.lit("insufficient evidence"))
    return d.select(
        "dataset", "qid", "split", "family", "tags", "system", "route", F.size("items").alias("retrieved"),
        (F.col("route") == F.col("family")).alias("route_ok"),
        evidence_hit(F.col("items"), least).alias("evidence_ok"),
        evidence_hit(F.slice("items", 1, 1), least).alias("top1_ok"),
        F.coalesce(answer_matches(answer, F.col("gold_answer")), F.lit(False)).alias("answer_ok"),
        "override", (F.col("rescue") & F.coalesce("applied", F.lit(False))).alias("rescued"),
    )


def evaluate_records(judged: DataFrame) -> DataFrame:
    """system, dataset, scope, value, n, the four accuracies, overrides, rescues: for all records, each family and each tag.

    A record counts once in ``all``, once in its family and once in each of its tags. One aggregation.
    """
    scope = lambda name, v: F.struct(F.lit(name).alias("scope"), v.alias("value"))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: scope("tag", t))
    each = F.explode(F.concat(F.array(scope("all", F.lit("all")), scope("family", F.col("family"))), F.filter(tags, lambda t: t["value"] != "")))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return judged.withColumn("s", each).groupBy("system", "dataset", "s.scope", "s.value").agg(F.count("*").alias("n"), rate("route_ok").alias("route_accuracy"), rate("evidence_ok").alias("evidence_accuracy"), rate("top1_ok").alias("top1_accuracy"), rate("answer_ok").alias("answer_accuracy"), F.count_if("override").alias("overrides"), F.count_if("rescued").alias("rescues"))


def variants_by_split(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """variant, split, n, top1, hit_rate: how often a variant's first and any of its rows (variant, qid, doc_id, rank) is gold.

    ``gold`` has qid, split and doc_id, a row for each right document; a question with several counts once.
    """
    questions = gold.select("qid", "split").distinct()
    asked = questions.crossJoin(F.broadcast(ranked.select("variant").distinct()))  # a few variants
    hits = ranked.join(gold.select("qid", "doc_id").distinct(), ["qid", "doc_id"]).groupBy("variant", "qid").agg(F.min("rank").alias("first"))
    d = asked.join(hits, ["variant", "qid"], "left")
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return d.groupBy("variant", "split").agg(F.count("*").alias("n"), rate(F.col("first") == 1).alias("top1"), rate(F.col("first").isNotNull()).alias("hit_rate"))


# A margin below this is low, and the gain in answers from which a router is worth a further look.
LOW_MARGIN = 0.35
WORTH_A_LOOK = 0.03

_PARTS = ("route_ok", "evidence_ok", "top1_ok", "answer_ok")
_BACKENDS = ("bm25", "dense", "kg", "hybrid")


def system_reports(judged: DataFrame, margins: DataFrame) -> DataFrame:
    """A row for each system and dataset: accuracies, gaps, margins, contributions, chosen backends and the confusion.

    ``margins`` has qid, system, margin, route_part and evidence_part; a record without a row there
    (or with nulls) has no part in the means and is not of low margin; a mean of nothing is 0.
    A gap is right evidence that is not the first item. Records are first counted by family and
    chosen backend, which leaves a few rows of a system for the second step.
    """
    d = judged.join(margins, ["qid", "system"], "left")
    sums = [F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in _PARTS), F.count_if(F.col("evidence_ok") & ~F.col("top1_ok")).alias("gaps"), F.count_if("rescued").alias("rescues"), F.count_if(F.col("margin") < LOW_MARGIN).alias("low_margins")]
    means = ("margin", "route_part", "evidence_part")
    of = [x for c in means for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    cells = d.groupBy("system", "dataset", "family", "route").agg(*sums, *of)
    total = lambda c: F.sum(c)
    share = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    mean = lambda c: F.round(F.coalesce(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")), F.lit(0.0)), 5)
    confusion = F.array_join(F.array_sort(F.collect_list(F.concat("family", F.lit("->"), "route", F.lit("="), F.col("n").cast("string")))), " ")
    return cells.groupBy("system", "dataset").agg(
        total("n").alias("n"),
        *(share(c).alias(c.replace("_ok", "_accuracy")) for c in _PARTS),
        *(total(c).alias(c) for c in ("gaps", "rescues", "low_margins")),
        *(mean(c).alias(f"mean_{c}") for c in means),
        *(F.sum(F.when(F.col("route") == b, F.col("n")).otherwise(0)).alias(f"chose_{b}") for b in _BACKENDS),
        confusion.alias("confusion"),
    )


def passed(reports: DataFrame, least: dict[str, float]) -> DataFrame:
    """system, n, failed, passed: over all datasets, which of the accuracies (``least`` by name) are below what is asked, sorted."""
    d = reports.groupBy("system").agg(F.sum("n").alias("n"), *(F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 4).alias(c) for c in least))
    failed = F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.col(c) < x, F.lit(c)) for c, x in least.items())), lambda c: c.isNotNull())), ",")
    return d.select("system", "n", *least, failed.alias("failed")).withColumn("passed", F.col("failed") == "")


def recommendation(reports: DataFrame, base: str, other: str) -> DataFrame:
    """dataset, the answer accuracy of both systems, delta and what is recommended: ``keep`` the base below a gain of 0.03, else ``test_further``."""
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("answer_accuracy")))
    d = reports.filter(F.col("system").isin(base, other)).groupBy("dataset").agg(of(base).alias("base"), of(other).alias("other")).withColumn("delta", F.round(F.col("other") - F.col("base"), 6))
    return d.withColumn("recommended", F.when(F.coalesce(F.col("delta") >= WORTH_A_LOOK, F.lit(False)), "test_further").otherwise("keep"))


def structure_items(items: DataFrame) -> DataFrame:
    """The records that need structure, of the curated and the generalization set, as four datasets: deductive and relational of each.

    Generalization records are judged by text only, so they have no gold ids; tags go.
    """
    kind = F.when(F.col("family") == "kg", "deductive").when(F.col("family") == "hybrid", "relational")
    d = items.filter(F.col("dataset").isin("curated", "generalization") & kind.isNotNull())
    none = F.array().cast("array<string>")
    return d.withColumns({"gold_ids": F.when(F.col("dataset") == "curated", F.col("gold_ids")).otherwise(none), "tags": F.lit(None).cast("array<string>"), "dataset": F.concat_ws("_", "dataset", kind)})


def structure_shift(judged: DataFrame) -> DataFrame:
    """system, kind, the records and the route, evidence and answer accuracy of both sets, and the loss from the curated to the other."""
    d = judged.withColumns({"kind": F.regexp_extract("dataset", "_([a-z]+)$", 1), "curated": F.startswith("dataset", F.lit("curated_"))})
    rate = lambda c, own: F.round(F.avg(F.when(F.col("curated") == own, F.col(c).cast("double"))), 6)
    parts = {"route": "route_ok", "evidence": "evidence_ok", "answer": "answer_ok"}
    out = d.groupBy("system", "kind").agg(F.count_if("curated").alias("n_curated"), F.count_if(~F.col("curated")).alias("n_shifted"), *(rate(c, own).alias(f"{name}_{side}") for name, c in parts.items() for side, own in (("curated", True), ("shifted", False))))
    return out.withColumns({f"{name}_loss": F.round(F.col(f"{name}_curated") - F.col(f"{name}_shifted"), 6) for name in parts})
