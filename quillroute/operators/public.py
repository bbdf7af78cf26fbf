"""Lexical retrieval over public documents: enriched texts, boosts by field, and when they decide the route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifiers, simple_tokens
from ..sources.shared import written
from .lexical import beside
from .resident import boosted_top_k

# Points per matched identifier, per alias (of at most two) and for a title; the shortest alias and title word; what decides.
PER_IDENTIFIER, PER_ALIAS, FOR_TITLE = 8.0, 4.0, 3.0
MOST_ALIASES, LEAST_LETTERS, TITLE_WORDS = 2, 4, 2
DECIDES = 3.0
#: Fixed value: names that make a question one about an identifier though it has none.
NAMED = r"\b(?:rfc|icd|hipaa|cfr|tf-idf|tfidfvectorizer|dataclasses?|jsonb|torch\.nn|numpy\.linalg)\b"


def about_identifiers(question: Column) -> Column:
    """Whether a question has an identifier or names a kind of them."""
    return (F.size(identifiers(question)) > 0) | F.lower(question).rlike(NAMED)


def enriched(records: DataFrame) -> DataFrame:
    """doc_id, title, text of records (doc_id, title, canonical_identifiers, aliases, lead_summary, text), with what is known before the body."""
    said = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    lines = (said("Title: ", F.col("title")), said("Canonical identifiers: ", F.array_join("canonical_identifiers", ", ")), said("Aliases: ", F.array_join("aliases", ", ")), said("Lead summary: ", F.col("lead_summary")), F.lit("Body:"), F.nullif(F.trim("text"), F.lit("")))
    return records.select("doc_id", "title", F.concat_ws("\n", *lines).alias("text"))


def _spans(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, kind, name: every stretch of a question as long as a name of its kind; aliases must stand between word ends.

    As many lengths are tried as names have, so the rows of a question do not grow with the names.
    """
    widths = sorted((r["kind"], r["width"]) for r in names.select("kind", F.length("name").alias("width")).distinct().collect())
    if not widths:
        return questions.select("qid", F.lit("").alias("kind"), F.lit("").alias("name")).limit(0)
    tried = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(w).alias("width")) for k, w in widths)))
    low = questions.select("qid", F.lower("question").alias("low"), tried.alias("t")).select("qid", "low", "t.*").filter(F.length("low") >= F.col("width"))
    inner = lambda at: F.substr(F.col("low"), at, F.lit(1)).rlike("[a-z0-9]")
    apart = lambda p: (F.col("kind") != "alias") | ~(((p > 1) & inner(p - 1)) | inner(p + F.col("width")))
    places = F.filter(F.sequence(F.lit(1), F.length("low") - F.col("width") + 1), apart)
    return low.select("qid", "kind", F.explode(F.transform(places, lambda p: F.substr(F.col("low"), p, F.col("width")))).alias("name")).distinct()


def public_boosts(records: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, doc_id, n_identifiers, n_aliases, title_hit, boost, fields for each pair with a boost.

    ``records`` has doc_id, title, canonical_identifiers and aliases. An identifier counts wherever
    it stands in the question, an alias of four letters or more only as whole words, a title if two
    of its words of four letters or more occur (or its only one). All are equi-joins: identifiers
    and aliases meet stretches of the question of equal length, title words meet its words. The
    questions' side is broadcast if it is small, so a common word or name is no single task.
    Null questions, titles and lists match nothing; an identifier or alias listed twice counts once.
    """
    listed = lambda kind, c: records.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(c)).alias("as_is"))
    names = listed("identifier", F.col("canonical_identifiers")).unionByName(listed("alias", F.col("aliases")))
    names = names.select("doc_id", "kind", F.lower("as_is").alias("name")).filter((F.length("name") >= LEAST_LETTERS) | (F.col("kind") == "identifier") & (F.col("name") != ""))
    named = names.join(beside(_spans(questions, names)), ["kind", "name"])
    by_name = named.groupBy("qid", "doc_id").agg(F.count_if(F.col("kind") == "identifier").alias("n_identifiers"), F.count_if(F.col("kind") == "alias").alias("n_aliases"), F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("of"))
    title = records.select("doc_id", F.filter(simple_tokens(F.col("title")), lambda t: F.length(t) >= LEAST_LETTERS).alias("words"))
    asked = beside(questions.select("qid", F.explode(F.array_distinct(simple_tokens(F.col("question")))).alias("word")))
    said = title.select("doc_id", F.size("words").alias("of"), F.explode("words").alias("word")).join(asked, "word")
    zero = F.lit(0).cast("long")
    by_title = said.groupBy("qid", "doc_id").agg(zero.alias("n_identifiers"), zero.alias("n_aliases"), F.count("*").alias("n_words"), F.max("of").alias("of")).filter(F.col("n_words") >= F.least(F.lit(TITLE_WORDS), F.col("of")))
    both = by_name.unionByName(by_title).groupBy("qid", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_identifiers", "n_aliases")), (F.max("of") > 0).alias("title_hit"))
    boost = PER_IDENTIFIER * F.col("n_identifiers") + PER_ALIAS * F.least(F.lit(MOST_ALIASES), F.col("n_aliases")) + F.when(F.col("title_hit"), FOR_TITLE).otherwise(0.0)
    fields = F.concat_ws(",", F.when(F.col("n_aliases") > 0, "alias"), F.when(F.col("n_identifiers") > 0, "identifier"), F.when(F.col("title_hit"), "title"))
    return both.select("qid", "doc_id", "n_identifiers", "n_aliases", "title_hit", boost.alias("boost"), fields.alias("fields"))


def public_top_k(records: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, base, boost, fields, rank: BM25 over enriched texts, ranked whole with the boosts, the k best.

    Boosts go to the documents, which are scored where they lie; see resident.ranked(). Only pairs
    with a boost and each task's best are shuffled. A document with a boost is ranked though it
    shares no token with the question.
    """
    boosts = written(public_boosts(records, questions).select("qid", "doc_id", "boost", "fields"))
    best = written(boosted_top_k(enriched(records), questions, boosts.select("qid", "doc_id", "boost"), k))
    own = boosts.join(beside(best.select("qid", "doc_id")), ["qid", "doc_id"], "left_semi").select("qid", "doc_id", "fields")
    return best.join(own, ["qid", "doc_id"], "left").select("qid", "doc_id", "base", "boost", F.coalesce("fields", F.lit("")).alias("fields"), "score", "rank")


def arbitrated_routes(routed: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds about_identifiers, top_doc_id, boost, fields, confidence, decides, arbitrated_route and overrode to routes.

    ``routed`` has qid, question and route; ``ranked`` is public_top_k(). The first document of a
    question gives the confidence (its boost over that of an identifier, 1 at most). The route
    becomes lexical only where the question is about identifiers and the first document's boost
    decides; questions without any document keep their route, with confidence 0.
    """
    first = ranked.filter("rank = 1").select("qid", F.col("doc_id").alias("top_doc_id"), "boost", "fields")
    d = routed.join(first, "qid", "left").withColumns({"boost": F.coalesce("boost", F.lit(0.0)), "fields": F.coalesce("fields", F.lit("")), "about_identifiers": F.coalesce(about_identifiers(F.col("question")), F.lit(False))})
    d = d.withColumns({"confidence": F.least(F.lit(1.0), F.col("boost") / PER_IDENTIFIER), "decides": (F.col("boost") >= DECIDES) & (F.col("fields") != "")})
    route = F.when(F.col("about_identifiers") & F.col("decides"), "bm25").otherwise(F.col("route"))
    return d.withColumn("arbitrated_route", route).withColumn("overrode", F.col("arbitrated_route") != F.col("route"))


def arbitration_effect(arbitrated: DataFrame) -> DataFrame:
    """family, n, the accuracy of both routes, overrides, and how many of them mended or spoiled a route; one aggregation, with a row for all."""
    was, now = F.col("route") == F.col("gold"), F.col("arbitrated_route") == F.col("gold")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    each = arbitrated.withColumn("family", F.explode(F.array(F.lit("all"), F.col("family"))))
    return each.groupBy("family").agg(F.count("*").alias("n"), rate(was).alias("computed_accuracy"), rate(now).alias("arbitrated_accuracy"), F.count_if("overrode").alias("overrides"), F.count_if(~was & now).alias("mended"), F.count_if(was & ~now).alias("spoiled"))
