"""Lexical retrieval: BM25 over postings, set measures, field boosts, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens, lexical_tokens, simple_tokens

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", item: str = "doc_id", item_desc: bool = True) -> DataFrame:
    """The k best rows of each query with their rank; ties by item. Spark limits each group before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.desc(item) if item_desc else F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokenized(corpus: DataFrame, tokens: Column) -> DataFrame:
    """doc_id, tokens, dl for a corpus (doc_id, title, text)."""
    return corpus.select("doc_id", tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def term_frequencies(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


#: Question tokens up to this number are sent to the postings, so that no common word is one task.
SENT = 200_000


def beside(small: DataFrame, most: int = SENT) -> DataFrame:
    """``small``, as a broadcast if it has no more than ``most`` rows: they are counted."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def bm25_scores(corpus: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score for every pair that shares a token; see bm25_features()."""
    return bm25_features(corpus, questions, k1, b).select("qid", "doc_id", "score")


def bm25_features(corpus: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score, shared (distinct tokens), ids (those that are identifiers) for every pair that shares a token.

    Okapi BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), each repetition of a query
    token counted. Only postings of query tokens are exploded into the shuffle: a semi join
    with the queries' vocabulary comes before the counts; lengths come from array sizes.
    """
    docs = tokenized(corpus, lexical_tokens(F.concat_ws(" ", "title", "text")))
    q = term_frequencies(questions.select("qid", lexical_tokens(F.col("question")).alias("tokens")), "qid").withColumnRenamed("tf", "qtf")
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # the vocabulary of the questions, its document counts and the questions' own tokens are small beside the postings
    asked = beside(q)
    sent = (lambda d: F.broadcast(d)) if asked is not q else (lambda d: d)
    vocabulary = sent(q.select("token").distinct())
    post = docs.select("doc_id", "dl", F.explode("tokens").alias("token")).join(vocabulary, "token", "left_semi").groupBy("doc_id", "dl", "token").agg(F.count("*").alias("tf"))
    df = sent(post.groupBy("token").agg(F.count("*").alias("df")))
    weighted = post.join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighted.select("token", "doc_id", part.alias("part")).join(asked, "token")
    is_id = F.size(identifier_tokens(F.array("token")))
    return scored.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("qtf")), 4).alias("score"), F.count("*").alias("shared"), F.sum(is_id).alias("ids"))


def shared_tokens(corpus: DataFrame, questions: DataFrame, doc_tokens: Column, query_tokens: Column) -> DataFrame:
    """qid, doc_id, common (sum of least frequencies), shared (distinct), ids (distinct identifiers), q_len, q_distinct, d_distinct."""
    d0 = corpus.select("doc_id", doc_tokens.alias("tokens")).withColumn("d_distinct", F.size(F.array_distinct("tokens")))
    q0 = questions.select("qid", query_tokens.alias("tokens"))
    q = term_frequencies(q0, "qid").withColumnRenamed("tf", "qtf")
    sizes = q0.select("qid", F.size("tokens").alias("q_len"), F.size(F.array_distinct("tokens")).alias("q_distinct"))
    asked = beside(q)
    vocabulary = q.select("token").distinct()
    post = d0.select("doc_id", "d_distinct", F.explode("tokens").alias("token")).join(F.broadcast(vocabulary) if asked is not q else vocabulary, "token", "left_semi")
    tf = post.groupBy("doc_id", "d_distinct", "token").agg(F.count("*").alias("tf"))
    is_id = F.size(identifier_tokens(F.array("token")))
    both = tf.withColumn("is_id", is_id).join(asked, "token").groupBy("qid", "doc_id", "d_distinct").agg(F.sum(F.least("tf", "qtf")).alias("common"), F.count("*").alias("shared"), F.sum("is_id").alias("ids"))
    return both.join(sizes, "qid")


def bm25_with_boosts(corpus: DataFrame, questions: DataFrame, per_identifier: float = 5.0, per_token: float = 0.05) -> DataFrame:
    """BM25 plus a bonus per shared identifier and per shared distinct token, from one pass over the postings."""
    f = bm25_features(corpus, questions)
    return f.select("qid", "doc_id", F.round(F.col("score") + per_identifier * F.col("ids") + per_token * F.col("shared"), 4).alias("score"))


def variant_top_k(features: DataFrame, variants: dict[str, tuple[float, float]], k: int) -> DataFrame:
    """variant, qid, doc_id, score, rank: bm25_features() ranked under each variant's (per_identifier, per_token).

    Variants are data: an array beside each scored pair, so one scan and one set of postings
    serve them all, and only the k best of each variant are shuffled.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), F.round(F.col("score") + i * F.col("ids") + t * F.col("shared"), 4).alias("score")) for name, (i, t) in variants.items())))
    d = features.select("qid", "doc_id", each.alias("v")).select("v.variant", "qid", "doc_id", "v.score")
    w = Window.partitionBy("variant", "qid").orderBy(F.desc("score"), F.desc("doc_id"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap_scores(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """Multiset overlap: shared token occurrences over the query's tokens."""
    s = shared_tokens(corpus, questions, simple_tokens(F.col("text")), simple_tokens(F.col("question")))
    return s.select("qid", "doc_id", F.round(F.col("common") / F.col("q_len"), 6).alias("score"))


def jaccard_scores(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    s = shared_tokens(corpus, questions, simple_tokens(F.col("text")), simple_tokens(F.col("question")))
    return s.select("qid", "doc_id", F.round(F.col("shared") / (F.col("q_distinct") + F.col("d_distinct") - F.col("shared")), 6).alias("score"))


def field_boosts(fields: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, doc_id, boost, matched fields, for ``fields`` (doc_id, title, ids, aliases).

    8 per identifier found in the question, 4 for each of at most two aliases of four
    letters or more, 3 if enough of the title's tokens occur. Candidates are pairs that
    share a token, found by an equi-join.
    """
    words = fields.select("doc_id", "title", "ids", "aliases", F.explode(F.array_distinct(simple_tokens(F.concat_ws(" ", F.col("title"), F.array_join("aliases", " "))))).alias("token"))
    q = questions.select("qid", F.lower("question").alias("low"), F.explode(F.array_distinct(simple_tokens(F.col("question")))).alias("token"))
    pairs = words.join(q, "token").groupBy("qid", "doc_id", "title", "ids", "aliases", "low").agg(F.collect_set("token").alias("hits"))
    padded = F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9]+", " "), F.lit(" "))
    found = F.size(F.filter("ids", lambda x: F.contains(F.col("low"), F.lower(x))))
    alias_form = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(" "))
    aliased = F.size(F.filter("aliases", lambda x: (F.length(x) >= 4) & F.contains(padded, alias_form(x))))
    title = F.array_distinct(simple_tokens(F.col("title")))
    titled = F.size(F.array_intersect(title, F.col("hits"))) >= F.least(F.lit(2), F.size(title))
    d = pairs.withColumns({"n_ids": found, "n_aliases": F.least(F.lit(2), aliased), "title_hit": titled & (F.size(title) > 0)})
    boost = 8.0 * F.col("n_ids") + 4.0 * F.col("n_aliases") + F.when(F.col("title_hit"), 3.0).otherwise(0.0)
    return d.select("qid", "doc_id", "n_ids", "n_aliases", "title_hit", boost.alias("boost")).filter("boost > 0")


def lexical_confidence(boosts: DataFrame) -> DataFrame:
    """Per question the best boost as a confidence up to 1, and whether it decides for lexical retrieval."""
    return boosts.groupBy("qid").agg(F.max("boost").alias("best")).select("qid", F.least(F.lit(1.0), F.col("best") / 8.0).alias("confidence"), (F.col("best") >= 3.0).alias("arbitrate"))
