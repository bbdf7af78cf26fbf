"""A runtime corpus that changes: last-write-wins upserts, and lexical counts that follow by subtraction and addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..sources.shared import written
from .lexical import K1, B, beside, term_frequencies
from .resident import document_counts, ranked

#: Tables of a counted corpus, for save_index(): a row per document, per token, and for all.
TABLES = ("tf", "df", "stats")
#: Changed ids up to this number go to the rows; beyond, both sides are shuffled, a document's counts as one row.
MANY = 1_000_000


def latest(changes: DataFrame, position: str) -> DataFrame:
    """The last row of each doc_id by ``position``: one aggregation, map-side first, so a row sent over and over is one row in the shuffle."""
    rest = [c for c in changes.columns if c not in ("doc_id", position)]
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct(*rest), position).alias("r"))
    return last.select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def upserted(corpus: DataFrame, changes: DataFrame, position: str, many: int = MANY) -> DataFrame:
    """``corpus`` with the last change of each document put in its place; a change with a null text takes the document out.

    Documents without a change stay where they are: the changed ids, if few (they are counted), go to all tasks.
    """
    last = latest(changes, position)
    kept = corpus.join(beside(last.select("doc_id"), many), "doc_id", "left_anti")
    return kept.unionByName(last.filter("text is not null").select(*corpus.columns))


def counted(corpus: DataFrame) -> dict[str, DataFrame]:
    """tf: doc_id, dl, tokens, tfs, written; df: token, df; stats: n, words of (doc_id, title, text)."""
    tf = written(document_counts(corpus))
    stats = tf.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    return {"tf": tf, "df": _holders(tf).select("token", "df"), "stats": stats}


def _holders(tf: DataFrame) -> DataFrame:
    """token, df: tasks count their own documents first."""
    return tf.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def recounted(counts: dict[str, DataFrame], corpus: DataFrame, changes: DataFrame, position: str, many: int = MANY) -> dict[str, DataFrame]:
    """The counts after upserted(): only the changed documents are tokenized; theirs are subtracted and added.

    ``counts`` are the saved counts of ``corpus``, the table before the change; they have a row
    of each of its documents, so the corpus itself is not read.
    """
    last = latest(changes, position)
    ids = beside(written(last.select("doc_id")), many)
    new = counted(last.filter("text is not null").select("doc_id", "title", "text"))
    gone = counts["tf"].join(ids, "doc_id", "left_semi")
    tf = counts["tf"].join(ids, "doc_id", "left_anti").unionByName(new["tf"])
    change = new["df"].unionByName(_holders(gone).select("token", (-F.col("df")).alias("df"))).groupBy("token").agg(F.sum("df").alias("change"))
    df = counts["df"].join(change, "token", "full_outer").select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("df")).filter("df > 0")
    taken = gone.agg(F.count("*").alias("t_n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t_words"))
    added = new["stats"].select(F.col("n").alias("a_n"), F.col("words").alias("a_words"))
    stats = counts["stats"].crossJoin(taken).crossJoin(added).select((F.col("n") - F.col("t_n") + F.col("a_n")).alias("n"), (F.col("words") - F.col("t_words") + F.col("a_words")).alias("words"))
    return {"tf": tf, "df": df, "stats": stats}


def counted_scores(counts: dict[str, DataFrame], questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score of all pairs: BM25 from counts; what bm25_scores() gives for the corpus they were made of."""
    q = term_frequencies(questions.select("qid", lexical_tokens(F.col("question")).alias("tokens")), "qid").withColumnRenamed("tf", "qtf")
    wanted = beside(q.join(counts["df"], "token").select("qid", "token", "qtf", "df"))
    tf = counts["tf"].select("doc_id", "dl", F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("tfs").alias("tf"))).alias("x")).select("doc_id", "dl", "x.*")
    d = tf.join(wanted, "token").crossJoin(F.broadcast(counts["stats"].select("n", (F.col("words") / F.col("n")).alias("avgdl"))))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return d.groupBy("qid", "doc_id").agg(F.round(F.sum(part * F.col("qtf")), 4).alias("score"))


def counted_top_k(counts: dict[str, DataFrame], questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """qid, doc_id, score, rank: what top_k(counted_scores()) gives; pairs are scored where the counts lie, none is shuffled."""
    asked = questions.select("qid", lexical_tokens(F.col("question")).alias("tokens"))
    return ranked(counts["tf"], asked, k, k1=k1, b=b, counts=counts).drop("variant")
