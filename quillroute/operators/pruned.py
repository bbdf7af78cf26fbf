"""Exact BM25 top-k from a stored index: postings in blocks with their greatest part, and bounds that skip most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..sources.shared import written
from .lexical import K1, B, term_frequencies, top_k
from .resident import document_counts, ranked

TABLES = ("terms", "postings", "documents")


def lexical_index(corpus: DataFrame, block: int = 128, run: int = 65_536, k1: float = K1, b: float = B) -> dict[str, DataFrame]:
    """The tables of an index over (doc_id, title, text), for save_index().

    terms: token, df, idf, most; postings: token, part_no, block, n, most, items (doc_id, part);
    documents: doc_id, dl, tokens, tfs; all written. A part is what one occurrence in a question adds to
    the score over the token's idf; terms.most is with it. Postings are made where the documents
    lie: each ``run`` of documents of a task has its own, by descending part in blocks of
    ``block``, so no posting is shuffled and no token is sorted in one task.
    """
    documents = written(document_counts(corpus))
    stats = documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    postings = written(_postings(documents, stats["avgdl"] or 1.0, block, run, k1, b))
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    terms = written(terms.select("token", "df", idf.alias("idf"), (idf * F.col("most")).alias("most")))
    return {"terms": terms, "postings": postings, "documents": documents}


def _postings(documents: DataFrame, avgdl: float, block: int, run: int, k1: float, b: float, most: int = 4_000_000) -> DataFrame:
    """token, part_no, block, n, most, items of runs of ``run`` documents, or of fewer with ``most`` different tokens."""

    def made(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20

        def blocks_of(parts):
            tokens = pa.concat_arrays([p.column(2).flatten() for p in parts]).dictionary_encode()
            ids = pa.concat_arrays([p.column(0) for p in parts])
            tf = np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).astype(float)
            dl = np.concatenate([p.column(1).to_numpy() for p in parts]).astype(float)
            row = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts]))
            code, part = tokens.indices.to_numpy().astype(np.int64), tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            order = np.lexsort((-part, code))
            code, part, row = code[order], part[order], row[order]
            first = np.searchsorted(code, code)
            place = np.arange(len(code)) - first
            begins = np.nonzero(place % block == 0)[0]
            for at in range(0, len(begins), 20_000):
                some = begins[at : at + 20_000]
                end = begins[at + 20_000] if at + 20_000 < len(begins) else len(code)
                offsets = pa.array(np.append(some, end).astype(np.int64) - some[0], pa.int32())
                items = pa.StructArray.from_arrays([ids.take(pa.array(row[some[0] : end])), pa.array(part[some[0] : end])], ["doc_id", "part"])
                columns = [tokens.dictionary.take(pa.array(code[some])), pa.array(np.full(len(some), number)), pa.array((place[some] // block).astype(np.int32)), pa.array(np.diff(np.append(some, end)).astype(np.int32)), pa.array(part[some]), pa.ListArray.from_arrays(offsets, items)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "part_no", "block", "n", "most", "items"])

        parts, n, total = [], 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, min(run, 2000)):
                part = batch.slice(begin, min(run, 2000))
                size = len(part.column(2).flatten())
                if parts and (n + part.num_rows > run or total + size > most):
                    yield from blocks_of(parts)
                    parts, n, total, number = [], 0, 0, number + 1
                parts.append(part)
                n, total = n + part.num_rows, total + size
        if parts:
            yield from blocks_of(parts)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "dl", "tokens", "tfs").mapInArrow(made, f"token string, part_no long, block int, n int, most double, items array<struct<doc_id: {kind}, part: double>>")


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a broadcast if it has at most ``most`` rows, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _ranked_among(index: dict[str, DataFrame], ids: DataFrame, questions: DataFrame, k: int, most: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best of the documents ``ids``, scored from their own rows, where these lie."""
    counts = {"df": index["terms"].select("token", "df"), "stats": index["documents"].agg(F.count("*").alias("n"), F.sum("dl").alias("words"))}
    docs = index["documents"].join(_small(ids, most), "doc_id", "left_semi")
    return ranked(docs, questions.select("qid", lexical_tokens(F.col("question")).alias("tokens")), k, counts=counts).drop("variant")


def candidates(index: dict[str, DataFrame], questions: DataFrame, k: int, slack: float = 1e-3, broadcast_up_to: int = 200_000) -> DataFrame:
    """qid, doc_id of the pairs that may be among the k best of a question; all others are proven not to be.

    1. The first blocks of the question's tokens name documents; the k-th best of their exact
       scores is a floor. 2. Tokens that together cannot reach the floor name nothing, and blocks of
       the others only if they can with all other tokens at their best. 3. A document whose known
       parts and the bounds of its unread tokens stay below the floor goes.
    """
    q = written(term_frequencies(questions.select("qid", lexical_tokens(F.col("question")).alias("tokens")), "qid").withColumnRenamed("tf", "qtf"))
    bounds = written(index["terms"].join(_small(q, broadcast_up_to), "token").select("qid", "token", (F.col("qtf") * F.col("idf")).alias("weight"), (F.col("most") * F.col("qtf")).alias("bound")))
    asked = _small(bounds, broadcast_up_to)
    first = index["postings"].filter("block = 0").join(asked, "token").select("qid", "weight", F.explode("items").alias("x"))
    named = first.groupBy("qid", F.col("x.doc_id").alias("doc_id")).agg(F.sum(F.col("x.part") * F.col("weight")).alias("score"))
    seeds = written(top_k(named, 4 * k).select("doc_id").distinct())
    floors = _ranked_among(index, seeds, questions, k, broadcast_up_to).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("qid", (F.col("least") - slack).alias("floor"))
    up = Window.partitionBy("qid").orderBy("bound", "token")
    d = bounds.join(floors, "qid", "left").withColumns({"floor": F.coalesce("floor", F.lit(float("-inf"))), "total": F.sum("bound").over(Window.partitionBy("qid")), "reach": F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, 0))})
    essential = written(d.filter(F.col("reach") >= F.col("floor")).select("qid", "token", "weight", "bound", "floor", "total"))
    read = index["postings"].join(_small(essential, broadcast_up_to), "token").filter(F.col("most") * F.col("weight") + F.col("total") - F.col("bound") >= F.col("floor"))
    seen = read.select("qid", "weight", "bound", "floor", "total", F.explode("items").alias("x"))
    known = seen.groupBy("qid", F.col("x.doc_id").alias("doc_id"), "floor", "total").agg(F.sum(F.col("x.part") * F.col("weight")).alias("known"), F.sum("bound").alias("settled"))
    return known.filter(F.col("known") + F.col("total") - F.col("settled") >= F.col("floor")).select("qid", "doc_id")


def pruned_top_k(index: dict[str, DataFrame], questions: DataFrame, k: int, broadcast_up_to: int = 200_000) -> DataFrame:
    """qid, doc_id, score, rank: what top_k(bm25_scores()) gives, scoring only documents of candidates()."""
    found = written(candidates(index, questions, k, broadcast_up_to=broadcast_up_to).select("doc_id").distinct())
    return _ranked_among(index, found, questions, k, broadcast_up_to)
