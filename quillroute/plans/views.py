"""The engine's entities as views over the given tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cues that make a benchmark text a question of a known family, by item_id mod 4.
CUES = ("Find exact code", "What concept feels like", "Is a member a class of", "What bridge connects")
FAMILIES = ("lexical", "semantic", "deductive", "relational")
GOLD = ("bm25", "dense", "kg", "hybrid")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: tuple[str, ...], by: str):
    out = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(F.col(by) == i, values[i]).otherwise(out)
    return out


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, family, gold: every benchmark text behind the cue of its family."""
    b = table(spark, sf_dir, "benchmark").withColumn("m", F.pmod("item_id", F.lit(4)))
    return b.select(F.col("item_id").alias("qid"), F.concat_ws(" ", _choice(CUES, "m"), "text").alias("question"), _choice(FAMILIES, "m").alias("family"), _choice(GOLD, "m").alias("gold"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: the user's turns of all conversations."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text", "source", "lang")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the star schema as (triple_id, subject, predicate, object, source)."""
    c, s, n, r, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "part"))

    def fact(d: DataFrame, source: str, sid, predicate: str, oid) -> DataFrame:
        rows = d.select(sid.alias("subject"), F.lit(predicate).alias("predicate"), oid.alias("object"))
        return rows.select(F.concat_ws("_", F.lit("kg"), "subject", "predicate", "object").alias("triple_id"), "subject", "predicate", "object", F.lit(source).alias("source"))

    def name(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    parts = [
        fact(c, "customer", name("c", "c_custkey"), "is_a", name("n", "c_nationkey")),
        fact(s, "supplier", name("s", "s_suppkey"), "is_a", name("n", "s_nationkey")),
        fact(n, "nation", name("n", "n_nationkey"), "is_a", name("r", "n_regionkey")),
        fact(p, "part", name("p", "p_partkey"), "has_property", F.col("p_brand")),
        fact(c, "customer", name("c", "c_custkey"), "in_segment", F.col("c_mktsegment")),
    ]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


# The same views as SQL, for the oracle.
SQL = {
    "questions": """questions AS (SELECT item_id AS qid, concat_ws(' ', CASE item_id % 4 WHEN 0 THEN 'Find exact code' WHEN 1 THEN 'What concept feels like' WHEN 2 THEN 'Is a member a class of' ELSE 'What bridge connects' END, text) AS question,
 CASE item_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' WHEN 2 THEN 'deductive' ELSE 'relational' END AS family,
 CASE item_id % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' WHEN 2 THEN 'kg' ELSE 'hybrid' END AS gold FROM benchmark)""",
    "user_turns": "user_turns AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user')",
    "corpus": "corpus AS (SELECT doc_id, source AS title, text, source, lang FROM documents)",
    "edges": """facts AS (SELECT 'c' || c_custkey AS subject, 'is_a' AS predicate, 'n' || c_nationkey AS object, 'customer' AS source FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'is_a', 'n' || s_nationkey, 'supplier' FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'is_a', 'r' || n_regionkey, 'nation' FROM nation
 UNION ALL SELECT 'p' || p_partkey, 'has_property', p_brand, 'part' FROM part
 UNION ALL SELECT 'c' || c_custkey, 'in_segment', c_mktsegment, 'customer' FROM customer),
 edges AS (SELECT concat_ws('_', 'kg', subject, predicate, object) AS triple_id, * FROM facts)""",
}
