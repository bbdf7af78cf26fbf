"""A corpus pipeline in five stages, each one operator over all that the stage before kept.

Null ids, null columns, repeated rows and further columns of any name pass through all stages
but the last, which returns places only; an empty table gives an empty result of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillroute.llm import linededup, neardup, packing, quality, toxicity
from quillroute.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null and empty texts have too few words and go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic; null and empty texts are not."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier line is similar to; one without lines left stays, empty."""
    return linededup.drop_repeated_lines(docs, linededup.EVERY_LINE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words are linked with nothing and stay."""
    return neardup.drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in the packed sequences; a null or empty text is its end mark alone."""
    # a small table of words: the executors' memory also serves the stages before
    return packing.pack(docs, packing.PackingParams(known_words=300_000))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Not expressible in SQL: learned cutoffs, a regression, BPE and packing. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
