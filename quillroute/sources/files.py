"""Readers and writers: documents, triples, benchmarks, annotations, graphs, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import flattened_json, headings, plain_text, stable_id
from ..operators.graph import turtle_line

DOCUMENT = T.StructType([T.StructField(n, T.StringType(), False) for n in ("doc_id", "title", "text", "source")])
TRIPLE = T.StructType([T.StructField(n, T.StringType(), False) for n in ("triple_id", "subject", "predicate", "object", "source_doc_id")])
MODEL = T.StructType([T.StructField("label", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())])
SUFFIXES = ("txt", "md", "html", "htm", "json")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; malformed rows and missing fields stop the read."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return strict(d, [f.name for f in schema.fields if not f.nullable])


def strict(rows: DataFrame, required: list[str]) -> DataFrame:
    """Raises on the first row that lacks a required field."""
    for c in required:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field: {c}")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, DOCUMENT)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRIPLE)


def read_triples_any(spark: SparkSession, json_path: str | None, csv_path: str | None) -> DataFrame:
    """Triples of a JSON file and a CSV file with a header; a missing one is skipped."""
    parts = []
    if json_path:
        parts.append(spark.read.schema(TRIPLE).option("multiLine", True).json(json_path))
    if csv_path:
        parts.append(spark.read.schema(TRIPLE).option("header", True).csv(csv_path))
    if not parts:
        return spark.createDataFrame([], TRIPLE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_turtle(edges: DataFrame, path: str, prefix: str = "ex", namespace: str = "http://example.org/") -> None:
    """The graph as text: a prefix line, then one line per edge, in one sorted file set."""
    head = edges.sparkSession.createDataFrame([(0, f"@prefix {prefix}: <{namespace}> .")], "place int, value string")
    body = edges.select(F.lit(1).alias("place"), turtle_line(prefix).alias("value"))
    head.unionByName(body).orderBy("place", "value").select("value").write.mode("overwrite").text(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text, source, sections of all text, markup and JSON files below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    raw = raw.withColumn("suffix", suffix).filter(F.col("suffix").isin(*SUFFIXES))
    stem = F.initcap(F.trim(F.translate(F.regexp_replace("name", r"\.[^.]+$", ""), "_-", "  ")))
    flat = F.when(F.col("suffix") == "json", flattened_json(F.col("value"))).otherwise(F.col("value"))
    d = raw.select(stem.alias("title"), flat.alias("value"), "file", "suffix")
    return d.select(stable_id(F.col("file"), F.col("value")).alias("doc_id"), "title", plain_text(F.col("value")).alias("text"), F.concat(F.lit("file:"), "suffix", F.lit(":"), "file").alias("source"), headings(F.col("value")).alias("sections"))


def read_headed_text(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Text files whose first line may be ``prefix`` + JSON: file, meta (map), body."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    first = F.substring_index("value", "\n", 1)
    headed = F.startswith(F.col("value"), F.lit(prefix))
    meta = F.when(headed, F.from_json(F.substr(first, F.lit(len(prefix) + 1)), "map<string,string>"))
    body = F.when(headed, F.substr(F.col("value"), F.length(first) + 2)).otherwise(F.col("value"))
    return raw.select("file", F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("meta"), body.alias("body"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header of one folder, with the file each row is from."""
    return spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name"))


def read_benchmark(spark: SparkSession, path: str, schema: T.StructType, split: str | None = None) -> DataFrame:
    d = read_jsonl(spark, path, schema)
    return d.filter(F.col("split") == split) if split else d


def write_long_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def save_model(weights: DataFrame, path: str) -> None:
    weights.select("label", "feature", "weight").write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MODEL)


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """An index as Parquet tables, never as pickled objects."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def filler_documents(spark: SparkSession, n: int, topics: tuple[str, ...]) -> DataFrame:
    """Generated documents: topic i mod the number of topics, and a padded number as id."""
    topic = F.element_at(F.array(*(F.lit(t) for t in topics)), (F.col("id") % len(topics) + 1).cast("int"))
    return spark.range(n).select(F.concat(F.lit("filler_"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("doc_id"), F.initcap(topic).alias("title"), F.concat(F.lit("Background note on "), topic, F.lit(".")).alias("text"), F.lit("generated").alias("source"))


def union_sorted(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("doc_id")
