"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts define the gaps between words.
ASCII_SPACE = " \t\n\r\x0b\x0c"
_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: dict[str, bool] = {}
#: Arrow batches that the operators can afford, and what Spark would take: rows and bytes
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("2000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("8m", "67108864b")}


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application."""
    sc = spark.sparkContext
    # whole texts and packed arrays are long rows: Spark's usual batch of them would be tens of megabytes
    for key, (value, usual) in _BATCH.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)
    if _shipped.get(sc.applicationId):
        return
    target = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}_{sc.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset in local mode, as
    in tests, a folder of this machine stands in for it. Other machines could not read that.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quillroute-shared")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillroute-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it only reads files, projects and filters, so that each run deals its rows alike; else a written copy."""
    nodes = [re.sub(r"^[\s:+\-|]*", "", line).split(" ")[0].split("[")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    return df if all(n in ("Project", "Filter", "Relation") for n in nodes) else cut(df)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a distinct number of each row that stays the same however the rows are dealt into tasks.

    A row's place in its Parquet file is its own, whatever splits a job reads; splits follow the
    executors alive when a job is planned, so ids made of task numbers would move between jobs.
    A number is a hash of the file's path, of as few bits as tell all files apart, and that place.
    A table that is not read straight from Parquet is written first.
    """
    df = settled(df)
    try:
        df.select("_metadata.row_index")
    except AnalysisException:  # another format
        df = cut(df)
    places = df.select("_metadata.file_path", "_metadata.row_index").groupBy("file_path").agg(F.max("row_index").alias("last"))
    tag = lambda path, bits: F.pmod(F.xxhash64(path), F.lit(1 << bits))
    widths = (0, 12, 20, 28, 36)
    found = places.agg(F.count("*").alias("files"), F.coalesce(F.max("last"), F.lit(0)).alias("last"), *(F.count_distinct(tag("file_path", b)).alias(str(b)) for b in widths)).first()
    for bits in widths:
        if found[str(bits)] == found["files"] and found["last"] < 1 << (63 - bits):
            return df.withColumn(name, F.shiftleft(tag("_metadata.file_path", bits), 63 - bits).bitwiseOR(F.col("_metadata.row_index")) if bits else F.col("_metadata.row_index"))
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_caches: dict[str, Callable[[], bool]] = {}


def worker_cache(name: str, clear: Callable[[], bool]) -> None:
    """Registers what a worker keeps between tasks; ``clear`` empties it and says whether it held anything."""
    _caches[name] = clear


def drop_caches(keep: str | None = None) -> None:
    """Empties what other operators keep in this worker: workers outlive stages."""
    if any([clear() for name, clear in _caches.items() if name != keep]):
        release_memory()


def map_batches(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], keep: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped. ``keep`` names its own worker cache."""
    ship_package(df.sparkSession)

    def run(batches):
        drop_caches(keep)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        release_memory()  # once a task: workers outlive stages

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a round trip through Python's str."""
    return column.cast(pa.binary()).to_pylist()


def texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of ``key``: all rows when there are fewer.

    The expected size is ``rows``; a binomial spread of a few hundredths may be added.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < F.lit(share))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Least node id reachable from every node of ``edges``: columns node, component.

    Alternating large-star and small-star steps over an edge table; each round is two
    shuffles of the (shrinking) edges, written to the shared folder. Nothing is collected
    but one count per round.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u is not null and v is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("x")).select("x.u", "x.v")
        e = cut(small.filter("u <> v").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if state == last or state[0] == state[2] and e.alias("a").join(e.select(F.col("u").alias("w")).alias("b"), F.col("a.v") == F.col("b.w"), "left_semi").isEmpty():
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("m", "node").alias("component"))


class Ids(dict):
    """Numbers for the distinct keys looked up, in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a sorted array takes a new value."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


# -- columns as bytes -------------------------------------------------------------------


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Several numpy arrays as one compressed value; equal bytes of neighbours lie together."""
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{name}:{a.dtype.name}:{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress("|".join(head).encode() + b"\n" + b"".join(body))


def unpack_arrays(raw: bytes, names: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """The arrays of pack_arrays(), or some of them."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = raw.index(b"\n")
    out = {}
    pos = at + 1
    for spec in raw[:at].decode().split("|"):
        name, dtype, n = spec.split(":")
        width = np.dtype(dtype).itemsize
        if names is None or name in names:
            flat = np.frombuffer(raw, np.uint8, int(n) * width, pos)
            out[name] = np.ascontiguousarray(flat.reshape(width, int(n)).T).reshape(-1).view(dtype)
        pos += int(n) * width
    return out


class Bits:
    """A fixed-size set of 64-bit keys that may answer yes wrongly, never no."""

    def __init__(self, bits: int = 26, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 3), np.uint8) if words is None else words

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def add(self, keys: np.ndarray) -> None:
        at = self._at(keys)
        np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bits_of(df: DataFrame, columns: list[str], key: Callable[..., np.ndarray] | None = None, bits: int = 26) -> Bits:
    """Keys as Bits, put together in pieces of fixed size on the executors.

    A key is the one column, or what ``key`` makes of the columns' arrays.
    """
    pieces = 64

    def local(batches):
        drop_caches()
        found = Bits(bits)
        for batch in batches:
            if batch.num_rows:
                arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                found.add(key(*arrays) if key else arrays[0])
        if found.words.any():
            for i, part in enumerate(np.split(found.words, pieces)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "words": pa.array([pack_arrays(w=part)], pa.binary())})

    def merge(key_, pdf):
        total = np.zeros((1 << (bits - 3)) // pieces, np.uint8)
        for raw in pdf["words"]:
            total |= unpack_arrays(raw)["w"]
        return pd.DataFrame({"piece": [key_[0]], "words": [pack_arrays(w=total)]})

    ship_package(df.sparkSession)
    schema = "piece int, words binary"
    rows = df.select(*(F.col(c).cast("long").alias(c) for c in columns)).mapInArrow(local, schema).groupBy("piece").applyInPandas(merge, schema).collect()
    out = Bits(bits)
    step = len(out.words) // pieces
    for r in rows:
        out.words[r["piece"] * step : (r["piece"] + 1) * step] = unpack_arrays(bytes(r["words"]))["w"]
    return out
