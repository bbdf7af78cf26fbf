"""Tables written once where more than one part of a plan reads them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read again.

    The cluster names that folder in spark.checkpoint.dir; only in local mode, where that is
    unset, a folder of this machine stands in for it. What reads the table does not compute
    it again, and a lost executor costs its own tasks only.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quillroute-shared")
    path = f"{base.rstrip('/')}/quillroute-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
