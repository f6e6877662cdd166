"""Intermediate tables that are read several times: written once as Parquet below ``spark.checkpoint.dir``, read from there.

An executor that is lost later costs a read, not the work again. Where the setting is unset, a folder of this machine stands in if
the master is local; another cluster's executors would not see it, so there that is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's name, shared by driver and executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        base = _local_base()
    return f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"


@lru_cache(1)
def _local_base() -> str:
    return f"file://{tempfile.mkdtemp(prefix='vintara-')}"


@contextmanager
def staged(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows``, written; deleted again at the end, so nothing that reads them may leave the block unfinished."""
    spark, path = rows.sparkSession, folder(rows.sparkSession)
    rows.write.parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
