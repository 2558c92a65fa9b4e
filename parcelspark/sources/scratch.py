"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, or in a folder of our own where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again, which cuts the lineage of a loop's table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that run within have long expressions compiled in parts: the JVM leaves methods of more than 8,000 bytes uncompiled."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores. What is small in bytes comes in one part or two, and so would the pairs that it is multiplied to."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
