"""Small helpers that the corpus operators share: scratch tables, row keys and connected classes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []
#: Shared folders of our own, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of our own where it is unset in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage is cut, so a lost executor
    costs at most a re-read. ``release`` deletes scratch tables; others stay."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch:
        _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; call it only when nothing that reads them is still to run."""
    while _SCRATCH:
        owner, path = _SCRATCH.pop()
        if owner.sparkContext._jsc is None:
            continue
        try:
            jvm = owner.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone; the folder is a scratch folder
            return


atexit.register(lambda: release(None))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes that stand for a row's id and whole text; nulls have keys of their own, so rows never match by null."""
    return digest(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    """Only A-Z become lower case. All-ASCII texts take the fast built-in; others go through translate."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def ascii_words(c: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null gives no words."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(c.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def components(edges: DataFrame, name: str = "classes") -> DataFrame:
    """Connected classes of an undirected graph: (``id``, ``root``), root being the smallest id of the class, for all
    ids but the roots themselves.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Every round hooks each node's neighbours to the least
    node around it and then shortcuts parents (large star and small star); each round is written to the shared folder.
    No group is gathered: a round is two aggregations and joins on node ids. Ids without edges do not appear.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above the node join the least one
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below the node, and the node itself, join the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m") \
            .union(least.select(F.col("a").alias("x"), "m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        after = written(small, name)
        same = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first() == \
            pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        pairs = after
        if same:
            break
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
