"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of ``documents``. A stage first
deletes the scratch tables of stages before it, so its predecessor's result must have been written by then, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import common, decontaminate, minhash, mixing, packing, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more. It learns from the labelled documents of the whole table."""
    common.release(spark)
    everything, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.train(everything, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.keep_good(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    common.release(spark)
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    common.release(spark)
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    common.release(spark)
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of token ids."""
    common.release(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token packing", pack_tokens),
]

#: Scores, signatures and draws have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{k}", scratch=False)
    return docs
