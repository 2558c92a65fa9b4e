"""Arriving listings as a stream: each batch is cleaned, held against the addresses that came before, which are keyed state, and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import normalize_address


ROWS = "new_id bigint, address string"


def save_new(stream: DataFrame, stored_path: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """Append the rows of a stream (new_id, address) whose address has not come before, one per normalised address: the smallest id of the batch in which it first comes.

    The first arrival of every address is kept as state, keyed and checkpointed by Spark, so a batch costs what arrives in it, however much is stored, and reads nothing that was
    written before. Addresses without any letter or digit are all stored. ``stored`` is a stream of the rows (id, address) that were there before, if any; they enter the state and are not written again.
    A batch is written to a folder of its own number, replacing what an earlier try left, so a batch that is tried again is not appended twice.
    """
    rows = stream.select("new_id", "address", F.lit(True).alias("new"))
    if stored is not None:
        rows = stored.select(F.col("id").alias("new_id"), "address", F.lit(False).alias("new")).unionByName(rows)
    rows = rows.withColumn("normalized", normalize_address(F.col("address")))
    rows = rows.withColumn("key", F.when(F.col("normalized") == "", F.concat(F.lit("#"), F.col("new_id").cast("string"))).otherwise(F.col("normalized")))
    # the time of a batch is the same for all of its rows, and when it is tried again; known addresses go before new ones of the same batch
    rows = rows.withColumn("at", F.current_timestamp())
    first = rows.groupBy("key").agg(F.min(F.struct("at", "new", "new_id", "address")).alias("first"), F.max("at").alias("last"))

    def save(batch: DataFrame, number: int) -> None:
        fresh = batch.where("first.at = last and first.new").select("first.new_id", "first.address")
        fresh.write.mode("overwrite").parquet(f"{stored_path}/batch={number}")

    return first.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def busiest_hours(events: DataFrame) -> DataFrame:
    """Count and sum of events per hour and type, late ones up to a day."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_arrivals(spark: SparkSession, source: str, schema, stored_path: str, checkpoint: str, address: list[str], files: int = 1) -> DataFrame:
    """Run the stream over the files there are, some at a time, and return what is stored, with normalised addresses."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).selectExpr(*address)
    spark.createDataFrame([], ROWS).write.mode("ignore").parquet(f"{stored_path}/batch=-1")
    save_new(arriving, stored_path, checkpoint).awaitTermination()
    return spark.read.schema(f"{ROWS}, batch bigint").parquet(stored_path).select("new_id", normalize_address(F.col("address")).alias("normalized"))


def hourly_events(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Run ``busiest_hours`` over the files there are and return the hours that are closed: those that end a day or more before the latest event."""
    counts = busiest_hours(spark.readStream.schema(schema).parquet(source))
    flat = counts.select(F.col("window.start").alias("hour"), "event_type", "n", "total")
    flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(out)
