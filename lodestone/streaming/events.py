"""Structured Streaming twins of the incremental steps, run to the end of the input (availableNow)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import checkpoint_root


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table file of the folder as a stream; a folder of parts works alike."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    whole = os.path.isdir(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet") if whole else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _finish(spark: SparkSession, stream: DataFrame, merge) -> DataFrame:
    """Run the stream; each micro batch is written as its own folder, then `merge` reads them all."""
    root = f"{checkpoint_root(spark)}/lodestone-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")  # the same folder if the batch is run again

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return merge(spark.read.parquet(f"{root}/out").drop("part"))


def hourly_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of each user and hour; a late row overwrites its hour while the watermark of two days allows."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    hours = events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("n"))
    flat = hours.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), F.col("r.value").alias("value"), F.col("r.event_type").alias("event_type"), "n")
    last = lambda df: df.groupBy("user_id", "hour").agg(F.max_by(F.struct("value", "event_type", "n"), "batch").alias("r")).select("user_id", "hour", "r.*")
    return _finish(spark, flat, last)


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent ingest: each content of a run once, whichever id it came under."""
    evidence = _stream(spark, sf_dir, "raw_evidence").select("run_id", "source_url", "content_hash").dropDuplicates(["run_id", "source_url", "content_hash"])
    return _finish(spark, evidence, lambda df: df.drop("batch"))
