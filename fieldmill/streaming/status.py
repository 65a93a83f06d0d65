"""Streams over appended logs: counts by event time, and the latest result of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.session import scratch_path


def status_counts(events: DataFrame, time: str, status: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each status in tumbling windows; a stream drops what is later than ``late``, a table counts all."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.window(time, window).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), status, "n")


def latest_results(results: DataFrame, key: str, generation: str, value: str) -> DataFrame:
    """The result of greatest generation of each key; results that arrive with an older generation change nothing."""
    best = F.max(F.struct(generation, value)).alias("b")
    return results.groupBy(key).agg(best).select(key, F.col(f"b.{generation}").alias(generation), F.col(f"b.{value}").alias(value))


def run_available(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what is there and gives its result as a table: appended files, or the last state of a complete one."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{label}-log")).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, root: str, name: str = "events") -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)
