"""Daily event counts from a stream of event files; the batch twin is aggregates.period_counts without empty days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch


def daily_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """day, event_type, n by windows of a day. With a watermark a stream's finished days are appended; a batch gives all days."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir) if not sf_dir.endswith(".parquet") else spark.readStream.schema(schema).parquet(sf_dir)


def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the events table to its end and return the complete counts."""
    out = scratch(spark, "stream")
    counts = _source(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(
        F.to_date("window.start").alias("day"), "event_type", "n"
    )

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/counts")

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("day date, event_type string, n bigint").parquet(f"{out}/counts")


def run_finished(spark: SparkSession, sf_dir: str, late: str = "7 days") -> DataFrame:
    """Stream the events table to its end and return the days that the watermark has closed: each is written once, and its state dropped."""
    out = scratch(spark, "stream")
    q = daily_counts(_source(spark, sf_dir), late).writeStream.outputMode("append").format("parquet").option("path", f"{out}/counts").option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("day date, event_type string, n bigint").parquet(f"{out}/counts")
