"""Batch tables by Structured Streaming: each run reads what is there, then stops, and can go on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.sources import files


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return files.new_path(spark, "stream")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, with ts as an instant. The pattern lets one file stand where a folder may."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all that is available and returns its table: appended rows, or the last complete result."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{at}/table")
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/table"))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def weekly_totals(stream: DataFrame) -> DataFrame:
    """Tumbling weeks by kind; a week is written once the watermark, a day behind, has passed its end."""
    made = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "7 days"), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("week"), "event_type", "n", "low", "high")


def weekly_bars(stream: DataFrame) -> DataFrame:
    """Tumbling weeks by kind: first, highest, lowest and last value, and their sum."""
    at = F.struct("ts", "event_id")
    made = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "7 days"), "event_type").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("total"), F.count("*").alias("n"))
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("week"), "event_type", "open", "high", "low", "close", "total", "n")


def once_per_key(stream: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key; what comes again within the watermark of a day is dropped."""
    return stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(key)


def ingested(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Appends the files of a folder that no earlier run with this checkpoint has read, then stops."""
    stream = spark.readStream.schema(schema).option("header", "true").csv(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def corrected(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, day: str) -> None:
    """Merges new files into a table partitioned by `day`: each day a batch brings replaces that day's rows, and no other day is touched, so a day that failed can come again."""

    def merge(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)

    stream = spark.readStream.schema(schema).option("header", "true").csv(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_status(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))
