"""The append-only attempt log as a stream: pairing, windows, once per key. Batch frames work the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def log(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The log's closed files; a file that is still being written isn't seen."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder)


def pairing(events: DataFrame) -> DataFrame:
    """Starts, finishes and attempts that started and never finished, by worker."""
    n = lambda c: F.count(F.when(c, 1))
    starts, ends = n(F.col("event_type") == "click"), n(F.col("event_type") != "click")
    return events.groupBy("user_id").agg(starts.alias("starts"), ends.alias("finishes"), n(F.col("event_type") == "error").alias("failed"), F.greatest(starts - ends, F.lit(0)).alias("uncertain"))


def windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Finishes, errors and mean latency by tumbling window; state older than the watermark goes."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.where("event_type <> 'click'").groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "n", "errors", (F.col("total") / F.col("n")).alias("mean_latency"))


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that a stream has now, run to its end and read back from the shared folder."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def last(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        stream.writeStream.foreachBatch(last).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def append(records: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream's records to a log of JSON lines, each exactly once, until the stream has no more for now.

    Files count once the sink's own log names them, which it does a batch at a time. A query that was stopped at any
    point goes on from its checkpoint; what an unfinished batch had written isn't named and isn't read.
    """
    records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
