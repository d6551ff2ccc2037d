"""SS1: the incremental disclosure feed as a stream of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.functions.rules import allowed_url, classify


def disclosure_feed(spark: SparkSession, folder: str, schema: str, lateness: str = "365 days", files: int = 64) -> DataFrame:
    """Titled rows of allowed hosts from files that land in folder, classified, once for each (instrument, date, title, url) within lateness. A batch reads at most `files` files."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    category, attention = classify(F.col("title"))
    rows = raw.where((F.trim("title") != "") & allowed_url(F.col("url"))).withColumns({"category": category, "attention": attention, "event_time": F.col("published_date").cast("timestamp")})
    return rows.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["instrument_id", "published_date", "title", "url"])


def run_feed(feed: DataFrame, store: str, checkpoint: str) -> None:
    """Appends what is new to the store at store, until all landed files are read.

    Keys seen before are told by the stream's own state, in the checkpoint, for as long as
    lateness says; no batch reads the store. A batch that is written again after a failure
    has the same number and the state it began with, and replaces its own partition.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.drop("event_time").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    feed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_window(stored: DataFrame, windows: DataFrame) -> DataFrame:
    """The feed's rows inside each owner's evidence window, with their status."""
    status = F.when(F.col("baseline").isNull(), "首次基准").when(F.col("published_date") == F.col("baseline"), "同日待复核").otherwise("新增")
    return stored.join(windows, "instrument_id").where(F.col("published_date").between(F.col("start_date"), F.col("end_date"))).withColumn("status", status)
