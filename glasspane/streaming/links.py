"""The same link checks over streams: files of link lines come in, reports are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import check_links


def link_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(url, seen) of the lines of text files that appear in a folder."""
    lines = spark.readStream.text(folder).select(F.trim("value").alias("url")).where("url <> ''")
    return lines.withColumn("seen", F.current_timestamp())


def reports(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Reports of assistant links; the same prompt for the same assistant once within the time (bounded state)."""
    found = check_links(stream).where("assistant IS NOT NULL").withColumn("prompt", F.coalesce("prompt", F.lit("")))
    return found.withWatermark("seen", within).dropDuplicatesWithinWatermark(["assistant", "prompt"])


def write(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, all that is there now."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
