"""Outputs: reports as JSON lines or text, tallies, exit codes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import rank

REPORT = ["url", "assistant", "prompt", "param", "unwrapped_from", "findings", "score", "verdict", "notes"]


def as_json(reports: DataFrame) -> DataFrame:
    """Link reports as one JSON object a row."""
    return reports.select(F.to_json(F.struct(*REPORT), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def link_text(cut: int = 120) -> Column:
    """A link report as text."""
    found = F.transform("findings", lambda f: F.concat(F.lit("  ["), f["rule"], F.lit("] "), f["description"], F.lit(": "), f["evidence"]))
    wrapped = F.transform("unwrapped_from", lambda u: F.concat(F.lit("  inside: "), F.substring(u, 1, 100)))
    head = F.concat(F.col("verdict"), F.lit(" (score "), F.col("score").cast("string"), F.lit(") "), F.substring("url", 1, cut))
    prompt = F.when(F.col("prompt").isNotNull(), F.concat(F.lit("  prompt: "), F.substring("prompt", 1, 500)))
    return F.concat_ws("\n", head, wrapped, prompt, found, F.transform("notes", lambda n: F.concat(F.lit("  note: "), n)))


def page_text(shown: int = 10) -> Column:
    """A page report as text: the first findings, and how many more there are."""
    lines = F.transform(F.slice("findings", 1, shown), lambda f: F.concat(F.lit("  "), f["verdict"], F.lit(" "), f["where"], F.lit(": "), F.substring(f["text"], 1, 300)))
    more = F.when(F.size("findings") > shown, F.concat(F.lit("  … and "), (F.size("findings") - shown).cast("string"), F.lit(" more")))
    head = F.concat("verdict", F.lit(" ("), F.col("chunks").cast("string"), F.lit(" chunks, "), F.col("hidden_chunks").cast("string"), F.lit(" hidden)"))
    return F.concat_ws("\n", head, lines, more)


def tally(reports: DataFrame) -> DataFrame:
    return reports.groupBy("verdict").agg(F.count("*").alias("n")).orderBy("verdict")


def exit_code(reports: DataFrame) -> DataFrame:
    """One row: 2 if anything is dangerous, 1 if suspicious, else 0."""
    return reports.agg(F.coalesce(F.max(rank(F.col("verdict"))), F.lit(0)).alias("code"))


def written(df: DataFrame) -> DataFrame:
    """df, computed once: a new table in the folder of spark.checkpoint.dir, or where that is unset a local checkpoint. Its plan is
    the table's."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.localCheckpoint()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
