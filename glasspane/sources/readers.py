"""Inputs: lists of links and sites, saved pages, crawl records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "array<struct<verdict: string, where: string, how: string, tag: string, rules: array<string>, text: string>>"
CONTENT = f"struct<verdict: string, chunks: bigint, hidden_chunks: bigint, findings: {FINDINGS}>"
LINKS = "array<struct<assistant: string, param: string, verdict: string, score: int, rules: array<string>, prompt: string, wrapped: int>>"
CANDIDATES = "array<struct<where: string, how: string, tag: string, text: string>>"
#: Crawl records, one site per line; what is absent in a line is null.
RECORDS = f"site string, status string, robots string, seconds double, pages array<struct<url: string, ai_links: {LINKS}, content: {CONTENT}, candidates: {CANDIDATES}>>, llms_txt {CONTENT}"


def links_of(spark: SparkSession, *urls: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")


def link_lines(spark: SparkSession, path: str) -> DataFrame:
    """One link a line, trimmed, blank lines left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url")).where("url <> ''")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole files; bytes that are no UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.expr("make_valid_utf8(CAST(content AS STRING))").alias("html"))


def ranked_sites(spark: SparkSession, path: str) -> DataFrame:
    """(rank, domain) of a CSV without header; lines without a domain left out."""
    return spark.read.schema("rank int, domain string").csv(path).where("domain IS NOT NULL")


def site_lines(spark: SparkSession, path: str) -> DataFrame:
    """One site a line; blank lines and comments left out."""
    return spark.read.text(path).select(F.trim("value").alias("domain")).where("domain <> '' AND NOT startswith(domain, '#')")


def crawl_records(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(RECORDS).json(path).where("site IS NOT NULL")
    return out.withColumn("pages", F.coalesce("pages", F.array().cast(out.schema["pages"].dataType)))
