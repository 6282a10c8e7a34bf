"""Labelled items from prompts, links, page texts and whole pages, and what the rules say of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded, decode_rounds_sql
from .links import check_links, with_hit
from .pages import judged_chunks, page_chunks

ITEM = ["set", "kind", "label", "text", "where", "how", "note"]


def items_of(rows: DataFrame, name: str, kind: str, where: Column | None = None, how: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    values = {"set": F.lit(name), "kind": F.lit(kind), "where": none if where is None else where, "how": none if how is None else how}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in ITEM])


def prompt_items(rows: DataFrame, name: str) -> DataFrame:
    """Items of (label, text, note), text a prompt."""
    return items_of(rows, name, "link")


def url_items(rows: DataFrame, name: str) -> DataFrame:
    """Items of (label, url, note), the prompt decoded from the url."""
    df = bounded(with_hit(rows.select("label", "url", "note"), "url", "__hit").select("label", "note", F.col("__hit.raw").alias("__raw")))
    df = df.withColumn("text", F.when(F.col("__raw").isNotNull(), F.expr(decode_rounds_sql("__raw"))["v"]).otherwise(""))
    return items_of(bounded(df.select("label", "text", "note")), name, "link")


def text_items(rows: DataFrame, name: str) -> DataFrame:
    """Items of (label, text, where, how, note), text found on a page."""
    return items_of(rows, name, "page", F.col("where"), F.col("how"))


def html_items(rows: DataFrame, name: str, id_col: str = "page_id") -> DataFrame:
    """Items of (id, label, html, note): of each page the first text that visitors do not see, else its first text."""
    first = F.min(F.struct(F.col("where") == "visible", "ord", "text", "where", "how")).alias("c")
    chunks = page_chunks(rows, id_col).where(F.trim("text") != "").groupBy("page_id").agg(first)
    known = rows.select(F.col(id_col).alias("page_id"), "label", "note")
    return items_of(known.join(chunks, "page_id").select("label", "note", "c.text", F.col("c.where").alias("_where"), F.col("c.how").alias("_how")), name, "page", F.col("_where"), F.col("_how"))


def union_of(*sets: DataFrame) -> DataFrame:
    """All items with a text that is not blank."""
    return reduce(DataFrame.unionByName, sets).where(r"text RLIKE '(?U)\\S'")


def rules_verdicts(items: DataFrame) -> DataFrame:
    """items with verdict and score of the rules: a prompt as a link that carries it, a page text as a chunk where it was found.

    Verdicts are bounded: what is asked of them later would else be rewritten into the rules' conditions.
    """
    links = check_links(items.where("kind = 'link'").withColumn("url", F.concat(F.lit("https://chatgpt.com/?q="), F.url_encode("text"))))
    texts = judged_chunks(items.where("kind = 'page'")).withColumn("verdict", F.coalesce("verdict", F.lit("LOOKS_SAFE")))
    shown = [*items.columns, "verdict", F.col("score").cast("int").alias("score")]
    return bounded(links.select(*shown)).unionByName(bounded(texts.select(*shown)))
