"""Summaries of crawl records and evaluations, as aggregations over exploded records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import percent, prompt_template, scrubbed
from ..operators.reviews import raises

FLAGGED = ["SUSPICIOUS", "DANGEROUS"]


def page_rows(sites: DataFrame, only_ok: bool = True) -> DataFrame:
    """(site, url, ai_links, content, candidates) of the pages in records."""
    rows = sites.where("status = 'ok'") if only_ok else sites
    return rows.select("site", F.explode("pages").alias("p")).select("site", "p.*")


def page_links(pages: DataFrame) -> DataFrame:
    """(site, page, assistant, param, verdict, score, rules, prompt, wrapped) of all links of pages."""
    return pages.select("site", F.col("url").alias("page"), F.explode("ai_links").alias("l")).select("site", "page", "l.*")


def page_findings(pages: DataFrame) -> DataFrame:
    return pages.select("site", F.col("url").alias("page"), F.explode("content.findings").alias("f")).select("site", "page", "f.*")


def link_rows(sites: DataFrame, only_ok: bool = True) -> DataFrame:
    """page_links of the pages in records."""
    return page_links(page_rows(sites, only_ok))


def content_rows(sites: DataFrame, only_ok: bool = True) -> DataFrame:
    return page_findings(page_rows(sites, only_ok))


def status_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy(F.substring_index("status", ":", 1).alias("status")).agg(F.count("*").alias("n"))


def site_summary(sites: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: how many sites were tried, read, link to assistants, carry prompts, are flagged, and so on.

    sites and pages: the two tables of crawl.site_tables, or records alone. Pages are added up within tasks before they meet.
    """
    pages = page_rows(sites) if pages is None else pages
    link = lambda cond: F.max(F.exists("ai_links", cond))
    found = lambda cond: F.max(F.coalesce(F.exists("content.findings", cond), F.lit(False)))
    carries = lambda x: x["prompt"] != ""
    by_site = pages.groupBy("site").agg(
        F.count("*").alias("n_pages"),
        link(lambda x: F.lit(True)).alias("has_link"),
        link(carries).alias("has_prompt"),
        link(lambda x: carries(x) & x["verdict"].isin(*FLAGGED)).alias("has_flagged"),
        link(lambda x: carries(x) & (x["verdict"] == "DANGEROUS")).alias("has_dangerous"),
        found(lambda f: F.lit(True)).alias("told"),
        found(lambda f: f["verdict"] == "DANGEROUS").alias("told_dangerous"),
    )
    ok = F.col("status") == "ok"
    n = lambda c: F.count_if(ok & c).cast("long")
    told, flagged = (F.coalesce(c, F.lit(False)) for c in ("told", "has_flagged"))
    out = sites.select("site", "status", "llms_txt").join(by_site, "site", "left").agg(
        F.count("*").alias("sites"),
        n(F.lit(True)).alias("reachable"),
        F.coalesce(F.sum(F.when(ok, F.col("n_pages"))), F.lit(0)).cast("long").alias("pages"),
        n(F.col("has_link")).alias("with_link"),
        n(F.col("has_prompt")).alias("with_prompt"),
        n(flagged).alias("flagged"),
        n(F.col("has_dangerous")).alias("dangerous"),
        n(told).alias("content_sites"),
        n(F.col("told_dangerous")).alias("content_dangerous"),
        n(F.col("llms_txt").isNotNull()).alias("llms_txt"),
        n(F.coalesce(F.size("llms_txt.findings") > 0, F.lit(False))).alias("llms_flagged"),
        n(told | flagged).alias("either"),
    )
    return out.withColumns({"reachable_share": percent(F.col("reachable"), F.col("sites")), "flagged_share": percent(F.col("flagged"), F.col("with_prompt"))})


def assistant_counts(sites: DataFrame) -> DataFrame:
    return link_rows(sites).where("prompt <> ''").groupBy("assistant").agg(F.count("*").alias("n"))


def templates(links: DataFrame) -> DataFrame:
    """(template, sites, n_sites, links, flagged, example) of links with a prompt."""
    rows = links.where("prompt <> ''").withColumn("template", prompt_template(F.col("prompt")))
    out = rows.groupBy("template").agg(F.sort_array(F.collect_set("site")).alias("sites"), F.count("*").alias("links"), F.count_if(F.col("verdict").isin(*FLAGGED)).alias("flagged"), F.min(F.substring("prompt", 1, 300)).alias("example"))
    return out.withColumn("n_sites", F.size("sites"))


def top_templates(links: DataFrame, most: int = 200) -> DataFrame:
    return templates(links).orderBy(F.desc("n_sites"), "template").limit(most)


def hidden_counts(sites: DataFrame) -> DataFrame:
    """Where findings were and how they were hidden: (kind, value, n)."""
    rows = content_rows(sites).select(F.explode(F.array(F.struct(F.lit("where").alias("kind"), F.col("where").alias("value")), F.struct(F.lit("how").alias("kind"), F.col("how").alias("value")))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def site_numbers(sites: DataFrame) -> DataFrame:
    """(site, number): numbers by the order of names, for listings without names.

    Counted up within first letters, then over the short table of first letters, so that no task sorts all sites.
    """
    names = sites.select("site", F.substring("site", 1, 3).alias("start")).distinct()
    within = names.withColumn("within", F.row_number().over(Window.partitionBy("start").orderBy("site")))
    sizes = names.groupBy("start").agg(F.count("*").alias("n"))
    before = sizes.select("start", (F.sum("n").over(Window.orderBy("start")) - F.col("n")).alias("before"))
    return within.join(before, "start").select("site", (F.col("within") + F.col("before")).cast("long").alias("number"))


def ai_summary(reviewed: DataFrame) -> DataFrame:
    """Per kind: texts reviewed, failed reviews, texts judged manipulative, those that the rules had let pass, and their sites.

    reviewed: (kind, rules, sites, review), one row a distinct text, as reviews.to_review gives them; rules is a link's verdict.
    """
    hit = raises(F.col("review"), F.col("kind"))
    missed = hit & ((F.col("kind") == "page") | ~F.coalesce(F.col("rules").isin(*FLAGGED), F.lit(False)))
    counts = reviewed.groupBy("kind").agg(F.count("*").alias("reviewed"), F.count_if(F.col("review.error") != "").alias("errors"), F.count_if(hit).alias("flagged"), F.count_if(missed).alias("new"))
    sites = reviewed.where(missed).select("kind", F.explode("sites").alias("site")).groupBy("kind").agg(F.count_distinct("site").alias("new_sites"))
    return counts.join(sites, "kind", "left").withColumn("new_sites", F.coalesce("new_sites", F.lit(0)).cast("long"))


def ai_rows(reviewed: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows of a listing for texts that a review judged manipulative, each under the first site that shows it (0 if unknown)."""
    hits = reviewed.where(raises(F.col("review"), F.col("kind"))).withColumn("site", F.try_element_at("sites", F.lit(1)))
    place = F.concat(F.when(F.col("kind") == "link", "link").otherwise(F.concat_ws(" / ", "where", "how")), F.lit(" / "), F.size("sites").cast("string"), F.lit(" site(s)"))
    said = F.concat(F.lit("AI "), F.col("review.category"), F.lit(" "), F.format_number("review.confidence", 2))
    rows = hits.join(numbers, "site", "left")
    return rows.select(F.concat(F.lit("AI "), "kind").alias("kind"), F.coalesce("number", F.lit(0)).cast("long").alias("site"), said.alias("verdict"), place.alias("place"), F.substring(scrubbed(F.col("review.reason"), F.col("site")), 1, 160).alias("rules"), F.substring(scrubbed(F.col("text"), F.col("site")), 1, 400).alias("text"))


def listed(pages: DataFrame) -> DataFrame:
    """(site, kind, verdict, place, rules, text) of the findings of pages and of their links with a prompt: pages are made once for both."""
    entry = lambda kind, x, place, text: F.struct(F.lit(kind).alias("kind"), x["verdict"].alias("verdict"), place.alias("place"), x["rules"].alias("rules"), text.alias("text"))
    content = F.transform("content.findings", lambda f: entry("content", f, F.concat(f["where"], F.lit(" / "), f["how"], F.lit(" / <"), f["tag"], F.lit(">")), f["text"]))
    links = F.transform(F.filter("ai_links", lambda x: x["prompt"] != ""), lambda x: entry("link", x, x["assistant"], x["prompt"]))
    none = F.array().cast("array<struct<kind:string,verdict:string,place:string,rules:array<string>,text:string>>")
    return pages.select("site", F.inline(F.concat(F.coalesce(content, none), F.coalesce(links, none))))


def review_listing(sites: DataFrame, pages: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """Findings without names, in the order for review: (kind, site, verdict, place, rules, text); those of reviews come first."""
    pages = page_rows(sites, False) if pages is None else pages
    numbers = site_numbers(sites)
    files = sites.select("site", F.explode("llms_txt.findings").alias("f")).select("site", F.lit("llms.txt").alias("kind"), "f.verdict", F.col("f.how").alias("place"), "f.rules", "f.text")
    rows = listed(pages).unionByName(files).join(numbers, "site")
    severity = F.when(F.col("verdict") == "DANGEROUS", 0).when(F.col("verdict") == "SUSPICIOUS", 1).when(F.col("verdict") == "LOOKS_SAFE", 2).otherwise(3)
    rows = rows.select("kind", F.col("number").alias("site"), "verdict", "place", F.concat_ws(",", "rules").alias("rules"), F.substring(scrubbed(F.col("text"), F.col("site")), 1, 400).alias("text"))
    if reviewed is not None:
        rows = rows.unionByName(ai_rows(reviewed, numbers))
    return rows.orderBy(F.when(F.col("kind").startswith("AI"), 0).when(F.col("kind") == "content", 1).otherwise(2), severity, "site")


def confusion(items: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """One row: tp, fn, fp, tn, dangerous_benign, precision, recall, false_alarms; 0 where a denominator is 0."""
    bad, hit = F.col(label) == "malicious", F.col(verdict).isin(*FLAGGED)
    n = items.agg(F.count_if(bad & hit).alias("tp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & hit).alias("fp"), F.count_if(~bad & ~hit).alias("tn"), F.count_if(~bad & (F.col(verdict) == "DANGEROUS")).alias("dangerous_benign"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_alarms": ratio(fp, fp + tn)})


def wrong_items(items: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """items with `wrong`: 'missed' for attacks that were let pass, 'false alarm' for harmless items that were not."""
    bad, hit = F.col(label) == "malicious", F.coalesce(F.col(verdict).isin(*FLAGGED), F.lit(False))
    return items.withColumn("wrong", F.when(bad & ~hit, "missed").when(~bad & hit, "false alarm")).where("wrong IS NOT NULL")


def set_grid(items: DataFrame) -> DataFrame:
    """Per set and over all: attacks and those caught, harmless items and false alarms, by rules, by review, by both."""
    bad = F.col("label") == "malicious"
    hits = {"rules": F.col("rules").isin(*FLAGGED), "ai": F.col("ai_flags"), "combined": F.col("combined").isin(*FLAGGED)}
    counts = [F.count_if(bad).alias("attacks"), F.count_if(~bad).alias("harmless"), *(F.count_if(bad & h).alias(f"{k}_caught") for k, h in hits.items()), *(F.count_if(~bad & h).alias(f"{k}_alarms") for k, h in hits.items())]
    return items.rollup("set").agg(*counts).withColumn("set", F.coalesce("set", F.lit("All")))


def markdown(summary: dict) -> str:
    """A one-row summary as lines."""
    return "\n".join(["# Scan summary", "", *(f"- {k.replace('_', ' ')}: **{v}**" for k, v in summary.items())]) + "\n"
