"""Crawls as tables: sites, robots files and fetched pages come in, rows per site and page go out, or one record per site."""

from __future__ import annotations

from collections.abc import Callable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.text import unescaped_scripts
from ..sources.responses import decoded
from .links import article_links, check_links, mentions_assistant, page_links
from .pages import page_chunks, page_digests, page_reports, paragraphs


def robots_rules(text: str | None, code: int | None) -> RobotFileParser:
    """401 and 403 forbid all, other failures allow all, no answer (null) forbids."""
    rules = RobotFileParser()
    if code is None or code != code or code in (401, 403):
        rules.disallow_all = True
    elif code != 200 or not text:
        rules.allow_all = True
    else:
        rules.parse(text.splitlines())
    return rules


@F.pandas_udf(T.BooleanType())
def robots_allow(robots: pd.Series, status: pd.Series, url: pd.Series) -> pd.Series:
    """May the url be read by anyone, see robots_rules."""
    return pd.Series([robots_rules(text, code).can_fetch("*", address or "/") for text, code, address in zip(robots, status, url, strict=True)], dtype=object)


def robots_allowed(agent: str):
    """Function of columns (robots, status, addresses): which of the addresses the agent may read, in order. A file is parsed once a row."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def allowed(robots: pd.Series, status: pd.Series, addresses: pd.Series) -> pd.Series:
        def one(text, code, urls):
            rules = robots_rules(text, code)
            return [u for u in urls if u and rules.can_fetch(agent, u)] if urls is not None else []

        return pd.Series([one(*row) for row in zip(robots, status, addresses, strict=True)], dtype=object)

    return allowed


def page_records(pages: DataFrame) -> DataFrame:
    """From (site, url, html), url unique: site, url, ai_links, content, candidates, error (what broke its reading off, else null).

    Links are looked for only where an assistant is named. The chunks of a page are read once.
    """
    html = pages.where("url IS NOT NULL")
    named = html.where(mentions_assistant(F.col("html"))).select("site", "url", unescaped_scripts(F.col("html")).alias("html"))
    links = check_links(page_links(named.select("site", F.col("url").alias("page"), "html"))).where("assistant IS NOT NULL")
    first = Window.partitionBy("page", "assistant", "prompt").orderBy("ord")
    links = links.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    entry = F.struct("ord", "assistant", "param", "verdict", "score", F.transform("findings", lambda f: f["rule"]).alias("rules"), F.substring(F.coalesce("prompt", F.lit("")), 1, 1500).alias("prompt"), F.size("unwrapped_from").alias("wrapped"))
    by_page = links.groupBy(F.col("page").alias("url")).agg(F.array_sort(F.collect_list(entry)).alias("ai_links"))
    content = F.struct("verdict", "chunks", "hidden_chunks", shown("findings").alias("findings")).alias("content")
    read = page_digests(page_chunks(html, "url", "html", with_status=True)).select(F.col("page_id").alias("url"), F.when(F.col("chunks") > 0, content).alias("content"), "candidates", "error")
    out = html.select("site", "url").join(by_page, "url", "left").join(read, "url", "left").select("site", "url", "ai_links", "content", "candidates", "error")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("ai_links", "candidates")})


def shown(findings: str):
    return F.transform(findings, lambda f: F.struct(f["verdict"].alias("verdict"), f["where"].alias("where"), f["how"].alias("how"), f["tag"].alias("tag"), F.transform(f["findings"], lambda x: x["rule"]).alias("rules"), f["text"].alias("text")))


def site_tables(sites: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, status, llms_txt), one row a site, and the page records of sites that may be read, one row a page.

    sites: site, robots, robots_status, home_status, llms, llms_status and, if known, error, the kind of failure that broke the
    site's visit off; pages: site, url, html (fetched).
    """
    broken = F.col("error").isNotNull() if "error" in sites.columns else F.lit(False)
    home = F.concat(F.lit("https://"), "site", F.lit("/"))
    allowed = robots_allow("robots", "robots_status", home)
    status = (
        F.when(broken, F.concat(F.lit("error:"), F.col("error") if "error" in sites.columns else F.lit("")))
        .when(F.col("robots_status").isNull(), "unreachable")
        .when(~allowed, "robots_disallowed")
        .when(F.col("home_status") != 200, F.concat(F.lit("no_html:"), F.col("home_status").cast("string")))
        .otherwise("ok")
    )
    known = sites.withColumn("status", status)
    read = page_records(pages.join(known.where("status = 'ok'").select("site"), "site", "left_semi"))
    has_file = (F.col("status") == "ok") & (F.col("llms_status") == 200) & (F.trim("llms") != "") & ~F.ltrim(F.col("llms")).startswith("<")
    files = page_reports(paragraphs(known.where(has_file), "site", "llms")).select(F.col("page_id").alias("site"), F.struct("verdict", "chunks", "hidden_chunks", shown("findings").alias("findings")).alias("llms_txt"))
    return known.select("site", "status").join(files, "site", "left"), read


def site_records(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """One record per site, its pages in one array: for sinks. Summaries take the rows of site_tables, which no site's size bounds."""
    known, read = site_tables(sites, pages)
    nested = read.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("url", "ai_links", "content", "candidates"))).alias("pages"))
    out = known.join(nested, "site", "left").select("site", "status", "pages", "llms_txt")
    return out.withColumn("pages", F.coalesce("pages", F.array().cast(out.schema["pages"].dataType)))


def visits(sites: DataFrame, responses: DataFrame, articles: int = 3, agent: str = "*", settled: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A whole visit to each site over stored responses: (site, status, robots, pages, llms_txt), one row a site.

    sites: (site), a domain or an address; null and repeated ones count once or not at all. responses: (url, final, status,
    content_type, content_encoding, body), url unique, see sources.responses; a missing or null status is no answer.
    A domain is tried as https and then with www., and its first address whose robots file answers counts; an address is tried as
    it is. Robots rules then decide on the home page, on /llms.txt and on each of the home page's best articles, at most
    `articles` of them, before anything of these is looked up. Pages that answered no HTML are left out; a site one of whose
    pages broke its reading off has status error:<Type> and no pages. status: ok, unreachable, robots_disallowed, no_html:<n>, error:<Type>.

    Steps are joins by address: robots files and home pages are picked out of the responses before they are shuffled, and only
    addresses that may be read meet the rest. A site has at most articles + 1 pages, so its array is bounded. Home pages, the
    addresses that they ask for, and all pages read are used several times: `settled` may write them down (sinks.written, or checkpoint()), else their
    plans are multiplied.
    """
    bare = F.rtrim(F.col("site"), F.lit("/"))
    bases = F.when(F.col("site").contains("://"), F.array(F.concat(bare, F.lit("/")))).otherwise(F.array(F.concat(F.lit("https://"), "site", F.lit("/")), F.concat(F.lit("https://www."), "site", F.lit("/"))))
    tries = sites.where("site IS NOT NULL").select("site").distinct().select("site", F.posexplode(bases).alias("attempt", "base"))
    root = lambda url: F.regexp_extract(url, r"(?i)^([^:/?#]+://[^/?#]*)", 1)
    text = F.when(F.col("status") == 200, F.expr(f"make_valid_utf8(CAST(substring(body, 1, {V.ROBOTS_BYTES}) AS STRING))"))
    files = responses.where(F.col("url").endswith("/robots.txt")).select(F.col("url").alias("__at"), F.when(F.col("status") > 0, F.col("status")).alias("robots_status"), text.alias("robots"))
    asked = answering(tries.join(files, F.concat(root(F.col("base")), F.lit("/robots.txt")) == F.col("__at"), "left").drop("__at"))
    may = robots_allowed(agent)
    asked = asked.withColumn("free", F.size(may("robots", "robots_status", F.array("base"))) > 0)

    answers = responses.select("url", F.coalesce("final", "url").alias("final"), "status", "content_type", "content_encoding", "body")
    home = asked.join(decoded(answers.where(F.col("url").endswith("/"))).withColumnRenamed("url", "__at").drop("status"), (F.col("base") == F.col("__at")) & F.col("free"), "left")
    status = (
        F.when(F.col("robots_status").isNull(), "unreachable")
        .when(~F.col("free"), "robots_disallowed")
        .when(F.coalesce("text", F.lit("")) == "", F.concat(F.lit("no_html:"), F.coalesce("answer", F.lit(0)).cast("string")))
        .otherwise("ok")
    )
    homes = settled(home.select("site", status.alias("status"), F.when(F.col("robots_status").isNotNull(), F.when(F.col("free"), "allowed").otherwise("disallowed")).alias("robots"), F.col("robots").alias("__rules"), "robots_status", "final", F.when(status == "ok", F.col("text")).alias("html")))

    ok = homes.where("status = 'ok'")
    # The key of an article's home: its address, with the site where a fragment would be.
    keyed = ok.select(F.concat(F.regexp_replace("final", "#.*$", ""), F.lit("#"), "site").alias("key"), "html")
    best = article_links(keyed, "key", "html", articles).groupBy(F.substring("key", F.instr("key", "#") + 1, F.length("key")).alias("site")).agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("best"))
    llms = F.concat(root(F.col("final")), F.lit("/llms.txt"))
    listed = F.concat(F.array(llms), F.transform(F.coalesce("best", F.array().cast("array<struct<place:int,url:string>>")), lambda b: b["url"]))
    wanted = settled(ok.join(best, "site", "left").select("site", llms.alias("llms"), F.posexplode(may("__rules", "robots_status", listed)).alias("place", "asked")))

    texts = answers.where(F.col("url").endswith("/llms.txt"))
    said = wanted.where("asked = llms").select("site", "asked").join(decoded(texts, "text"), F.col("asked") == F.col("url")).where((F.trim("text") != "") & ~F.col("text").rlike(r"(?U)^\s*<") & (F.col("answer") == 200))
    notes = page_reports(paragraphs(said, "site", "text")).select(F.col("page_id").alias("site"), F.struct("verdict", "chunks", "hidden_chunks", shown("findings").alias("findings")).alias("llms_txt"))

    found = wanted.where("asked <> llms").join(answers, F.col("asked") == F.col("url")).drop("url")
    read = decoded(found).where("text <> ''").select("site", (F.col("place") + 1).alias("place"), "final", F.col("text").alias("html"))
    html = ok.select("site", F.lit(0).alias("place"), "final", "html").unionByName(read)
    key = F.concat_ws("\n", "site", F.format_string("%09d", "place"), "final")
    records = page_records(settled(html.select("site", key.alias("url"), "html")))
    page = F.struct(F.split("url", "\n")[1].alias("place"), F.split("url", "\n", 3)[2].alias("url"), "ai_links", "content", "candidates")
    nested = records.groupBy("site").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.max("error").alias("error"))
    out = homes.select("site", "status", "robots").join(nested, "site", "left").join(notes, "site", "left")
    kept = F.when(F.col("error").isNull(), F.transform("pages", lambda p: p.dropFields("place")))
    return out.select("site", F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), "error")).otherwise(F.col("status")).alias("status"), "robots", kept.alias("pages"), F.when(F.col("error").isNull(), F.col("llms_txt")).alias("llms_txt")).withColumn("pages", F.coalesce("pages", F.array().cast(out.select(kept.alias("p")).schema["p"].dataType)))


def answering(attempts: DataFrame) -> DataFrame:
    """Of several visits to a site (site, attempt, robots_status and more; say its address, then that with www.) the first that
    had an answer, else the first: one row a site, all columns."""
    rest = [c for c in attempts.columns if c != "site"]
    best = F.min_by(F.struct(*rest), F.struct(F.col("robots_status").isNull(), "attempt"))
    return attempts.groupBy("site").agg(best.alias("b")).select("site", "b.*")


def site_slice(sites: DataFrame, first: int, n: int) -> DataFrame:
    """Sites of (rank, domain) by rank: n of them after the first `first`."""
    return sites.orderBy("rank", "domain").offset(first).limit(n)


def sampled_sites(sites: DataFrame, n: int, top: int | None = None, seed: int = 0) -> DataFrame:
    """n sites of (rank, domain) out of the first `top`, the same for the same seed, whatever the partitions."""
    rows = sites.where(F.col("rank") <= top) if top else sites
    return rows.orderBy(F.xxhash64("domain", F.lit(seed)), "domain").limit(n)
