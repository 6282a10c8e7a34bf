"""Assistant links: find the prompt that a link carries, through wrappers, and judge it. One row in, one row out."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import decode_rounds_sql, decode_sql, lit, once, once_column
from .rules import finding_sql, prompt_findings, total, verdict

SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://"
WEB = r"(?i)^\s*https?://"
HOSTISH = r"(?iU)^\s*(?:https?://)?[\w.-]+\.[a-z]{2,}"


def assistant_sql(x: str) -> str:
    """Name of the assistant at x.host, x.path, x.pairs, or null."""
    cases = [f"WHEN {x}.host = '{h}' OR endswith({x}.host, '.{h}') THEN {lit(name)}" for h, name in V.ASSISTANT_HOSTS.items()]
    for host, prefix, needs, name in V.PATH_ASSISTANTS:
        more = f" AND try_element_at(filter({x}.pairs, q -> lower(q.k) = '{needs[0]}'), -1).v = '{needs[1]}'" if needs else ""
        cases.append(f"WHEN {x}.host = '{host}' AND startswith(lower({x}.path), '{prefix}'){more} THEN {lit(name)}")
    return f"CASE {' '.join(cases)} END"


def parsed_sql(entries: str) -> str:
    """Array of (url, trail, place) to (url, trail, place, valid, pairs, assistant, param, raw)."""
    bare = r"IF(concat(left(e.url, 1), right(e.url, 1)) RLIKE '(?U)\\s', regexp_replace(e.url, r'(?U)^\s+|\s+$', ''), e.url)"
    clean = f"transform({entries}, e -> named_struct('url', regexp_replace(trim(BOTH '<>\"\\'' FROM {bare}), r'[\\t\\r\\n]', ''), 'trail', e.trail, 'place', e.place))"
    schemed = f"transform({clean}, e -> named_struct('url', IF(e.url RLIKE r'{SCHEME}', e.url, concat('https://', e.url)), 'trail', e.trail, 'place', e.place))"
    pieces = (
        f"transform({schemed}, e -> named_struct('url', e.url, 'trail', e.trail, 'place', e.place, "
        r"'site', regexp_extract(e.url, '^[^:]+://([^/?#]*)', 1), 'path', regexp_extract(e.url, '^[^:]+://[^/?#]*([^?#]*)', 1), "
        r"'query', regexp_extract(e.url, '^[^?#]*[?]([^#]*)', 1), 'fragment', IF(contains(e.url, '#'), regexp_extract(e.url, '^[^#]*#(?s)(.*)$', 1), '')))"
    )
    split = "concat(split(e.query, '&'), IF(instr(e.fragment, '=') > 0, split(trim(LEADING '/?' FROM e.fragment), '&'), CAST(array() AS array<string>)))"
    decoded = lambda part: decode_sql(f"replace({part}, '+', ' ')")
    pairs = f"transform(filter({split}, p -> p RLIKE '(?s)^[^=]*=.'), p -> named_struct('k', {decoded("substring_index(p, '=', 1)")}, 'v', {decoded("substring(p, instr(p, '=') + 1)")}))"
    host = r"regexp_replace(rtrim('.', lower(regexp_extract(regexp_extract(e.site, '([^@]*)$', 1), '^(\\[[^\\]]*\\]?|[^:]*)', 1))), '^www[.]', '')"
    valid = r"(instr(e.site, '[') > 0) = (instr(e.site, ']') > 0)"
    known = f"transform({pieces}, e -> named_struct('url', e.url, 'trail', e.trail, 'place', e.place, 'valid', {valid}, 'path', e.path, 'host', {host}, 'pairs', {pairs}))"
    named = f"transform({known}, e -> named_struct('url', e.url, 'trail', e.trail, 'place', e.place, 'valid', e.valid, 'pairs', e.pairs, 'assistant', IF(e.valid, {assistant_sql('e')}, NULL)))"
    value = lambda p: f"try_element_at(filter(e.pairs, q -> lower(q.k) = '{p}'), -1).v"
    param = "CASE " + " ".join(f"WHEN {value(p)} RLIKE r'(?U)\\S' THEN '{p}'" for p in V.PROMPT_PARAMS) + " END"
    chosen = f"transform({named}, e -> named_struct('url', e.url, 'trail', e.trail, 'place', e.place, 'valid', e.valid, 'pairs', e.pairs, 'assistant', e.assistant, 'param', IF(e.assistant IS NULL, NULL, {param})))"
    return f"transform({chosen}, e -> named_struct('url', e.url, 'trail', e.trail, 'place', e.place, 'valid', e.valid, 'pairs', e.pairs, 'assistant', e.assistant, 'param', e.param, 'raw', try_element_at(filter(e.pairs, q -> lower(q.k) = e.param), -1).v))"


def nested_sql(parsed: str) -> str:
    """Entries for the addresses within the parameters of links that are no assistant's."""
    probe = f"aggregate(sequence(1, {V.PROBE_ROUNDS}), q.v, (s, i) -> IF(s RLIKE r'{WEB}', s, {decode_sql('s')}))"
    names = ", ".join(f"'{n}'" for n in V.NESTED_URL_PARAMS)
    inner = f"filter(transform(e.pairs, (q, i) -> named_struct('k', q.k, 'u', {probe}, 'i', i)), q -> (lower(q.k) IN ({names}) OR q.u RLIKE r'{WEB}') AND q.u RLIKE r'{HOSTISH}')"
    entries = f"transform({inner}, q -> named_struct('url', q.u, 'trail', array_append(e.trail, e.url), 'place', array_append(e.place, q.i)))"
    return f"flatten(transform(filter({parsed}, e -> e.assistant IS NULL AND e.valid), e -> {entries}))"


def with_hit(df: DataFrame, url: str, out: str = "hit") -> DataFrame:
    """df with a struct `out` (assistant, param, raw, trail, valid); assistant is null where no assistant link is found.

    Wrappers are followed level by level; of all hits the first in depth-first order counts.
    """
    steps, entries = [], f"array(named_struct('url', {url}, 'trail', CAST(array() AS array<string>), 'place', CAST(array() AS array<int>)))"
    for level in range(V.UNWRAP_LEVELS + 1):
        steps.append(f"__{out}_{level}")
        df = df.withColumn(steps[-1], F.expr(once(f"IF({url} IS NULL, NULL, {parsed_sql(entries)})")))
        entries = nested_sql(steps[-1])
    hits = f"array_sort(filter(concat({', '.join(steps)}), e -> e.assistant IS NOT NULL), (a, b) -> CASE WHEN a.place < b.place THEN -1 WHEN a.place > b.place THEN 1 ELSE 0 END)"
    first = f"try_element_at({hits}, 1)"
    picked = f"transform(array({first}), h -> named_struct('assistant', h.assistant, 'param', h.param, 'raw', h.raw, 'trail', coalesce(h.trail, array()), 'valid', element_at({steps[0]}, 1).valid))"
    return df.withColumn(out, F.expr(once(f"element_at({picked}, 1)"))).drop(*steps)


def check_links(links: DataFrame, url: str = "url") -> DataFrame:
    """links with assistant, param, prompt, unwrapped_from, findings, score, verdict, notes and error."""
    df = with_hit(links, url, "__hit")
    df = df.withColumn("__decoded", F.when(F.col("__hit.raw").isNotNull(), F.expr(once(decode_rounds_sql("__hit.raw")))))
    df = df.withColumn("prompt", F.col("__decoded.v"))
    df = prompt_findings(df, "prompt", "findings", "__notes")
    again = F.expr(finding_sql("ENC-002", "concat('decoded ', __decoded.n + 1, ' times')"))
    df = df.withColumn("findings", once_column(F.when(F.col("__decoded.n") >= 1, F.concat(F.array(again), "findings")).otherwise(F.col("findings"))))
    assistant, trail = F.col("__hit.assistant"), F.col("__hit.trail")
    found, carries = assistant.isNotNull(), F.col("prompt").isNotNull()
    score = F.when(carries, total(F.col("findings"))).otherwise(0)
    notes = F.concat(
        F.array_compact(F.array(
            F.when(~found, "Not a recognised AI-assistant link, and no assistant link found inside it."),
            F.when(found & (F.size(trail) > 0), F.concat(F.lit("The real destination was hidden inside "), F.size(trail).cast("string"), F.lit(" wrapper link(s)."))),
            F.when(found & ~carries, F.concat(F.lit("Opens "), assistant, F.lit(" but carries no pre-filled prompt."))),
        )),
        F.col("__notes"),
    )
    error = F.when(~F.col("__hit.valid"), "invalid address")
    return df.withColumns({
        "assistant": assistant,
        "param": F.col("__hit.param"),
        "unwrapped_from": F.coalesce(trail, F.array().cast("array<string>")),
        "score": score,
        "verdict": F.when(error.isNotNull(), None).when(~found, "NOT_ASSISTANT_LINK").when(~carries, "NO_PROMPT").otherwise(verdict(F.col("findings"), score)),
        "notes": notes,
        "error": error,
    }).drop("__hit", "__decoded", "__notes")


ATTRIBUTE = r"""(?is)(?:href|src|action|data-href|data-url)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


@F.pandas_udf(T.ArrayType(T.StringType()))
def entities_decoded(texts: pd.Series) -> pd.Series:
    """All named and numeric HTML entities, with or without semicolon, longest name first, in one scan from the left; Spark has no function for it."""
    return texts.map(lambda ts: None if ts is None else [None if t is None else unescape(t) for t in ts])


def unescaped(texts: Column) -> Column:
    """Array of texts with their entities decoded. Only rows with an ampersand go through Python."""
    needs = F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit("&")), F.lit(False)))
    return F.coalesce(entities_decoded(F.when(needs, texts)), texts)


def quoted_links(html: Column) -> Column:
    """Array of a page's attribute values that are addresses, decoded."""
    return unescaped(F.transform(F.regexp_extract_all(html, F.lit(ATTRIBUTE), F.lit(0)), lambda m: F.regexp_extract(m, r"""(?is)=\s*["'](.*)["']$""", 1)))


def extracted_links(html: Column) -> Column:
    """Array of links in a page: attribute values, then addresses anywhere else; trimmed, no repeats, in order."""
    quoted = quoted_links(html)
    bare = F.array_except(F.regexp_extract_all(html, F.lit(V.URL_IN_TEXT), F.lit(0)), quoted)
    return F.filter(F.array_distinct(F.transform(F.concat(quoted, bare), F.trim)), lambda u: u != "")


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per web link of a page, with its position `ord` and the page's other columns."""
    rest = [c for c in pages.columns if c != html]
    df = pages.select(*rest, extracted_links(F.col(html)).alias("__links")).select(*rest, F.posexplode("__links").alias("ord", "url"))
    df = df.where(F.col("url").rlike(r"(?i)^(?:https?:)?//|^www\."))
    return df.withColumn("url", F.when(F.col("url").startswith("//"), F.concat(F.lit("https:"), "url")).otherwise(F.col("url")))


def scan_pages_for_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """The assistant links of pages, judged."""
    return check_links(page_links(pages, html)).where("assistant IS NOT NULL")


def marker_pattern() -> str:
    return "|".join(sorted({*V.ASSISTANT_HOSTS, *(p[0] for p in V.PATH_ASSISTANTS)})).replace(".", "[.]")


def mentions_assistant(html: Column) -> Column:
    return F.lower(html).rlike(marker_pattern())


def follow_targets(prompt: Column) -> Column:
    """At most three distinct addresses that a prompt names."""
    found = F.array_distinct(F.regexp_extract_all(prompt, F.lit(V.URL_IN_TEXT), F.lit(0)))
    return F.transform(F.slice(found, 1, 3), lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))


def article_links(pages: DataFrame, base: str, html: str, most: int) -> DataFrame:
    """(base, url, place): the links of each page that look most like articles of the same site."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#:]*)", 1)), r"^www\.", "")
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"(?i)^(https?://[^?#]*)", 1), r"(?<=[^/:]/)[^/]*$", "")
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    rows = pages.select(base, unescaped(hrefs).alias("hrefs")).select(base, F.posexplode("hrefs").alias("ord", "href")).withColumn("href", F.trim("href"))
    absolute = (
        F.when(F.col("href").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract(base, r"(?i)^(https?:)", 1), "href"))
        .when(F.col("href").startswith("/"), F.concat(root, "href"))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(root, F.lit("/"))), "href"))
    )
    rows = rows.withColumn("url", F.regexp_replace(absolute, r"[?#].*$", "")).withColumn("path", F.regexp_extract("url", r"(?i)^https?://[^/]*(.*)$", 1))
    rows = rows.where(F.col("url").rlike(r"(?i)^https?://") & (host(F.col("url")) == host(F.col(base))) & ~F.col("path").isin("", "/"))
    rows = rows.where(~F.col("path").rlike(r"(?i)\.(?:jpe?g|png|gif|webp|svg|ico|pdf|zip|gz|mp4|mp3|css|js|json|xml|rss|woff2?|ttf)$"))
    hint = r"(?i)/(?:blog|news|article|articles|post|posts|stories|story|insights|guides?|learn|resources)/|/20\d\d/|[a-z0-9]+-[a-z0-9]+-[a-z0-9]+"
    score = F.when(F.col("path").rlike(hint), 6).otherwise(0) + F.least(F.regexp_count("path", F.lit("-")), F.lit(6))
    ranked = rows.groupBy(base, "url").agg(F.min("ord").alias("ord"), F.max(score).alias("score")).where("score > 0")
    best = ranked.groupBy(base).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ord", "url"))), 1, most).alias("best"))
    return best.select(base, F.posexplode("best").alias("place", "b")).select(base, F.col("b.url").alias("url"), (F.col("place") + 1).alias("place"))


def address_key(url: Column) -> Column:
    """What addresses of one page share: host without www. and path without its last slash, lower-cased host; null without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^\s*(?:https?:)?//([^/?#:\s]+)", 1)), r"^www\.|\.$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^\s*(?:https?:)?//[^/?#\s]*([^?#\s]*)", 1), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def followed(links: DataFrame, pages: DataFrame, id_col: str, prompt: str = "prompt") -> DataFrame:
    """(id, place, url, page): for each row of links the first three addresses that its prompt names, and what a table of pages knows of each.

    pages: (url, page), page of any type, say a report, and further columns that order rows of one url; of several rows of an
    address that with the smallest url counts, of these the first by the further columns.
    An address without a page has null. Pages are aggregated by address before the join, so that a popular address meets one
    row; the join's own skew handling splits an address that many prompts name.
    """
    targets = links.select(F.col(id_col).alias("id"), follow_targets(F.col(prompt)).alias("__urls")).select("id", F.posexplode("__urls").alias("place", "url"))
    order = [c for c in pages.columns if c not in ("url", "page")]
    known = pages.withColumn("key", address_key(F.col("url"))).where("key IS NOT NULL").groupBy("key").agg(F.min_by("page", F.struct("url", *order)).alias("page"))
    return targets.withColumn("key", address_key(F.col("url"))).join(known, "key", "left").select("id", (F.col("place") + 1).alias("place"), "url", "page")
