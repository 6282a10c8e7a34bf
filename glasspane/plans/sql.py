"""SQL names for the operators: functions for any statement, and views over tables that are registered already."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import composed
from ..operators.links import check_links, scan_pages_for_links
from ..operators.pages import page_chunks, page_reports, read_chunks, spelled
from ..operators.rules import FINDING

class PageChunks:
    """page_chunks(html): ord, text, where, how, tag of a page's chunks, and of what invisible tag characters in them spell."""

    def eval(self, html: str):
        found = read_chunks(html)[0] if html else []
        for n, chunk in enumerate(found):
            yield (n, *chunk)
        for n, (text, _, _, tag) in enumerate(found):
            if (hidden := spelled(text)).strip(" "):
                yield (n + (1 << 24), hidden, "invisible-unicode", "Unicode tag characters", tag)


def register_functions(spark: SparkSession) -> None:
    """Makes these known to the session's SQL:

    normalise_texts(array<string>), normalise_text(string): lower case, composed, without hidden characters, as rules see it;
    finding_score, finding_verdict(array of findings): as the columns `score` and `verdict` of reports;
    page_chunks(string): a table function for LATERAL. Null in, null (or no findings, no chunks) out.
    """
    spark.udf.register("composed_texts", composed)
    spark.udtf.register("page_chunks", F.udtf(PageChunks, returnType="ord int, text string, where string, how string, tag string"))
    needs = r"exists(texts, t -> t RLIKE r'[^\x00-\x7f]' OR t RLIKE r'\w[.\-_*]\w[.\-_*]\w[.\-_*]\w')"
    some = lambda *names: "exists(found, x -> x.category IN (" + ", ".join(f"'{n}'" for n in names) + "))"
    covered = f"(x.category = 'memory-weak' AND {some('memory').replace('x ->', 'y ->').replace('x.', 'y.')}) OR (x.category = 'trust-weak' AND {some('trust').replace('x ->', 'y ->').replace('x.', 'y.')})"
    bodies = {
        "normalise_texts(texts ARRAY<STRING>) RETURNS ARRAY<STRING>": rf"transform(coalesce(composed_texts(IF({needs}, texts, NULL)), texts), t -> trim(lower(regexp_replace(t, r'(?U)\s+', ' '))))",
        "normalise_text(said STRING) RETURNS STRING": "element_at(normalise_texts(array(said)), 1)",
        f"finding_score(found ARRAY<{FINDING}>) RETURNS INT": f"aggregate(found, 0, (s, x) -> s + IF({covered}, 0, x.weight)) + IF({some('memory')} AND {some('trust')}, 3, 0) + IF({some('exfiltration')}, 3, 0) + IF({some('override')} AND {some('memory', 'trust', 'exfiltration')}, 2, 0)",
        f"finding_verdict(found ARRAY<{FINDING}>) RETURNS STRING": f"CASE WHEN {some('exfiltration')} OR finding_score(found) >= 7 THEN 'DANGEROUS' WHEN finding_score(found) >= 4 THEN 'SUSPICIOUS' ELSE 'LOOKS_SAFE' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register(spark: SparkSession, links: str | None = None, pages: str | None = None) -> None:
    """links: a table with url; pages: a table with page_id, html. Views: link_reports, page_links, page_chunks, page_reports."""
    if links:
        check_links(spark.table(links)).createOrReplaceTempView("link_reports")
    if pages:
        table = spark.table(pages)
        scan_pages_for_links(table).createOrReplaceTempView("page_links")
        page_chunks(table).createOrReplaceTempView("page_chunks")
        page_reports(page_chunks(table)).createOrReplaceTempView("page_reports")
