"""Page records of a crawl as they arrive, gathered to one record per site as soon as it is complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "site string, status string, n_pages long, pages array<string>"
STATE = "urls array<string>, seen array<string>, wanted int, closed boolean"


def site_records_stream(pages: DataFrame, wait: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """(site, status, n_pages, pages) from a stream of (site, url, record, expected, at).

    record: a page's JSON; expected: how many pages the site's visit has, as far as known; at: event time. A site's record goes
    out once all its pages are there (`complete`), or as far as it came once the watermark is `wait` past its latest page
    (`timed out`). After that the site's name is kept for `keep`, and pages that still come go out on their own (`late`); then
    it is forgotten, and a page that comes even later begins a new record. Pages are in order of their address; an address
    that comes again counts once, its first record stays; rows without a site or address are left out, null records are
    empty. The watermark drops pages that are older than it before they get here.

    The state of a site is its pages until its record is out, and its addresses until `keep` is over: bounded by a visit.
    """
    kept = pd.Timedelta(keep) // pd.Timedelta("1ms")

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        urls, seen, wanted, closed = state.get if state.exists else ([], [], None, False)
        known = dict(zip(urls, seen or [""] * len(urls), strict=True))

        def out(status, found):
            return pd.DataFrame([(key[0], status, len(found), [found[u] for u in sorted(found)])], columns=["site", "status", "n_pages", "pages"])

        if state.hasTimedOut:
            if closed:
                state.remove()
            else:
                yield out("timed out", known)
                state.update((list(known), [], wanted, True))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + kept)
            return
        latest, new = 0, {}
        for batch in batches:
            for url, record, expected, at in zip(batch["url"], batch["record"], batch["expected"], batch["at"], strict=True):
                latest = max(latest, int(at.timestamp() * 1000))
                if url not in known and (url not in new or (record or "") < new[url]):
                    new[url] = record or ""
                if expected is not None and expected == expected:
                    wanted = max(wanted or 0, int(expected))
        if closed:
            if new:
                yield out("late", new)
            known |= new
        else:
            known |= new
            if wanted is not None and len(known) >= wanted:
                yield out("complete", known)
                closed = True
        state.update((list(known), [] if closed else list(known.values()), wanted, closed))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + (kept if closed else 0) + 1)

    rows = pages.where("site IS NOT NULL AND url IS NOT NULL AND at IS NOT NULL").select("site", "url", "record", F.col("expected").cast("int").alias("expected"), "at")
    return rows.withWatermark("at", wait).groupBy("site").applyInPandasWithState(gather, RECORD, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def as_page_rows(records: DataFrame) -> DataFrame:
    """Page records (site, url, ai_links, content, candidates) as (site, url, record): the record as JSON."""
    return records.select("site", "url", F.to_json(F.struct("url", "ai_links", "content", "candidates"), {"ignoreNullFields": "false"}).alias("record"))


def write(df: DataFrame, path: str, checkpoint: str):
    """Append records as JSON lines, all that is there now."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
