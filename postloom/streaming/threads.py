"""Threads on streams: the last page as pages arrive, and titles that arrive beside the pages."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from postloom.operators.posts import page_outcomes
from postloom.sites import Site

_PAGE_NUMBER = r"p(\d+)$"
_FOUND = "thread_url string, last_page int, missing boolean, page string"
_STATE = "last int, page int, sent int, held string"


def _follow(key, batches, state):
    """Keeps a thread's highest page until it is the last one, then lets it go."""
    (thread,) = key
    if state.hasTimedOut:
        last, page, sent, _ = state.get
        state.remove()
        if sent < last:
            yield pd.DataFrame({"thread_url": [thread], "last_page": [last], "missing": [True], "page": [None]})
        return
    last, page, sent, held = state.get if state.exists else (0, 0, 0, None)
    until = 0
    for rows in batches:
        until = max(until, int(rows["until"].max()))
        last = max(last, int(rows["last"].max()), int(rows["page_no"].max()))
        at = rows["page_no"].idxmax()
        if rows["page_no"][at] > page:
            page, held = int(rows["page_no"][at]), rows["page"][at]
    if page == last and page > sent:
        yield pd.DataFrame({"thread_url": [thread], "last_page": [last], "missing": [False], "page": [held]})
        sent, held = page, None
    state.update((last, page, sent, held))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))


def _timed(rows: DataFrame, event_time: str, late: str) -> DataFrame:
    """With a watermark, unless the caller set one further up, where rows that are filtered out
    later still move it."""
    set_ = "spark.watermarkDelayMs" in rows.schema[event_time].metadata
    return rows if set_ else rows.withWatermark(event_time, late)


def last_page_extracts(
    extracts: DataFrame, event_time: str, late: str = "1 hour", patience: str = "1 day"
) -> DataFrame:
    """Of a stream of `read_threads` rows, one row per thread: its last page.

    Adds thread_url, last_page and missing. A thread's last page is the highest that any of its
    pages shows or is. It is given out once it is there, whatever the order of arrival; if the
    thread has grown by a later crawl, its new last page is given out as well (the greatest
    `last_page` counts). Where the last page does not come within `patience` of the newest page's
    `event_time`, the row has `missing` and nulls. Of two copies of a page the first counts.
    The state holds one page per open thread and goes after `patience`. Pages whose event time is
    null cannot be waited for and count as long past.
    """
    columns = [f for f in extracts.schema if f.name != event_time]
    page = T.StructType(columns)
    number = F.coalesce(F.regexp_extract("url", _PAGE_NUMBER, 1).try_cast("int"), F.lit(1))
    until = F.unix_millis(F.col(event_time) + F.expr(f"interval {patience}"))
    keyed = _timed(extracts, event_time, late).select(
        F.regexp_replace("url", _PAGE_NUMBER, "").alias("thread_url"),
        number.alias("page_no"),
        F.coalesce("page_count", F.lit(1)).alias("last"),
        F.coalesce(until, F.lit(0)).alias("until"),
        F.to_json(F.struct(*[f.name for f in columns])).alias("page"),
        event_time,
    )
    found = keyed.groupBy("thread_url").applyInPandasWithState(
        _follow, _FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        "thread_url", "last_page", "missing", F.from_json("page", page).alias("page")
    ).select("thread_url", "last_page", "missing", "page.*")


def titled_pages(
    extracts: DataFrame,
    threads: DataFrame,
    page_time: str,
    listing_time: str,
    *,
    late: str = "1 hour",
    within: str = "1 day",
) -> DataFrame:
    """A stream of `read_threads` rows with the thread_title that a stream of listing links
    (thread_url, thread_title, `listing_time`) has for the page, whichever arrives first.

    A page is matched to links seen at most `within` before or after it; a thread listed twice
    gives its page twice. A page without a link, or whose link is never seen, comes with a null
    title once the watermark has passed `within`. Both sides are kept no longer than that. Set the
    listings' watermark before their links are taken, so that a listing without links counts too.
    """
    pages = _timed(extracts, page_time, late).withColumn(
        "_thread", F.regexp_replace("url", _PAGE_NUMBER, "")
    )
    links = _timed(threads, listing_time, late).select(
        F.col("thread_url").alias("_link"), F.col("thread_title"), F.col(listing_time).alias("_listed")
    )
    span = F.expr(f"interval {within}")
    near = (
        (F.col("_thread") == F.col("_link"))
        & (F.col("_listed") >= F.col(page_time) - span)
        & (F.col("_listed") <= F.col(page_time) + span)
    )
    return pages.join(links, near, "left_outer").drop("_thread", "_link", "_listed")


def last_page_outcomes(pages: DataFrame, site: Site) -> DataFrame:
    """`page_outcomes` of `last_page_extracts` rows, with the reason "no page" for threads whose
    last page is missing, and last_page. Page-local, so it runs on a stream too."""
    named = pages.withColumn("url", F.coalesce("url", "thread_url"))
    found = page_outcomes(named, site, keep=["last_page", "missing"])
    return found.withColumn(
        "reason", F.when(F.col("missing"), "no page").otherwise(F.col("reason"))
    ).drop("missing")
