"""Listings to threads, thread pages to posts. Everything here is page-local: no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.html import parse_html
from postloom.functions.select import (
    Selector,
    below,
    find,
    find_all,
    text_fused,
    text_inline,
    text_joined,
    zip_truncate,
)
from postloom.functions.text import absolute_url, page_count, prefixed_url, shown_page_count
from postloom.sites import CELL, CELL_LINK, CELL_LINK_BASE, Site

TEXTS, NODES = "page.texts", "page.nodes"


def outlines(pages: DataFrame) -> DataFrame:
    """`html` replaced by the parsed `page`. Filter pages before this call, not after."""
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, parse_html("html").alias("page"))


def elements(pages: DataFrame, selector: Selector, **texts) -> DataFrame:
    """One row per matching element: its position from 1, tag, href, and a column per given text
    function; `text=text_joined` unless told otherwise."""
    texts = texts or {"text": text_joined}
    found = F.transform(
        find_all(NODES, selector),
        lambda n: F.struct(
            n["tag"].alias("tag"),
            n["href"].alias("href"),
            *[text(TEXTS, n).alias(name) for name, text in texts.items()],
        ),
    )
    parsed = outlines(pages)
    others = [c for c in parsed.columns if c != "page"]
    exploded = parsed.select(*others, F.posexplode(found).alias("pos", "el"))
    return exploded.select(*others, (F.col("pos") + 1).alias("pos"), "el.*")


def first_text(pages: DataFrame, selector: Selector, name: str = "title") -> DataFrame:
    """Each page with the one-line text of its first match; null where nothing matches."""
    parsed = outlines(pages)
    others = [c for c in parsed.columns if c != "page"]
    return (
        parsed.withColumn("_hit", find(NODES, selector))
        .select(*others, text_inline(TEXTS, F.col("_hit")).alias(name))
    )


def child_elements(pages: DataFrame, outer: Selector, inner: Selector) -> DataFrame:
    """One row per outer element with its first inner element; nulls where it has none."""
    hits = F.transform(find_all(NODES, outer), lambda n: find(below(NODES, n), inner))
    shown = F.transform(
        hits,
        lambda n: F.struct(n["href"].alias("href"), text_joined(TEXTS, n).alias("text_joined")),
    )
    parsed = outlines(pages)
    others = [c for c in parsed.columns if c != "page"]
    exploded = parsed.select(*others, F.posexplode(shown).alias("pos", "el"))
    return exploded.select(*others, (F.col("pos") + 1).alias("pos"), "el.*")


def paired_elements(pages: DataFrame, left: Selector, right: Selector) -> DataFrame:
    """The page's left and right matches paired by position, up to the shorter list."""
    pairs = zip_truncate(
        find_all(NODES, left),
        find_all(NODES, right),
        lambda a, b, i: F.struct(
            (i + 1).alias("pos"),
            text_joined(TEXTS, a).alias("left_text"),
            text_joined(TEXTS, b).alias("right_text"),
        ),
    )
    parsed = outlines(pages)
    others = [c for c in parsed.columns if c != "page"]
    return parsed.select(*others, F.inline(pairs))


def read_listings(listings: DataFrame, site: Site) -> DataFrame:
    """One row per listing page: its own columns, with `url` as listing_url, then readable and
    links array<struct<thread_url, thread_title>>, also those without a usable address."""
    links = F.transform(
        find_all(NODES, site.links),
        lambda n: F.struct(
            absolute_url(n["href"], F.col("listing_url")).alias("thread_url"),
            text_inline(TEXTS, n).alias("thread_title"),
        ),
    )
    parsed = outlines(listings.withColumnRenamed("url", "listing_url"))
    others = [c for c in parsed.columns if c != "page"]
    return parsed.select(*others, F.col("page").isNotNull().alias("readable"), links.alias("links"))


def links_of(read: DataFrame) -> DataFrame:
    """One row per link of `read_listings`, in page order, with thread_pos from 1."""
    others = [c for c in read.columns if c not in ("readable", "links")]
    return read.select(*others, F.posexplode("links").alias("pos", "link")).select(
        *others, (F.col("pos") + 1).alias("thread_pos"), "link.*"
    )


def listing_links(listings: DataFrame, site: Site) -> DataFrame:
    """Thread links of listing pages, in page order, also those without a usable address.

    Adds thread_pos (from 1), thread_url and thread_title to the listing's own columns;
    the listing's `url` becomes listing_url. Pages without links: see `listing_outcomes`.
    """
    return links_of(read_listings(listings, site))


def listing_outcomes(read: DataFrame) -> DataFrame:
    """(listing_url, n_links, outcome) of every page of `read_listings`: kept, unreadable or no
    links."""
    n = F.when(F.col("readable"), F.coalesce(F.size("links"), F.lit(0))).otherwise(0)
    return read.select(
        "listing_url",
        n.alias("n_links"),
        F.when(~F.col("readable"), "unreadable").when(n == 0, "no links").otherwise("kept").alias(
            "outcome"
        ),
    )


def cell_links(listings: DataFrame) -> DataFrame:
    """The prototype listing: first link of each title cell, under the site's address."""
    cells = child_elements(listings, CELL, CELL_LINK).where("href is not null")
    return cells.withColumn("thread_url", prefixed_url(F.col("href"), CELL_LINK_BASE))


def has_address(threads: DataFrame) -> DataFrame:
    return threads.where("thread_url is not null and thread_url <> ''")


def lacks_address(threads: DataFrame) -> DataFrame:
    return threads.where("thread_url is null or thread_url = ''")


def read_threads(pages: DataFrame, site: Site) -> DataFrame:
    """One small row per page: title, counts and posts, in place of the html.

    Columns: the page's own, then readable, page_title, n_items, n_dates, page_count,
    page_count_found (whether the page shows it) and posts array<struct<post_index, post_date,
    post_content>>. n_items counts before pairing.
    """
    parsed = outlines(pages)
    others = [c for c in parsed.columns if c != "page"]
    found = parsed.withColumns(
        {
            "_items": find_all(NODES, site.items),
            "_title": find(NODES, site.title) if site.title else F.lit(None),
            "_label": find(NODES, site.page_label) if site.page_label else F.lit(None),
        }
    )
    date_text = text_inline if site.date_inline else text_fused
    if site.pairing == "child":
        found = found.withColumn("_dates", F.col("_items"))
        pairs = F.transform(
            "_items",
            lambda n, i: F.struct(
                i.alias("i"),
                find(below(NODES, n), site.date).alias("date"),
                find(below(NODES, n), site.body).alias("body"),
            ),
        )
    else:
        found = found.withColumn("_dates", find_all(NODES, site.date))
        pairs = zip_truncate(
            F.col("_items"),
            F.col("_dates"),
            lambda item, date, i: F.struct(i.alias("i"), date.alias("date"), item.alias("body")),
        )
    posts = F.transform(
        pairs,
        lambda p: F.struct(
            (p["i"] + 1).alias("post_index"),
            date_text(TEXTS, p["date"]).alias("post_date"),
            text_joined(TEXTS, p["body"]).alias("post_content"),
        ),
    )
    return found.select(
        *others,
        F.col("page").isNotNull().alias("readable"),
        (text_inline(TEXTS, F.col("_title")) if site.title else F.lit(None).cast("string")).alias(
            "page_title"
        ),
        F.coalesce(F.size("_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.size("_dates"), F.lit(0)).alias("n_dates"),
        (page_count(text_inline(TEXTS, F.col("_label"))) if site.page_label else F.lit(1)).alias(
            "page_count"
        ),
        (
            shown_page_count(text_inline(TEXTS, F.col("_label"))).isNotNull()
            if site.page_label
            else F.lit(False)
        ).alias("page_count_found"),
        posts.alias("posts"),
    )
