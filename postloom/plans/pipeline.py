"""The three stages in a row: pages to posts, posts to English, English to scores."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import is_blank
from postloom.operators.extract import (
    has_address,
    links_of,
    listing_outcomes,
    read_listings,
    read_threads,
)
from postloom.operators.joins import ROWS_PER_TASK
from postloom.operators.posts import (
    canonical,
    complete,
    explode_posts,
    rejects,
    superseded,
    thread_pages,
    union_sources,
)
from postloom.operators.rules import Rules
from postloom.operators.sentiment import score
from postloom.operators.translate import TRANSLATED, glossary_translate, translate
from postloom.schemas import TRANSLATION_MEMORY
from postloom.sites import Site
from postloom.sources.scratch import stage


@dataclass
class Extraction:
    """Frames of one source, all over pages that were parsed once: listing pages and threads with
    their outcomes, good posts, rejected posts, and addresses with copies that were set aside."""

    listings: DataFrame
    threads: DataFrame
    posts: DataFrame
    rejects: DataFrame
    superseded: DataFrame


def extract_source(
    listings: DataFrame,
    pages: DataFrame,
    site: Site,
    order_by: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Extraction:
    """Listing pages and thread pages of one site to its posts.

    Runs at once up to the extracts: each page is parsed and its small extract written; the
    frames read those. A page crawled twice gives its posts twice. With `order_by`, a column of
    `pages`, only its newest copy counts, and the others are in `superseded`.
    """
    read = stage(read_listings(listings, site), f"{site.name}-listings")
    extracts = stage(read_threads(pages, site), f"{site.name}-extracts")
    outcomes = thread_pages(
        has_address(links_of(read)), extracts, site, order_by=order_by, rows_per_task=rows_per_task
    )
    posts = explode_posts(outcomes)
    aside = superseded(extracts)
    return Extraction(
        listing_outcomes(read),
        outcomes,
        complete(posts),
        rejects(posts),
        aside if order_by else aside.limit(0),
    )


def extract_each(jobs: dict[str, Callable[[], Extraction]]) -> tuple[dict, dict]:
    """(extractions, errors) by name: a source that fails leaves the others alone."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as error:
            failed[name] = error
    return done, failed


def run_counts(extractions: dict[str, Extraction], enriched: DataFrame | None = None) -> DataFrame:
    """(stage, source, reason, rows): outcomes of listings and threads, threads of one page, among
    them those whose page count was taken as 1 for want of a label ("defaulted"), kept and rejected
    posts and, from `enriched`, by what the texts were translated."""
    parts = []

    def add(stage_name, source, rows, reason):
        counted = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))
        parts.append(
            counted.select(F.lit(stage_name).alias("stage"), F.lit(source).alias("source"), "reason", "rows")
        )

    for name, found in extractions.items():
        add("listing", name, found.listings, F.col("outcome"))
        add("thread", name, found.threads, F.col("outcome"))
        if "last_page" in found.threads.columns:
            add("page count", name, found.threads.where("last_page = 1"), F.lit("one page or no label"))
            add("page count", name, found.threads.where("not last_page_found"), F.lit("defaulted"))
        add("post", name, found.posts, F.lit("kept"))
        add("post", name, found.rejects, F.col("reason"))
    if enriched is not None:
        add("translation", None, enriched, F.col("via"))
    return union_sources(parts)


def all_posts(extractions: list[Extraction]) -> DataFrame:
    """One canonical table of all sources."""
    return union_sources([canonical(e.posts) for e in extractions])


def enrich(
    posts: DataFrame,
    lexicon: DataFrame,
    memory: DataFrame | None = None,
    glossary: DataFrame | None = None,
    make_backend=None,
    rules: Rules | None = None,
    text: str = "post_content",
) -> DataFrame:
    """Posts with translated_post_content, via and sentiment_score.

    A text is translated by the memory, else by the backend, else token by token by the glossary;
    what is not given is passed over, and a text that none of them knows stays as it is. `via`
    says which it was: memory, backend, glossary, original or blank.
    """
    if memory is None and make_backend is not None:
        memory = posts.sparkSession.createDataFrame([], TRANSLATION_MEMORY)
    if memory is not None:
        posts = translate(posts, memory, text, make_backend=make_backend)
    else:
        blank = is_blank(F.col(text))
        posts = posts.withColumns(
            {
                TRANSLATED: F.when(blank, "").otherwise(F.col(text)),
                "via": F.when(blank, "blank").otherwise("original"),
            }
        )
    if glossary is not None:
        others = [c for c in posts.columns if c not in (TRANSLATED, "via")]
        posts = posts.withColumnsRenamed({TRANSLATED: "_known", "via": "_via"})
        # No tokens are made of a text that has its translation.
        asked = posts.withColumn("_asked", F.when(F.col("_via") == "original", F.col(text)))
        by_token = glossary_translate(asked, glossary, "_asked", known="_hit")
        # A text of which no token has an entry stays as it is, white space and all.
        changed = (F.col("_via") == "original") & F.col("_hit")
        posts = by_token.select(
            *others,
            F.when(changed, F.col(TRANSLATED)).otherwise(F.col("_known")).alias(TRANSLATED),
            F.when(changed, "glossary").otherwise(F.col("_via")).alias("via"),
        )
    return score(posts, lexicon, rules=rules)
