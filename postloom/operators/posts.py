"""Threads and page extracts to the post table, with every skip and reject accounted for."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.text import last_page_url
from postloom.operators.joins import ROWS_PER_TASK, fits, spread_join
from postloom.schemas import CANONICAL, LEGACY
from postloom.sites import Site
from postloom.sources.scratch import stage


def newest_copies(extracts: DataFrame, order_by: str) -> DataFrame:
    """One extract per url: the one with the greatest `order_by`, where null is least and equal
    ones are told apart by their content. Map-side combined, so an address with many copies moves
    one per task."""
    columns = [c for c in extracts.columns if c != "url"]
    order = F.struct(F.col(order_by), F.xxhash64("n_items", "posts"))
    newest = F.max_by(F.struct(*columns), order).alias("_page")
    return extracts.groupBy("url").agg(newest).select("url", "_page.*")


def superseded(extracts: DataFrame) -> DataFrame:
    """(url, reason, copies) of addresses of which `newest_copies` sets copies aside."""
    counts = extracts.groupBy("url").agg((F.count("*") - 1).alias("copies")).where("copies > 0")
    return counts.select("url", F.lit("superseded").alias("reason"), "copies")


def thread_pages(
    threads: DataFrame,
    extracts: DataFrame,
    site: Site,
    *,
    order_by: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each listed thread with the extract of the page its posts come from, and an outcome:
    kept, no page, unreadable, no title or no posts.

    Rows are a bag: a thread listed twice is there twice, and so is one whose page was crawled
    twice, unless `order_by` names the column by which the newest copy counts. The html is gone by
    now: only the small extracts are shuffled. They are read more than once, so give a staged
    table, or each page is parsed again.
    """
    threads = stage(threads, f"{site.name}-threads")
    extracts = extracts.select(
        "url", *([order_by] if order_by else []),
        "readable", "page_title", "n_items", "page_count", "page_count_found", "posts",
    )
    if order_by:
        extracts = newest_copies(extracts, order_by).drop(order_by)
    if site.last_page_only:
        first = extracts.groupBy("url").agg(
            F.max("n_items").alias("first_items"),
            F.max("page_count").alias("last_page"),
            F.max("page_count_found").alias("last_page_found"),
        )
        first = stage(first, f"{site.name}-first-pages")
        named = first.withColumnRenamed("url", "thread_url")
        threads = spread_join(threads, named, "thread_url", "left", rows_per_task)
        # Page 1 stands under its own number or under the thread's address alone.
        one = first.select(
            F.col("url").alias("_one"),
            F.col("first_items").alias("_one_items"),
            F.col("last_page").alias("_one_last"),
            F.col("last_page_found").alias("_one_found"),
        )
        threads = threads.withColumn("_one", last_page_url(F.col("thread_url"), F.lit(1)))
        threads = spread_join(threads, one, "_one", "left", rows_per_task)
        plain = (F.col("last_page") == 1) & F.col("_one_last").isNull()
        threads = threads.withColumns(
            {
                "last_page": F.coalesce("last_page", "_one_last"),
                "last_page_found": F.coalesce("last_page_found", "_one_found"),
                "first_items": F.coalesce("first_items", "_one_items"),
                "_plain": plain,
            }
        )
        last = last_page_url(F.col("thread_url"), F.col("last_page"))
        threads = threads.withColumns(
            {
                "last_page_url": last,
                "_from": F.when(F.col("_plain"), F.col("thread_url")).otherwise(last),
            }
        ).drop("_one", "_one_items", "_one_last", "_one_found", "_plain")
        threads = stage(threads, f"{site.name}-last-pages")
    else:
        threads = threads.withColumns({"first_items": F.lit(1), "_from": F.col("thread_url")})
    right = extracts.drop("page_count", "page_count_found").withColumnRenamed("url", "_from")
    joined = spread_join(threads, right, "_from", "left", rows_per_task)
    title = F.col("page_title") if site.title else F.col("thread_title")
    return joined.withColumns(
        {
            "source": F.lit(site.name),
            "source_url": F.lit(site.source_url),
            "thread_title": title,
            "outcome": F.when(F.col("readable").isNull(), "no page")
            .when(~F.col("readable"), "unreadable")
            .when(title.isNull(), "no title")
            .when((F.col("n_items") == 0) | (F.col("first_items") == 0), "no posts")
            .otherwise("kept"),
        }
    ).drop("_from", "first_items", "readable", "page_title")


def page_outcomes(
    extracts: DataFrame,
    site: Site,
    threads: DataFrame | None = None,
    need_title: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every post of pages as they arrive, and one row per page that gives none, with `reason`:
    null for a good post, else unreadable, no title, no posts, no date or no body.

    Page-local, so it runs on a stream too; `thread_url` is the page's address without its page
    number. A title that only the listing shows comes from the column thread_title (see
    `streaming.threads.titled_pages`) or from `threads(thread_url, thread_title)`, one row per
    thread; without them such a site's titles stay null. With `need_title` a page without one is
    set aside. Other columns stay where `keep` names them. For each thread's last page alone see
    `streaming.threads.last_page_extracts`.
    """
    page = F.regexp_replace("url", r"p\d+$", "") if site.last_page_only else F.col("url")
    rows = extracts.withColumn("thread_url", page)
    if site.title:
        rows = rows.withColumn("thread_title", F.col("page_title"))
    elif threads is None and "thread_title" in extracts.columns:
        pass
    elif threads is None:
        rows = rows.withColumn("thread_title", F.lit(None).cast("string"))
    else:
        rows = rows.join(threads.select("thread_url", "thread_title"), "thread_url", "left")
    untitled = F.col("thread_title").isNull() if site.title or need_title else F.lit(False)
    page_reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(untitled, "no title")
        .when(F.col("n_items") == 0, "no posts")
    )
    none = F.array().cast(extracts.schema["posts"].dataType)
    found = rows.select(
        F.lit(site.name).alias("source"),
        F.col("url"),
        "thread_url",
        "thread_title",
        F.lit(site.source_url).alias("source_url"),
        *(keep or []),
        page_reason.alias("_reason"),
        F.explode_outer(F.when(page_reason.isNull(), F.col("posts")).otherwise(none)).alias("_post"),
    )
    reason = F.when(F.col("_post").isNotNull(), reject_reason("_post.")).otherwise("no posts")
    return found.select(
        "source", "url", "thread_url", "thread_title", "source_url", *(keep or []), "_post.*",
        F.coalesce("_reason", reason).alias("reason"),
    )


def page_posts(extracts: DataFrame, site: Site, threads: DataFrame | None = None) -> DataFrame:
    """The good posts of `page_outcomes`."""
    return page_outcomes(extracts, site, threads).where("reason is null").drop("reason", "url")


def explode_posts(kept: DataFrame) -> DataFrame:
    """One row per post of the kept threads, complete or not. `post_index` counts from 1 in each
    thread page; it is set before any reject, so it keeps a gap where a post is incomplete."""
    others = [c for c in kept.columns if c not in ("posts", "n_items", "outcome")]
    # The outer form, as the inner one adds a size filter that computes every post again.
    rows = kept.where("outcome = 'kept'").select(*others, F.inline_outer("posts"))
    return rows.where("post_index is not null")


def reject_reason(of: str = "") -> Column:
    return F.when(F.col(f"{of}post_date").isNull(), "no date").when(
        F.col(f"{of}post_content").isNull(), "no body"
    )


def complete(posts: DataFrame) -> DataFrame:
    return posts.where(reject_reason().isNull())


def rejects(posts: DataFrame) -> DataFrame:
    return posts.withColumn("reason", reject_reason()).where("reason is not null")


def canonical(posts: DataFrame) -> DataFrame:
    return posts.select(*CANONICAL)


def legacy(posts: DataFrame) -> DataFrame:
    return posts.select(*LEGACY)


def from_legacy(posts: DataFrame, source_url: str) -> DataFrame:
    """Legacy rows under the canonical schema; the caller knows their one source."""
    return canonical(posts.withColumn("source_url", F.lit(source_url)))


def number_rows(rows: DataFrame, thread: str, position: str, block: int = 100_000) -> DataFrame:
    """post_index for posts that arrive as rows with a numeric position; posts cut from a page
    are numbered on the page instead, without a shuffle.

    The rows are staged, sorted by ranges of (thread, position, tie) of about `block` rows, and
    counted within each range; a thread that goes on over several ranges has the counts of the
    earlier ones added. So no task sorts a whole thread, sparse or equal positions or not. Rows of
    equal position are numbered in the order of their other values; rows equal in all are
    interchangeable, and spread as well. A row without a thread or a position is kept, with a null
    index, and sorted with nothing. There are at most four ranges for each of
    `spark.sql.shuffle.partitions`.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows = stage(rows, "numbered-rows")
    placed = F.col(thread).isNotNull() & F.col(position).isNotNull()
    unplaced = rows.where(~placed).withColumn("post_index", F.lit(None).cast("int"))
    rows = rows.where(placed)
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-rows.count() // block), most))
    # The place in the staged table tells equal rows apart, and a retried task sees it again.
    order = [thread, position, F.xxhash64(*columns), F.monotonically_increasing_id()]
    keyed = rows.withColumns({"_tie": order[2], "_row": order[3]})
    by = [thread, position, "_tie", "_row"]
    ranged = keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    ranged = ranged.select(*columns, F.spark_partition_id().alias("_range"))
    counted = stage(_counted_within(ranged, thread), "ranges")
    ends = counted.groupBy(thread, "_range").agg(F.max("_nth").alias("_n"))
    earlier = Window.partitionBy(thread).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first thread of a range can have begun before it: one row a range.
    before = ends.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    numbered = counted.join(F.broadcast(before), [thread, "_range"], "left").select(
        *columns, (F.col("_nth") + F.coalesce("_before", F.lit(0))).cast("int").alias("post_index")
    )
    return numbered.unionByName(unplaced)


def _counted_within(sorted_rows: DataFrame, thread: str) -> DataFrame:
    """Adds _nth: the rows so far of the same thread, in partitions sorted by thread."""
    place = sorted_rows.columns.index(thread)

    def run(batches):
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(place)
            new = np.ones(len(keys), bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0] != last
            at = np.arange(len(keys))
            start = np.maximum.accumulate(np.where(new, at, -held))
            nth = at - start + 1
            last, held = keys[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nth.astype(np.int64))], [*batch.schema.names, "_nth"]
            )

    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_nth", T.LongType())])
    return sorted_rows.mapInArrow(run, schema)


def last_pages(
    pages: DataFrame, thread: str, page_no: str, small: bool | None = None
) -> DataFrame:
    """Only each thread's highest-numbered page. The maximum is combined map-side; where the
    list of maxima is small it prunes by broadcast before anything is parsed or shuffled.

    A null thread is a thread like any other. Rows without a page number belong to no page: see
    `unnumbered_pages`. A thread has one maximum, so the join adds no rows and a thread with many
    rows can be split between tasks at run time.
    """
    newest = pages.where(F.col(page_no).isNotNull()).groupBy(F.col(thread).alias("_thread")).agg(
        F.max(page_no).alias("_last")
    )
    small = small is not False and fits(newest)
    same = F.col(thread).eqNullSafe(F.col("_thread")) & (F.col(page_no) == F.col("_last"))
    return pages.join(F.broadcast(newest) if small else newest, same, "left_semi")


def unnumbered_pages(pages: DataFrame, page_no: str) -> DataFrame:
    """The rows that `last_pages` can place on no page, with a reason."""
    return pages.where(F.col(page_no).isNull()).withColumn("reason", F.lit("no page number"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, sources)


def union_listings(listings: dict[str, DataFrame]) -> DataFrame:
    """Today's and yesterday's threads in one table, labelled, none dropped."""
    return union_sources([df.withColumn("listing", F.lit(k)) for k, df in listings.items()])


def union_schemas(posts: DataFrame, older: DataFrame) -> DataFrame:
    """Canonical and legacy rows together; what legacy rows lack is null."""
    return posts.unionByName(older, allowMissingColumns=True)


def threads_per_source(threads: DataFrame) -> DataFrame:
    return threads.groupBy("source").agg(F.count("*").alias("threads"))


def posts_per_thread(posts: DataFrame, thread: str = "thread_url") -> DataFrame:
    return posts.groupBy(thread).agg(F.count("*").alias("posts"))


def run_metrics(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """Rows per outcome or reason."""
    return outcomes.groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("rows"))


REASONS = ["unreadable", "no title", "no posts", "no date", "no body"]


def outcome_counts() -> dict[str, Column]:
    """Aggregates over `page_outcomes`: good posts, and rows of each reason."""
    counts = {"kept": F.count_if(F.col("reason").isNull())}
    return counts | {r.replace(" ", "_"): F.count_if(F.col("reason") == r) for r in REASONS}


def observed(posts: DataFrame, observation) -> DataFrame:
    """The same rows; when they are written, the observation holds kept and rejected counts."""
    return posts.observe(
        observation,
        F.count_if(reject_reason().isNull()).alias("kept"),
        F.count_if(reject_reason() == "no date").alias("no_date"),
        F.count_if(reject_reason() == "no body").alias("no_body"),
    )
