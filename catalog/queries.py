"""One query per operator, each over whole tables of a data directory."""

import unicodedata
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import forum, vocabulary
from catalog.forum import dealt_table, table
from postloom.functions import encoding, select
from postloom.functions.html import parse_html
from postloom.functions.select import Selector
from postloom.functions.text import absolute_url, is_blank, last_page_url, page_count, strip, words
from postloom.operators import extract, posts, sentiment, translate
from postloom.operators.joins import spread_join
from postloom.operators.memory import Memory, translate_by_memory
from postloom.operators.models import logits_udf, margin_2class, margin_3class, model_score
from postloom.operators.tokens import token_hits
from postloom.operators.udfs import lateral_rows, map_column, rows_to_many
from postloom.plans.pipeline import (
    all_posts,
    enrich,
    extract_each,
    extract_source,
    run_counts,
)
from postloom.schemas import CSV_HEADERS, LEGACY_CSV_HEADERS, LEGACY_POSTS, PAGES, POSTS, SCORED_POSTS
from postloom.sites import SITE_1, SITE_2, SITE_3
from postloom.sources import pages as page_source
from postloom.sources.posts_csv import (
    DIALECT,
    read_posts,
    rejected_posts,
    write_ordered,
    write_posts,
    write_snapshot,
)
from postloom.sources.scratch import new_path, stage
from postloom.sources.tables import VersionedTable, append_each, append_sources
from postloom.streaming.incremental import append_counted, append_new, enrich_new, new_files
from postloom.streaming.threads import last_page_extracts, last_page_outcomes, titled_pages

SITES = {"site1": SITE_1, "site2": SITE_2, "site3": SITE_3}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def conversation_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as canonical posts, with their thread."""
    return dealt_table(spark, sf, "conversations").select(
        (F.col("turn") + 1).cast("int").alias("post_index"),
        F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("thread_title"),
        F.col("role").alias("post_date"),
        F.col("text").alias("post_content"),
        F.lit(forum.HOST).alias("source_url"),
        F.col("conv_id"),
        F.col("turn"),
    )


def site_extraction(spark, sf, name, **options):
    return extract_source(
        forum.listings(spark, sf, name), forum.pages(spark, sf, name), SITES[name], **options
    )


# Sources, sinks and text helpers


@query
def page_scan(spark, sf):
    pages = page_source.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"))


@query
def encoded_pages(spark, sf):
    """Pages as bytes in five ways: UTF-8 and windows-1252 as declared, windows-1252 declared as
    latin-1, UTF-16 by its mark, UTF-8 without a word."""
    pages = dealt_table(spark, sf, "pages")
    kind = F.pmod("page_id", F.lit(5))
    western = F.regexp_replace("html", r"[^\x00-\x7f\xa0-\xff\u2013\u20ac]", "?")
    html = F.concat(
        F.when(kind == 0, '<meta charset="utf-8">')
        .when(kind == 2, "<!-- charset=utf-8 --><META http-equiv=x content='text/html; charset=Windows-1252'>")
        .when(kind == 3, "<meta name=a><meta charset=iso-8859-1>")
        .otherwise(""),
        F.when(kind.isin(2, 3), western).otherwise(F.col("html")),
        F.lit("<p>åäö – €</p>"),
    )
    one_byte = F.encode(F.translate(html, encoding.LETTERS, encoding.CONTROLS), "ISO-8859-1")
    content = (
        F.when(kind.isin(2, 3), one_byte)
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
        .otherwise(F.encode(html, "UTF-8"))
    )
    crawled = stage(pages.select("page_id", content.alias("content")), "crawled")
    read = page_source.decode_pages(crawled)
    return read.select("page_id", "encoding", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"))


@query
def csv_roundtrip(spark, sf):
    path = new_path(spark, "csv")
    write_posts(posts.canonical(conversation_posts(spark, sf)), path)
    return read_posts(spark, path, POSTS)


@query
def csv_short_rows(spark, sf):
    path = new_path(spark, "csv")
    write_posts(posts.canonical(conversation_posts(spark, sf)), path)
    return read_posts(spark, path, SCORED_POSTS)


@query
def ordered_export(spark, sf):
    """Each row's place as the files give it, in the order of their names."""
    path = new_path(spark, "csv")
    rows = posts.canonical(conversation_posts(spark, sf))
    write_ordered(rows, path, ["source_url", "thread_title", "post_index"], rows_per_file=50)
    read = spark.read.options(**DIALECT).csv(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")
    )
    within = F.row_number().over(Window.partitionBy("file").orderBy("row"))
    files = read.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("Index") == "1").alias("firsts"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), (F.col("n") <= 50).alias("bounded"))
    return read.withColumn("at", within).join(starts, "file").select(
        F.col("Thread Title").alias("thread_title"),
        F.col("Index").cast("int").alias("post_index"),
        (F.col("start") + F.col("at")).alias("place"),
        "bounded",
    )


@query
def post_index_ties(spark, sf):
    """Posts by their length and not by their turn: many positions are equal, and some far apart."""
    rows = table(spark, sf, "conversations").select(
        F.col("role").alias("thread"), (F.length("text") * F.length("text")).alias("position"), "conv_id", "turn"
    )
    found = posts.number_rows(rows, "thread", "position", block=100)
    return found.groupBy("thread", "position").agg(
        F.min("post_index").alias("first"), F.max("post_index").alias("last"), F.countDistinct("post_index").alias("n")
    )


@query
def csv_five_of_seven(spark, sf):
    """Files with a header of seven columns, to which rows of five fields were appended."""
    rows = posts.canonical(conversation_posts(spark, sf)).withColumn("file", F.pmod(F.xxhash64("thread_title"), F.lit(4)))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    five = F.concat_ws(",", "post_index", *[quoted(F.col(c)) for c in posts.CANONICAL[1:]])
    seven = F.concat_ws(",", five, quoted(F.concat(F.lit("t "), "post_content")), F.col("post_index") / 4)
    lines = rows.select("file", F.when(F.col("post_date") == "user", five).otherwise(seven).alias("value"))
    header = ",".join(CSV_HEADERS[c] for c in SCORED_POSTS.names)
    heads = rows.select("file").distinct().select("file", F.lit(header).alias("value"))
    first = (F.col("value") != header).cast("int").alias("later")
    lines = heads.unionByName(lines).select("file", first, "value")
    path = new_path(spark, "csv")
    lines = lines.repartition("file").sortWithinPartitions("file", "later").drop("later")
    lines.write.partitionBy("file").text(path)
    return read_posts(spark, f"{path}/file=*", SCORED_POSTS)


@query
def csv_reordered(spark, sf):
    """The file's columns stand in another order, with one that is not asked for."""
    path = new_path(spark, "csv")
    rows = posts.canonical(conversation_posts(spark, sf)).withColumn("sentiment_score", F.lit(0.5))
    write_posts(rows.select(*reversed(rows.columns)), path)
    return read_posts(spark, path, POSTS)


@query
def csv_rejects(spark, sf):
    """Rows of the system role have an index that is no number."""
    path = new_path(spark, "csv")
    rows = posts.canonical(conversation_posts(spark, sf))
    index = F.concat(F.when(F.col("post_date") == "system", "x").otherwise(""), F.col("post_index"))
    write_posts(rows.withColumn("post_index", index), path)
    good = read_posts(spark, path, POSTS).groupBy("post_date").agg(F.count("*").alias("rows"))
    aside = rejected_posts(spark, path, POSTS).groupBy("reason").agg(F.count("*").alias("rows"))
    return good.select(F.col("post_date").alias("reason"), "rows").unionByName(aside)


@query
def na_tokens(spark, sf):
    path = new_path(spark, "csv")
    rows = posts.canonical(conversation_posts(spark, sf))
    missing = F.when(F.col("post_date") == "system", "NA").when(
        F.col("post_date") == "assistant", "none"
    )
    write_posts(rows.withColumn("thread_title", F.coalesce(missing, "thread_title")), path)
    return read_posts(spark, path, POSTS, na_as_null=True)


@query
def strip_text(spark, sf):
    padded = F.concat(F.lit("\t  \x1c"), F.col("text"), F.lit(" \n　"))
    return table(spark, sf, "documents").select("doc_id", strip(padded).alias("stripped"))


@query
def blank_guard(spark, sf):
    text = F.when(F.col("lang") == "de", F.lit(None)).when(F.col("lang") == "es", " \t\n")
    text = F.when(F.col("lang").isin("de", "es"), text).otherwise(F.col("text"))
    return (
        table(spark, sf, "documents")
        .groupBy("lang")
        .agg(F.count_if(is_blank(text)).alias("blank"), F.count("*").alias("docs"))
    )


@query
def blank_guard_whole(spark, sf):
    """Every document's own text, and beside it copies that are null, empty and all blanks."""
    docs = table(spark, sf, "documents")
    kinds = {"own": F.col("text"), "null": F.lit(None).cast("string"), "empty": F.lit(""), "blanks": F.lit(" \t\u3000\n")}
    rows = posts.union_sources([docs.select("lang", F.lit(k).alias("kind"), t.alias("t")) for k, t in kinds.items()])
    return rows.groupBy("lang", "kind").agg(F.count_if(is_blank(F.col("t"))).alias("blank"), F.count("*").alias("docs"))


@query
def canonical_to_legacy(spark, sf):
    return posts.legacy(conversation_posts(spark, sf))


@query
def legacy_to_canonical(spark, sf):
    path = new_path(spark, "legacy-csv")
    write_posts(posts.legacy(conversation_posts(spark, sf)), path, LEGACY_CSV_HEADERS)
    older = read_posts(spark, path, LEGACY_POSTS, LEGACY_CSV_HEADERS)
    return posts.from_legacy(older, forum.HOST)


@query
def snapshot_export(spark, sf):
    at = datetime(2024, 9, 18, 11, 15, 12)
    prefix = new_path(spark, "posts")
    path = write_snapshot(posts.canonical(conversation_posts(spark, sf)), prefix, at)
    return read_posts(spark, path, POSTS).withColumn("stamp", F.lit(path[-15:]))


@query
def replace_table(spark, sf):
    kept = VersionedTable(spark, new_path(spark, "table"))
    kept.replace(posts.canonical(conversation_posts(spark, sf)))
    kept.replace(kept.read().withColumn("n_chars", F.length("post_content")))
    return kept.read()


@query
def append_source_tables(spark, sf):
    path = new_path(spark, "appended")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = {lang: docs.where(F.col("lang") == lang).drop("source") for lang in vocabulary.LANGS}
    append_sources(rows, path)
    append_sources({"en": rows["en"]}, path)
    return spark.read.parquet(path).groupBy("source", "lang").agg(F.count("*").alias("rows"))


@query
def append_isolated_sources(spark, sf):
    path = new_path(spark, "appended")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    outcome = append_each(
        {
            "fr": lambda: docs.where("lang = 'fr'"),
            "gone": lambda: spark.read.parquet(f"{path}-not-there"),
            "en": lambda: docs.where("lang = 'en'"),
            "de": lambda: docs.where("lang = 'de'"),
            "es": lambda: docs.where("lang = 'es'"),
        },
        path,
    )
    failed = sorted(name for name, error in outcome.items() if error)
    return (
        spark.read.parquet(path)
        .groupBy("source")
        .agg(F.count("*").alias("rows"))
        .withColumn("failed", F.lit(",".join(failed)))
    )


# Elements of pages


@query
def page_outline(spark, sf):
    page = dealt_table(spark, sf, "pages").select("page_id", parse_html("html").alias("page"))
    count = lambda tag: F.size(F.filter("page.nodes", lambda n: n["tag"] == tag))
    return page.select(
        "page_id", count("p").alias("n_p"), count("a").alias("n_a"), count("br").alias("n_br")
    )


@query
def page_links(spark, sf):
    links = extract.elements(dealt_table(spark, sf, "pages"), Selector(tag="a"))
    return links.select("page_id", "pos", "href", "text")


@query
def link_by_href_prefix(spark, sf):
    found = extract.elements(dealt_table(spark, sf, "pages"), Selector(tag="a", href_prefix="/th"))
    return found.select("page_id", "pos", "href")


@query
def links_by_id_prefix(spark, sf):
    found = extract.elements(
        forum.listings(spark, sf, "site2"), SITE_2.links, text_inline=select.text_inline
    )
    return found.select(F.col("url").alias("listing_url"), "pos", "href", "text_inline")


@query
def elements_by_tag_and_class(spark, sf):
    found = extract.elements(dealt_table(spark, sf, "pages"), Selector(tag="div", cls="ad"))
    return found.select("page_id", "pos", F.col("text").alias("text_joined"))


@query
def elements_by_class(spark, sf):
    found = extract.elements(forum.pages(spark, sf, "site2"), Selector(cls="post_message"))
    return found.groupBy("url").agg(F.count("*").alias("items"))


@query
def elements_by_class_contains(spark, sf):
    found = extract.elements(
        forum.pages(spark, sf, "site2"), Selector(cls_contains="post_message")
    )
    return found.groupBy("url").agg(F.count("*").alias("items"))


@query
def first_title(spark, sf):
    return extract.first_text(dealt_table(spark, sf, "pages"), Selector(tag="h1")).select(
        "page_id", "title"
    )


@query
def scoped_first_child(spark, sf):
    found = extract.child_elements(
        dealt_table(spark, sf, "pages"), Selector(tag="li"), Selector(tag="a", has_href=True)
    )
    return found.select("page_id", "pos", "href", "text_joined")


@query
def cell_links(spark, sf):
    return extract.cell_links(forum.listings(spark, sf, "cells")).select("url", "thread_url")


@query
def absolute_urls(spark, sf):
    links = extract.elements(dealt_table(spark, sf, "pages"), Selector(tag="a"))
    return links.select(
        "page_id", "pos", absolute_url(F.col("href"), F.col("url")).alias("address")
    )


@query
def relative_addresses(spark, sf):
    """Each page's address met with a link of every relative kind."""
    kinds = ["?b=2", "./x", "../x", " /x\n", "a/../b/./c?d=../e", "../../../y/..", "#t", "//h.example/../p"]
    links = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("href")) for i, k in enumerate(kinds)])
    found = table(spark, sf, "pages").select("page_id", "url", F.inline(links))
    return found.select("page_id", "pos", absolute_url(F.col("href"), F.col("url")).alias("address"))


@query
def text_joined(spark, sf):
    found = extract.elements(
        dealt_table(spark, sf, "pages"), Selector(tag="article"), text_joined=select.text_joined
    )
    return found.select("page_id", "text_joined")


@query
def text_fused(spark, sf):
    found = extract.elements(
        dealt_table(spark, sf, "pages"), Selector(tag="article"), text_fused=select.text_fused
    )
    return found.select("page_id", "text_fused")


@query
def zip_truncate(spark, sf):
    found = extract.paired_elements(
        dealt_table(spark, sf, "pages"), Selector(tag="li"), Selector(tag="p")
    )
    return found.select("page_id", "pos", "left_text")


@query
def zip_pairs(spark, sf):
    """Both halves of each pair: advertisements and links by position, up to the shorter list."""
    found = extract.paired_elements(
        dealt_table(spark, sf, "pages"), Selector(tag="div", cls="ad"), Selector(tag="a")
    )
    return found.select("page_id", "pos", "left_text", "right_text")


# Posts


@query
def post_index(spark, sf):
    rows = table(spark, sf, "conversations")
    return posts.number_rows(rows, "conv_id", "turn", block=2).select(
        "conv_id", "turn", "post_index"
    )


@query
def posts_canonical(spark, sf):
    return posts.canonical(conversation_posts(spark, sf))


@query
def page_count_default(spark, sf):
    label = F.regexp_replace("url", r"^.*[?&]page=(\d+).*$", "Sidan 1 av $1")
    return table(spark, sf, "pages").select("page_id", page_count(label).alias("pages"))


@query
def last_page_address(spark, sf):
    label = F.regexp_replace("url", r"^.*[?&]page=(\d+).*$", "Sidan 1 av $1")
    return table(spark, sf, "pages").select(
        "page_id", last_page_url(F.col("url"), page_count(label)).alias("address")
    )


@query
def last_page_only(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "page_no", F.floor(F.col("turn") / forum.POSTS_PER_PAGE)
    )
    return posts.last_pages(rows, "conv_id", "page_no").select("conv_id", "page_no", "turn")


@query
def last_page_only_joined(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "page_no", F.floor(F.col("turn") / forum.POSTS_PER_PAGE)
    )
    found = posts.last_pages(rows, "conv_id", "page_no", small=False)
    return found.select("conv_id", "page_no", "turn")


@query
def drop_empty_links(spark, sf):
    links = extract.listing_links(forum.listings(spark, sf, "site1"), SITE_1)
    return extract.has_address(links).select("listing_url", "thread_pos", "thread_url")


@query
def empty_link_counts(spark, sf):
    links = extract.listing_links(forum.listings(spark, sf, "site1"), SITE_1)
    return (
        extract.lacks_address(links).groupBy("listing_url").agg(F.count("*").alias("dropped"))
    )


@query
def thread_outcomes(spark, sf):
    return site_extraction(spark, sf, "site1").threads.select("thread_url", "outcome")


def _spoiled_pages(spark, sf):
    """Site 1's pages; of those of numbers that leave 1 (by 5) the html breaks off in a way no
    parser follows, and those that leave 2 have a title and nothing else."""
    number = F.regexp_extract("url", r"/t(\d+)$", 1)
    bare = F.concat(
        F.lit('<h1 class="bn_thread-body__title">Thread '), number, F.lit("</h1>")
    )
    kind = number.cast("long") % 5
    return forum.pages(spark, sf, "site1").withColumn(
        "html",
        F.when(kind == 1, F.concat("html", F.lit("<![bar x]>"))).when(kind == 2, bare).otherwise(F.col("html")),
    )


@query
def unreadable_pages(spark, sf):
    """All five outcomes of threads."""
    found = extract_source(forum.listings(spark, sf, "site1"), _spoiled_pages(spark, sf), SITE_1)
    return found.threads.select("thread_url", "outcome")


@query
def unreadable_listings(spark, sf):
    """Every second listing page is unreadable."""
    odd = F.regexp_extract("url", r"b=(\d+)$", 1).cast("long") % 2 == 1
    pages = forum.listings(spark, sf, "site1").withColumn(
        "html", F.when(odd, F.concat("html", F.lit("<![bar x]>"))).otherwise(F.col("html"))
    )
    return extract.listing_outcomes(extract.read_listings(pages, SITE_1))


@query
def recrawled_pages(spark, sf):
    """Every page is there twice, and so are its posts."""
    pages = forum.pages(spark, sf, "site3")
    found = extract_source(forum.listings(spark, sf, "site3"), pages.unionByName(pages), SITE_3)
    return found.posts.select("thread_url", *posts.CANONICAL)


@query
def recrawled_newest(spark, sf):
    """Every page was crawled before, with other text and no time; the newest copy counts."""
    pages = forum.pages(spark, sf, "site3").withColumn("crawl", F.lit(2))
    older = pages.withColumns(
        {"html": F.replace("html", F.lit("post-body"), F.lit("gone")), "crawl": F.lit(None).cast("int")}
    )
    found = extract_source(
        forum.listings(spark, sf, "site3"), older.unionByName(pages), SITE_3, order_by="crawl"
    )
    kept = posts.posts_per_thread(found.posts).withColumn("reason", F.lit("kept"))
    aside = found.superseded.select(F.col("url").alias("thread_url"), F.col("copies").alias("posts"), "reason")
    return kept.unionByName(aside)


@query
def run_metrics_all(spark, sf):
    """Counts of every stage, with one source that fails and stops no other."""

    def broken():
        raise OSError("no such site")

    jobs = {name: lambda name=name: site_extraction(spark, sf, name) for name in SITES}
    done, failed = extract_each({**jobs, "gone": broken})
    rows = all_posts(list(done.values()))
    texts = enrich(
        rows, vocabulary.lexicon(spark), make_backend=lambda: _demo_backend(), rules=vocabulary.RULES
    )
    counts = run_counts(done, texts)
    lost = [(name, str(error)) for name, error in failed.items()]
    aside = spark.createDataFrame(lost, "source string, reason string").selectExpr(
        "'source' as stage", "source", "reason", "1L as rows"
    )
    return counts.unionByName(aside)


@query
def run_metrics(spark, sf):
    return posts.run_metrics(site_extraction(spark, sf, "site1").threads)


@query
def site_child_posts(spark, sf):
    rows = site_extraction(spark, sf, "site1").posts
    return rows.select("thread_url", *posts.CANONICAL)


@query
def reject_incomplete(spark, sf):
    return site_extraction(spark, sf, "site1").rejects.select("thread_url", "post_index", "reason")


@query
def reject_no_body(spark, sf):
    """Site 1 with no bodies in threads whose number leaves 1 (by 3)."""
    number = F.regexp_extract("url", r"/t(\d+)$", 1).cast("long")
    bare = F.replace("html", F.lit("bn_thread-comment__body"), F.lit("gone"))
    pages = forum.pages(spark, sf, "site1").withColumn(
        "html", F.when(number % 3 == 1, bare).otherwise(F.col("html"))
    )
    found = extract_source(forum.listings(spark, sf, "site1"), pages, SITE_1)
    return found.rejects.select("thread_url", "post_index", "reason")


@query
def site_last_page_posts(spark, sf):
    rows = site_extraction(spark, sf, "site2").posts
    return rows.select("thread_url", "last_page_url", *posts.CANONICAL)


@query
def site_zip_posts(spark, sf):
    return site_extraction(spark, sf, "site3").posts.select("thread_url", *posts.CANONICAL)


@query
def listing_join_pages(spark, sf):
    """Every listing row keeps its page's posts, with hot threads spread over tasks."""
    threads = extract.has_address(
        extract.listing_links(forum.listings(spark, sf, "site3"), SITE_3)
    )
    pages = extract.read_threads(forum.pages(spark, sf, "site3"), SITE_3)
    twice = threads.unionByName(threads)
    joined = posts.thread_pages(twice, pages, SITE_3, rows_per_task=1)
    return posts.posts_per_thread(posts.explode_posts(joined))


@query
def union_source_posts(spark, sf):
    return all_posts([site_extraction(spark, sf, name) for name in SITES])


@query
def union_listings(spark, sf):
    listed = extract.listing_links(forum.listings(spark, sf, "site1"), SITE_1)
    threads = posts.union_listings({"today": listed, "yesterday": extract.has_address(listed)})
    return threads.select("listing", "listing_url", "thread_pos", "thread_url")


@query
def union_schemas(spark, sf):
    rows = conversation_posts(spark, sf)
    return posts.union_schemas(posts.canonical(rows), posts.legacy(rows))


@query
def threads_per_source(spark, sf):
    found = [site_extraction(spark, sf, name).threads.select("source") for name in SITES]
    return posts.threads_per_source(posts.union_sources(found))


@query
def posts_per_thread(spark, sf):
    return posts.posts_per_thread(table(spark, sf, "conversations"), "conv_id")


@query
def posts_per_page(spark, sf):
    pages = extract.read_threads(forum.pages(spark, sf, "site3"), SITE_3)
    return pages.select("url", "n_items", "n_dates", F.size("posts").alias("paired"))


@query
def rows_to_many_posts(spark, sf):
    def lines(row):
        return [
            {"conv_id": row["conv_id"], "turn": row["turn"], "line": i, "line_chars": len(text)}
            for i, text in enumerate(row["text"].split("\n"), start=1)
        ]

    schema = "conv_id long, turn long, line long, line_chars long"
    return rows_to_many(table(spark, sf, "conversations"), lines, schema)


class _Wrap:
    """Puts words on lines of at most 40 characters, as many as fit; a longer word has its own."""

    def eval(self, text: str):
        line, used, first = 1, 0, 0
        parts = [w for w in (text or "").replace("\n", " ").split(" ") if w]
        for i, word in enumerate(parts):
            if used and used + 1 + len(word) > 40:
                yield line, i - first, used
                line, used, first = line + 1, 0, i
            used += len(word) + (1 if used else 0)
        if parts:
            yield line, len(parts) - first, used


@query
def wrapped_lines(spark, sf):
    """Each post as lines of a display, by a table function with state along the post."""
    rows = dealt_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    found = lateral_rows(rows, _Wrap, "line int, n_words int, n_chars int", "text")
    return found.drop("text")


@query
def map_column_lengths(spark, sf):
    return dealt_table(spark, sf, "documents").select(
        "doc_id", map_column(F.col("text"), lambda s: s.str.len(), "long").alias("n")
    )


@query
def map_column_nfd(spark, sf):
    """Unicode normalisation, which no built-in function offers: composed and taken apart."""

    def marks(texts):
        return texts.map(lambda t: len(unicodedata.normalize("NFD", t)))

    return dealt_table(spark, sf, "documents").select(
        "doc_id", map_column(F.col("text"), marks, "long").alias("n")
    )


# Translation


def _memory(spark, sf):
    return (
        dealt_table(spark, sf, "documents")
        .where(F.col("lang").isin("fr", "de"))
        .select(
            F.col("text").alias("source_text"),
            F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("text")).alias("target_text"),
        )
    )


@query
def translate_memory(spark, sf):
    docs = table(spark, sf, "documents").drop("n_chars")
    found = translate.translate(docs, _memory(spark, sf), "text")
    return found.select("doc_id", translate.TRANSLATED, "via")


@query
def translate_memory_joined(spark, sf):
    docs = table(spark, sf, "documents").drop("n_chars")
    found = translate.translate(docs, _memory(spark, sf), "text", small=False)
    return found.select("doc_id", translate.TRANSLATED, "via")


def _demo_backend():
    """Stands in for a translation service: marks a text, and refuses some."""

    def run(texts):
        if any("ß" in t for t in texts):
            raise ValueError("refused")
        return ["[en] " + t for t in texts]

    return run


@query
def translate_backend(spark, sf):
    memory = _memory(spark, sf).where(F.col("target_text").startswith("[fr]"))
    docs = dealt_table(spark, sf, "documents").drop("n_chars")
    found = translate.translate(docs, memory, "text", make_backend=lambda: _demo_backend())
    return found.select("doc_id", translate.TRANSLATED, "via")


@query
def memory_two_runs(spark, sf):
    """French documents first, then all: the second run asks for what is new alone, and a third,
    whose backend says otherwise, for nothing but what was refused."""
    docs = dealt_table(spark, sf, "documents").drop("n_chars")
    path = new_path(spark, "memory")
    first = Memory(spark, path, 8)
    before = translate_by_memory(docs.where("lang = 'fr'"), first, "text", make_backend=_demo_backend)
    later = translate_by_memory(docs, Memory(spark, path, 8), "text", make_backend=_demo_backend)
    other = lambda: lambda texts: ["[other] " + t for t in texts if "ß" in t or 1 / 0]
    last = translate_by_memory(docs.where("text not like '%ß%'"), first, "text", make_backend=other)
    runs = [("first", before), ("later", later), ("last", last)]
    parts = [d.select("doc_id", F.lit(n).alias("run"), translate.TRANSLATED, "via") for n, d in runs]
    return posts.union_sources(parts)


@query
def translation_dictionary(spark, sf):
    docs = table(spark, sf, "documents")
    return translate.dictionary(docs, _memory(spark, sf), "text")


@query
def translate_glossary(spark, sf):
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = translate.glossary_translate(docs, vocabulary.glossary(spark), "text")
    return found.select("doc_id", translate.TRANSLATED)


@query
def translate_glossary_joined(spark, sf):
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = translate.glossary_translate(docs, vocabulary.glossary(spark), "text", inline=False)
    return found.select("doc_id", translate.TRANSLATED)


# Sentiment


@query
def lexicon_join(spark, sf):
    docs = dealt_table(spark, sf, "documents").select(
        "doc_id", F.transform(words(F.col("text")), F.lower).alias("tokens")
    )
    return token_hits(docs, "tokens", vocabulary.lexicon(spark), "token", "valence")


@query
def lexicon_join_spread(spark, sf):
    docs = dealt_table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.transform(words(F.col("text")), F.lower)).alias("pos", "token")
    )
    found = spread_join(docs, vocabulary.lexicon(spark), "token", "inner", rows_per_task=500)
    return found.select("doc_id", "pos", "token", "valence")


@query
def lexicon_join_filtered(spark, sf):
    """A table that is not broadcast: tokens that its filter rules out are not shuffled."""
    docs = dealt_table(spark, sf, "documents").select(
        "doc_id", F.transform(words(F.col("text")), F.lower).alias("tokens")
    )
    return token_hits(docs, "tokens", vocabulary.lexicon(spark), "token", "valence", small=False)


@query
def lexicon_score(spark, sf):
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = sentiment.lexicon_sum(docs, vocabulary.lexicon(spark), "text")
    return found.select("doc_id", "sentiment_score")


@query
def compound_score(spark, sf):
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = sentiment.score(docs, vocabulary.lexicon(spark), "text", rules=vocabulary.RULES)
    return found.select("doc_id", "sentiment_score")


@query
def compound_score_joined(spark, sf):
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = sentiment.score(
        docs, vocabulary.lexicon(spark), "text", rules=vocabulary.RULES, inline=False
    )
    return found.select("doc_id", "sentiment_score")


@query
def compound_score_default(spark, sf):
    """The word lists that the library brings, over texts in which words of the documents stand for
    words of those lists."""
    docs = dealt_table(spark, sf, "documents").select("doc_id", vocabulary.english(F.col("text")).alias("text"))
    found = sentiment.score(docs, vocabulary.lexicon(spark), "text")
    return found.select("doc_id", "sentiment_score")


@query
def margin_two_classes(spark, sf):
    """All 64 values are classes; 1 against 0."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(margin_2class(F.col("embedding")), 6).alias("margin")
    )


@query
def margin_three_classes(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(margin_3class(logits), 6).alias("margin")
    )


def _demo_model():
    """Stands in for a model load: three logits out of all 64 features."""
    place = np.arange(64)[:, None]
    weights = ((place * 7 + np.arange(3) * 3) % 11 - 5) / 4
    return lambda features: (features.astype(np.float64) @ weights).astype(np.float32)


@query
def batch_model_logits(spark, sf):
    infer = logits_udf(_demo_model, batch_size=128, input_shapes=[[64]])
    scored = table(spark, sf, "embeddings").withColumn("logits", infer("embedding"))
    return scored.select("vec_id", F.round(margin_3class(F.col("logits")), 4).alias("margin"))


def _demo_text_model():
    """Stands in for a text model: a text's length against 600, as two logits."""

    def run(texts):
        size = np.array([len(t) for t in texts], dtype=np.float32) / 600
        return np.stack([np.ones_like(size), size], axis=1)

    return run


@query
def model_text_score(spark, sf):
    turns = table(spark, sf, "conversations").withColumn(
        "said", F.when(F.col("role") == "system", " ").otherwise(F.col("text"))
    )
    found = model_score(turns, _demo_text_model, pos=1, neg=0, text="said")
    return found.select("conv_id", "turn", F.round("sentiment_score", 4).alias("sentiment_score"))


@query
def model_text_score_whole(spark, sf):
    """Every turn's own text, and a blank copy of it."""
    turns = table(spark, sf, "conversations")
    rows = turns.select("conv_id", "turn", F.lit("own").alias("kind"), F.col("text").alias("said")).unionByName(
        turns.select("conv_id", "turn", F.lit("blank").alias("kind"), F.lit("\u2003\n").alias("said"))
    )
    found = model_score(rows, _demo_text_model, pos=1, neg=0, text="said")
    return found.select("conv_id", "turn", "kind", F.round("sentiment_score", 4).alias("sentiment_score"))


# End to end


@query
def scored_posts(spark, sf):
    rows = conversation_posts(spark, sf)
    found = translate.glossary_translate(rows, vocabulary.glossary(spark), "post_content")
    found = sentiment.score(found, vocabulary.lexicon(spark), rules=vocabulary.RULES)
    return found.select("conv_id", "post_index", translate.TRANSLATED, "sentiment_score")


@query
def scored_site_posts(spark, sf):
    rows = all_posts([site_extraction(spark, sf, name) for name in SITES])
    found = translate.glossary_translate(rows, vocabulary.glossary(spark), "post_content")
    return sentiment.score(found, vocabulary.lexicon(spark), rules=vocabulary.RULES)


@query
def enrich_by_backend(spark, sf):
    """A backend without a memory."""
    rows = posts.canonical(conversation_posts(spark, sf))
    found = enrich(
        rows, vocabulary.lexicon(spark), make_backend=lambda: _demo_backend(), rules=vocabulary.RULES
    )
    return found.select("post_index", "thread_title", translate.TRANSLATED, "via")


@query
def enrich_memory_then_glossary(spark, sf):
    """Texts that the memory lacks, token by token, whether or not a token has an entry."""
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    found = translate.translate(docs, _memory(spark, sf), "text", out="remembered")
    found = translate.glossary_translate(found, vocabulary.glossary(spark), "text")
    known = F.col("via") == "memory"
    return found.select(
        "doc_id",
        F.when(known, F.col("remembered")).otherwise(F.col(translate.TRANSLATED)).alias(translate.TRANSLATED),
        known.alias("known"),
    )


@query
def enrich_via(spark, sf):
    """What translated each text, over the documents, copies of which every word lies apart by
    blanks and line breaks, and copies without a word that the glossary knows."""
    docs = dealt_table(spark, sf, "documents").select("doc_id", "text")
    apart = F.regexp_replace("text", r"[ \n]+", "  \n ")
    unknown = F.regexp_replace(apart, r"([^ \n]+)", "x$1")
    docs = docs.select("doc_id", F.lit("as it is").alias("kind"), "text").unionByName(
        docs.select("doc_id", F.lit("apart").alias("kind"), apart.alias("text"))
    ).unionByName(docs.select("doc_id", F.lit("unknown").alias("kind"), unknown.alias("text")))
    found = enrich(
        docs,
        vocabulary.lexicon(spark),
        memory=_memory(spark, sf),
        glossary=vocabulary.glossary(spark),
        rules=vocabulary.RULES,
        text="text",
    )
    return found.select("doc_id", "kind", translate.TRANSLATED, "via")


@query
def page_counts_defaulted(spark, sf):
    """Site 2 with no label on the pages of threads whose number leaves 2 (by 3), so that their
    first page passes for the last; counted apart from real threads of one page."""
    number = F.regexp_extract("url", r"/t(\d+)", 1).cast("long")
    bare = F.regexp_replace("html", r"Sidan \d+ av \d+<", "<")
    pages = forum.pages(spark, sf, "site2").withColumn(
        "html", F.when(number % 3 == 2, bare).otherwise(F.col("html"))
    )
    found = extract_source(forum.listings(spark, sf, "site2"), pages, SITE_2)
    return run_counts({"site2": found}).where("stage in ('page count', 'thread', 'post')")


# Streams


def _split(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.repartition(4).write.parquet(path)
    return path


@query
def incremental_posts(spark, sf):
    folder = _split(dealt_table(spark, sf, "pages"), "arrivals")
    out, log = new_path(spark, "posts"), new_path(spark, "log")
    for _ in range(2):  # the second run finds nothing new
        stream = new_files(spark, folder, PAGES, files_per_batch=1)
        links = extract.elements(stream, Selector(tag="a"))
        append_new(links.select("page_id", "pos", "href"), out, log)
    return spark.read.parquet(out)


@query
def incremental_site_posts(spark, sf):
    """Site pages as a stream of files: the same posts as in one batch."""
    pages = forum.pages(spark, sf, "site1")
    folder = _split(pages, "arrivals")
    out, log = new_path(spark, "posts"), new_path(spark, "log")
    stream = new_files(spark, folder, pages.schema, files_per_batch=1)
    append_new(posts.page_posts(extract.read_threads(stream, SITE_1), SITE_1), out, log)
    return spark.read.parquet(out).drop("source")


def _arriving(spark, sf, name):
    """Everything a stream of a site's pages gives, with titles from the site's listing."""
    pages = forum.pages(spark, sf, name)
    threads = extract.has_address(extract.listing_links(forum.listings(spark, sf, name), SITES[name]))
    stream = new_files(spark, _split(pages, "arrivals"), pages.schema, files_per_batch=2)
    read = extract.read_threads(stream, SITES[name])
    out = new_path(spark, "posts")
    append_new(posts.page_outcomes(read, SITES[name], threads), out, new_path(spark, "log"))
    return spark.read.parquet(out)


@query
def incremental_site2_posts(spark, sf):
    """Every page's posts; which page is a thread's last is for a later batch."""
    rows = _arriving(spark, sf, "site2").where("reason is null")
    return rows.select("url", "thread_url", *posts.CANONICAL)


@query
def incremental_site3_posts(spark, sf):
    rows = _arriving(spark, sf, "site3").where("reason is null")
    return rows.select("thread_url", *posts.CANONICAL)


@query
def incremental_rejects(spark, sf):
    """What a stream of spoiled pages sets aside, and why."""
    pages = _spoiled_pages(spark, sf)
    stream = new_files(spark, _split(pages, "arrivals"), pages.schema, files_per_batch=2)
    out = new_path(spark, "posts")
    rows = posts.page_outcomes(extract.read_threads(stream, SITE_1), SITE_1)
    append_new(rows, out, new_path(spark, "log"))
    return posts.run_metrics(spark.read.parquet(out), "reason")


@query
def incremental_scores(spark, sf):
    rows = table(spark, sf, "conversations")
    folder = _split(rows, "arrivals")
    out, log = new_path(spark, "scores"), new_path(spark, "log")
    lexicon = vocabulary.lexicon(spark)

    def enriched(batch):
        return sentiment.score(batch, lexicon, "text", rules=vocabulary.RULES).drop("text")

    for _ in range(2):  # the second run finds nothing new
        enrich_new(new_files(spark, folder, rows.schema, files_per_batch=1), enriched, out, log)
    return spark.read.parquet(out).drop("stream_id", "batch_id")


def _seen(url, column):
    """Pages of a crawl that took a quarter of an hour, in no order of threads."""
    second = F.pmod(F.xxhash64(url), F.lit(900)).cast("int")
    return F.timestamp_seconds(F.lit(1_700_000_000) + second).alias(column)


def _arrivals(spark, rows, time, lots=3):
    """The rows in files that arrive lot by lot, and a last file a day later, with a row that has
    nothing but its time: a stream's watermark passes what came before only when something
    newer comes."""
    path = new_path(spark, "arrivals")
    lot = F.pmod(F.xxhash64(*rows.columns), F.lit(lots))
    for i in range(lots):
        rows.where(lot == i).repartition(2).write.mode("append").parquet(path)
    beat = spark.sql("select timestamp_seconds(1700000000) + interval 3 days as t")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != time]
    beat.select(*empty, F.col("t").alias(time)).select(rows.columns).write.mode("append").parquet(path)
    return new_files(spark, path, rows.schema, files_per_batch=2).withWatermark(time, "1 hour")


@query
def incremental_last_pages(spark, sf):
    """Site 2's last pages as pages arrive out of order, then their titles from listings that
    arrive as well. Of threads whose number leaves 3 (by 7) the last page never comes."""
    pages = forum.pages(spark, sf, "site2").withColumn("thread", F.regexp_replace("url", r"p\d+$", ""))
    number = F.regexp_extract("thread", r"/t(\d+)$", 1).cast("long")
    label = F.regexp_extract("html", r"Sidan (\d+) av (\d+)<", 1) == F.regexp_extract(
        "html", r"Sidan (\d+) av (\d+)<", 2
    )
    pages = pages.where(~((number % 7 == 3) & label)).select("url", "html", _seen("url", "crawled"))
    # Threads of one page, of which nothing came, are unknown to the stream.
    read = extract.read_threads(_arrivals(spark, pages, "crawled"), SITE_2).where("url is not null or n_items = 0")
    out = new_path(spark, "last-pages")
    append_new(last_page_extracts(read, "crawled"), out, new_path(spark, "log"))
    found = spark.read.parquet(out).where("thread_url is not null")
    titles = extract.has_address(extract.listing_links(forum.listings(spark, sf, "site2"), SITE_2))
    found = found.join(titles.select("thread_url", "thread_title"), "thread_url", "left")
    rows = last_page_outcomes(found, SITE_2)
    return rows.select("thread_url", "last_page", "reason", *posts.CANONICAL)


@query
def incremental_titles(spark, sf):
    """Site 3's pages and listings both as streams: titles come before and after their pages, and
    those of threads whose number leaves 3 (by 7) never."""
    pages = forum.pages(spark, sf, "site3").select("url", "html", _seen("url", "crawled"))
    listed = forum.listings(spark, sf, "site3").select("url", "html", _seen("url", "listed"))
    read = extract.read_threads(_arrivals(spark, pages, "crawled"), SITE_3)
    links = extract.listing_links(_arrivals(spark, listed, "listed"), SITE_3)
    gone = F.regexp_extract("thread_url", r"/t(\d+)$", 1).cast("long") % 7 == 3
    links = extract.has_address(links).where(~gone).select("thread_url", "thread_title", "listed")
    out = new_path(spark, "posts")
    titled = titled_pages(read, links, "crawled", "listed")
    append_new(posts.page_outcomes(titled, SITE_3, need_title=True), out, new_path(spark, "log"))
    return spark.read.parquet(out).drop("source", "url")


@query
def incremental_metrics(spark, sf):
    """The counts of a stream of spoiled pages, taken as it is written, over two runs."""
    pages = _spoiled_pages(spark, sf)
    early = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    folder, out, log = (new_path(spark, n) for n in ("arrivals", "posts", "log"))
    totals = []
    for run, part in enumerate((early, ~early, F.lit(False)), 1):
        pages.where(part).repartition(3).write.mode("append").parquet(folder)
        stream = new_files(spark, folder, pages.schema, files_per_batch=1)
        rows = posts.page_outcomes(extract.read_threads(stream, SITE_1), SITE_1)
        found = append_counted(rows, out, log, posts.outcome_counts(), f"metrics_{new_path(spark, 'q')[-32:]}")
        totals += [(run, k.replace("_", " "), n) for k, n in found.items()]
    counted = spark.createDataFrame(totals, "run int, reason string, rows long")
    written = posts.run_metrics(spark.read.parquet(out), "reason").select(
        F.coalesce("reason", F.lit("kept")).alias("reason"), F.col("rows").alias("written")
    )
    # The third run finds nothing and counts nothing.
    return counted.groupBy("reason").agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("run") == 3, F.col("rows")).otherwise(0)).alias("third")
    ).join(written, "reason", "left")
