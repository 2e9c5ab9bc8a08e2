"""Forum sites made by Spark from the conversations table: a conversation is a thread, a turn
a post, three turns a page. The extraction queries read these pages as a crawl."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.pages import dealt

POSTS_PER_PAGE = 3
THREADS_PER_LISTING = 50
HOST = "https://forum.example"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return dealt(table(spark, sf, name))


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def _thread_address(conv: Column) -> Column:
    return F.concat(F.lit(f"{HOST}/t"), conv.cast("string"))


def _join(parts: list) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _post(site: str) -> Column:
    role, turn, body = F.col("role"), F.col("turn").cast("string"), _escaped(F.col("text"))
    date = _join([role, " <i>#", turn, "</i>"])
    dated = role != "system"
    if site == "site1":
        return _join(
            [
                '<div class="bn_thread-comment__container x"><div>',
                F.when(dated, _join(['<span class="bn_thread-comment__date">', date, "</span>"]))
                .otherwise('<span class="bn_thread-comment__date_missing"></span>'),
                '</div><div class="bn_thread-comment__body"><p>', body, "</p></div></div>",
            ]
        )
    if site == "site2":
        return _join(
            [
                '<div class="post-heading">', date, "</div>",
                '<div class="a post_message b">', body, "<!-- end --></div>",
                '<div class="post_message_x">signature</div>',
            ]
        )
    return _join(
        [
            F.when(dated, _join(['<p class="text-regular-m">', date, "</p>"])).otherwise(""),
            '<section class="post-body">', body, "</section>",
        ]
    )


def pages(spark: SparkSession, sf: str, site: str) -> DataFrame:
    """(url, html) of every thread page. Site 1 pages of threads of four turns have no title."""
    turns = table(spark, sf, "conversations")
    per_page = POSTS_PER_PAGE if site == "site2" else 1 << 30
    counts = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).withColumn(
        "n_pages", F.floor(F.col("last") / per_page) + 1
    )
    made = (
        turns.withColumns(
            {"page_no": F.floor(F.col("turn") / per_page) + 1, "post": _post(site)}
        )
        .groupBy("conv_id", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "post"))).alias("posts"))
        .join(counts, "conv_id")
    )
    body = F.array_join(F.transform("posts", lambda p: p["post"]), "\n")
    head = {
        "site1": F.when(F.col("last") == 3, "").otherwise(
            _join(
                [
                    '<h1 class="bn_thread-body__title"> Thread <b>',
                    F.col("conv_id").cast("string"), "</b> </h1>",
                ]
            )
        ),
        "site2": _join(
            [
                '<span class="x-select2-selection__placeholder-y">Sidan ',
                F.col("page_no").cast("string"), " av ", F.col("n_pages").cast("string"), "</span>",
            ]
        ),
        "site3": F.lit(""),
    }[site]
    address = _thread_address(F.col("conv_id"))
    return made.select(
        F.when(F.col("page_no") == 1, address)
        .otherwise(F.concat(address, F.lit("p"), F.col("page_no").cast("string")))
        .alias("url"),
        _join(["<html><body><style>p{}</style>", head, body, "</body></html>"]).alias("html"),
    )


def listings(spark: SparkSession, sf: str, site: str) -> DataFrame:
    """(url, html) of listing pages, fifty threads each, in the order of conv_id. Of site 1,
    threads of three turns are linked without an address, and threads of five turns point to a page
    that is not there."""
    threads = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    number = F.col("conv_id").cast("string")
    path = F.concat(F.lit("/t"), number, F.when(F.col("last") == 4, "gone").otherwise(""))
    link = {
        "site1": F.when(F.col("last") == 2, '<a class="x bn_thread__link">none</a>').otherwise(
            _join(['<a class="x bn_thread__link" href="', path, '">', number, "</a>"])
        ),
        "site2": _join(
            ['<a id="thread_title_', number, '" href="/t', number, '"> Thread\n ', number, "</a>",
             '<a id="other_', number, '" href="/x">x</a>']
        ),
        "site3": _join(
            ['<a class="y-text-surface-strong-z" href="', HOST, "/t", number, '">Thread ', number, "</a>"]
        ),
        "cells": _join(
            ['<tr><td class="td_title"><a>no</a><a href="/t', number, '">Thread ', number, "</a>",
             '<a href="/second">2</a></td><td><a href="/other">o</a></td></tr>']
        ),
    }[site]
    per_page = F.floor(F.col("conv_id") / THREADS_PER_LISTING)
    made = threads.groupBy(per_page.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("conv_id", link.alias("link")))).alias("links")
    )
    return made.select(
        F.concat(F.lit(f"{HOST}/list?b="), F.col("block").cast("string")).alias("url"),
        _join(
            ["<html><body>", F.array_join(F.transform("links", lambda x: x["link"]), "\n"), "</body></html>"]
        ).alias("html"),
    )
