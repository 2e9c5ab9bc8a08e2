import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from postloom.operators import extract, posts
from postloom.operators.joins import fits, hot_keys, lookup, spread_join
from postloom.plans.pipeline import all_posts, extract_source
from postloom.sites import SITE_1, SITE_2, SITE_3

HOST = "https://h"


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, url, html) for i, (url, html) in enumerate(rows)], "page_id long, url string, html string"
    )


def site1_item(date, body):
    date = f'<span class="bn_thread-comment__date">{date}</span>' if date else ""
    body = f'<div class="bn_thread-comment__body"><p>{body}</p></div>' if body else ""
    return f'<div class="bn_thread-comment__container">{date}{body}</div>'


SITE_1_LISTING = (
    f"{HOST}/list",
    '<a class="bn_thread__link" href="/1">x</a><a class="bn_thread__link">no</a>'
    '<a class="bn_thread__link" href="/2">x</a><a class="bn_thread__link" href="/3">x</a>'
    '<a class="bn_thread__link" href="/4">x</a><a class="other" href="/5">x</a>',
)
TITLE = '<h1 class="bn_thread-body__title"> The title </h1>'
SITE_1_PAGES = [
    (f"{HOST}/1", TITLE + site1_item("1 maj", "a<br>b") + site1_item(None, "c") + site1_item("2 <b>maj</b>", "d")),
    (f"{HOST}/2", TITLE),
    (f"{HOST}/3", site1_item("1 maj", "a")),
]


def site1(spark, listing=SITE_1_LISTING, **options):
    return extract_source(pages(spark, [listing]), pages(spark, SITE_1_PAGES), SITE_1, **options)


def test_site_1_posts_rejects_and_skips(spark):
    found = site1(spark)
    assert sorted(tuple(r) for r in posts.canonical(found.posts).collect()) == [
        (1, "The title", "1 maj", "a\nb", SITE_1.source_url),
        (3, "The title", "2maj", "d", SITE_1.source_url),
    ]
    assert [(r.post_index, r.reason) for r in found.rejects.collect()] == [(2, "no date")]
    assert {(r.thread_url[-2:], r.outcome) for r in found.threads.collect()} == {
        ("/1", "kept"), ("/2", "no posts"), ("/3", "no title"), ("/4", "no page"),
    }
    listed = extract.listing_links(pages(spark, [SITE_1_LISTING]), SITE_1)
    assert extract.lacks_address(listed).count() == 1
    assert [r.thread_pos for r in extract.has_address(listed).orderBy("thread_pos").collect()] == [
        1, 3, 4, 5,
    ]


def test_a_thread_in_both_listings_is_there_twice(spark):
    listing = pages(spark, [SITE_1_LISTING])
    links = extract.has_address(extract.listing_links(listing, SITE_1))
    threads = posts.union_listings({"today": links, "yesterday": links.where("thread_pos = 1")})
    read = extract.read_threads(pages(spark, SITE_1_PAGES), SITE_1)
    rows = posts.explode_posts(posts.thread_pages(threads, read, SITE_1))
    assert sorted(r.listing for r in posts.complete(rows).collect()) == [
        "today", "today", "yesterday", "yesterday",
    ]


@pytest.mark.parametrize("options", [{}, {"order_by": "page_id"}])
def test_copies_of_a_page_all_count_or_the_newest_does(spark, options):
    crawl = pages(spark, [(f"{HOST}/1", TITLE + site1_item("old", "a"))] + SITE_1_PAGES)
    found = extract_source(pages(spark, [SITE_1_LISTING]), crawl, SITE_1, **options)
    dates = sorted(r.post_date for r in found.posts.collect())
    aside = [(r.url, r.reason, r.copies) for r in found.superseded.collect()]
    if options:
        assert dates == ["1 maj", "2maj"] and aside == [(f"{HOST}/1", "superseded", 1)]
    else:
        assert dates == ["1 maj", "2maj", "old"] and aside == []


def test_a_null_order_erases_no_page(spark):
    crawl = pages(spark, SITE_1_PAGES).withColumn("at", F.lit(None).cast("timestamp"))
    found = extract_source(pages(spark, [SITE_1_LISTING]), crawl, SITE_1, order_by="at")
    assert sorted(r.post_date for r in found.posts.collect()) == ["1 maj", "2maj"]


def test_site_2_takes_the_last_page(spark):
    label = '<span class="a-select2-selection__placeholder">{}</span>'
    post = '<div class="post-heading">{} <i>x</i></div><div class="post_message">{}</div>'
    listing = "".join(f'<a id="thread_title_{i}" href="/t{i}">T {i}</a>' for i in (1, 2, 3, 4))
    crawl = pages(spark, [
        (f"{HOST}/t1", label.format("Sidan 1 av 3") + post.format("d1", "p1")),
        (f"{HOST}/t1p2", label.format("Sidan 2 av 3") + post.format("d2", "p2")),
        (f"{HOST}/t1p3", label.format("Sidan 3 av 3") + post.format("d3", "p3") + post.format("d4", "p4")),
        (f"{HOST}/t2", post.format("d5", "p5")),
        (f"{HOST}/t3", label.format("Sidan 1 av 2") + post.format("d6", "p6")),
        (f"{HOST}/t4", label.format("Sidan 1 av 2")),
        (f"{HOST}/t4p2", post.format("d7", "p7")),
    ])
    found = extract_source(pages(spark, [(f"{HOST}/list", listing)]), crawl, SITE_2)
    assert sorted(tuple(r) for r in posts.canonical(found.posts).collect()) == [
        (1, "T 1", "d3x", "p3", SITE_2.source_url),
        (1, "T 2", "d5x", "p5", SITE_2.source_url),
        (2, "T 1", "d4x", "p4", SITE_2.source_url),
    ]
    got = {r.thread_url[-2:]: (r.outcome, r.last_page_url[len(HOST):]) for r in found.threads.collect()}
    assert got == {
        "t1": ("kept", "/t1p3"), "t2": ("kept", "/t2p1"), "t3": ("no page", "/t3p2"),
        "t4": ("no posts", "/t4p2"),
    }


def test_site_3_pairs_up_to_the_shorter_list(spark):
    listing = f'<a class="x text-surface-strong y" href="{HOST}/t">A <b>thread</b></a>'
    page = (
        '<i class="text-regular-m">3 <b>maj</b></i><div class="post-body">a</div>'
        '<div class="post-body">b</div><i class="text-regular-m">4 maj</i>'
        '<div class="post-body">c</div>'
    )
    crawl = pages(spark, [(f"{HOST}/t", page)])
    found = extract_source(pages(spark, [(f"{HOST}/list", listing)]), crawl, SITE_3)
    assert sorted(tuple(r) for r in posts.canonical(found.posts).collect()) == [
        (1, "A thread", "3 maj", "a", SITE_3.source_url),
        (2, "A thread", "4 maj", "b", SITE_3.source_url),
    ]
    read = extract.read_threads(crawl, SITE_3).first()
    assert (read.n_items, read.n_dates, len(read.posts)) == (3, 2, 2)


def test_an_empty_source_leaves_the_others(spark):
    none = pages(spark, [(f"{HOST}/list", "")])
    empty = extract_source(none, pages(spark, SITE_1_PAGES), SITE_3)
    assert all_posts([site1(spark), empty]).count() == 2


def test_prototype_links(spark):
    html = (
        '<td class="td_title"><a>no</a><a href="/t1">1</a><a href="/n">n</a></td>'
        '<td class="td_title"><i>none</i></td><td><a href="/other">o</a></td>'
    )
    got = extract.cell_links(pages(spark, [(HOST, html)])).collect()
    assert [r.thread_url.rsplit("/", 1)[1] for r in got] == ["t1"]


def test_counts_are_observed_while_writing(spark, tmp_path):
    found = site1(spark)
    seen = Observation()
    rows = posts.observed(found.posts.unionByName(found.rejects.drop("reason")), seen)
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"kept": 2, "no_date": 1, "no_body": 0}


def test_legacy_and_canonical(spark):
    rows = posts.canonical(site1(spark).posts)
    older = posts.legacy(rows)
    assert older.columns == ["thread_title", "post_index", "post_date", "post_content"]
    assert posts.from_legacy(older, SITE_1.source_url).exceptAll(rows).isEmpty()
    both = posts.union_schemas(rows, older)
    assert both.count() == 4 and both.where("source_url is null").count() == 2


def test_a_hot_thread_is_numbered_in_blocks(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("thread"), F.col("id").alias("at")
    )
    got = posts.number_rows(rows, "thread", "at", block=100)
    expected = rows.groupBy("thread").agg(F.count("*").alias("n"))
    dense = got.groupBy("thread").agg(
        F.max("post_index").alias("top"), F.countDistinct("post_index").alias("n")
    )
    assert dense.where("top <> n").isEmpty()
    assert dense.select("thread", "n").exceptAll(expected).isEmpty()
    hot = got.where("thread = -1").orderBy("at").select("post_index").collect()
    assert [r[0] for r in hot] == list(range(1, len(hot) + 1))


def test_last_pages_both_ways(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "t int, p int")
    for small in (True, False):
        got = posts.last_pages(rows, "t", "p", small=small).collect()
        assert sorted(tuple(r) for r in got) == [(1, 2), (1, 2), (2, 5)]


# Joins with a third of all rows under one key


@pytest.fixture(scope="module")
def skewed(spark):
    facts = spark.range(0, 9000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        .alias("key"),
        (F.col("id") % 7).alias("x"),
    )
    table = spark.range(0, 400).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"),
        F.col("id").alias("value"),
    )
    return facts, table


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("rows_per_task", [10, 100, 1_000_000])
def test_spread_join_is_exact(skewed, how, rows_per_task):
    facts, table = skewed
    got = spread_join(facts, table, "key", how, rows_per_task)
    want = facts.join(table, "key", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_spread_join_with_copies_on_the_right(skewed):
    facts, table = skewed
    twice = table.unionByName(table)
    got = spread_join(facts, twice, "key", "left", 100)
    want = facts.join(twice, "key", "left")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_hot_key_is_dealt_over_many_tasks(spark, skewed):
    facts, table = skewed
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = spread_join(facts, table, "key", "left", 100)
        tasks = got.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        nulls = got.where("key is null").select(F.spark_partition_id()).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 3000
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 1500
    assert nulls >= 6


def test_hot_keys_are_few(skewed):
    facts, _ = skewed
    counts = facts.groupBy("key").agg(F.count("*").alias("n"))
    got = hot_keys(counts, "key", "n", 1000).collect()
    assert [(r["_hot"], r["_salts"]) for r in got] == [("hot", 3)]


def test_lookup_beyond_the_broadcast_bound(skewed):
    facts, table = skewed
    assert fits(table) and not fits(table, max_rows=399) and not fits(table, max_bytes=1000)
    small, large = (lookup(facts, table, "key", small=s) for s in (True, False))
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_equal_and_sparse_positions_are_spread(spark):
    rows = spark.range(4000).select(
        F.lit("hot").alias("thread"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") * 10**6).alias("at"), F.lit("x").alias("same")
    )
    rows = rows.unionByName(spark.sql("select null as thread, 1L as at, 'y' as same union all select 'a', null, 'y' union all select 'a', 5, 'y'"))
    got = posts.number_rows(rows, "thread", "at", block=250)
    numbers = [r[0] for r in got.where("thread = 'hot'").orderBy("at", "post_index").select("post_index").collect()]
    assert numbers == list(range(1, 4001))
    assert sorted(r.post_index or 0 for r in got.where("thread is null or thread = 'a'").collect()) == [0, 0, 1]
    ranges = got.where("thread = 'hot' and at = 7").groupBy(F.spark_partition_id()).count().collect()
    # Small files of the staged table are read together, so fewer tasks than ranges.
    assert len(ranges) >= 3 and max(r["count"] for r in ranges) < 1000
    assert posts.number_rows(rows.where("false"), "thread", "at").isEmpty()


def test_ordered_export_is_bounded_and_in_order(spark, tmp_path):
    from pathlib import Path

    from postloom.schemas import CANONICAL
    from postloom.sources.posts_csv import write_ordered

    rows = spark.range(1000).select(
        (F.col("id") % 100 + 1).cast("int").alias("post_index"), F.format_string("t%02d", F.floor(F.col("id") / 100)).alias("thread_title"),
        F.lit("d").alias("post_date"), F.lit("a\nb").alias("post_content"), F.lit("u").alias("source_url"),
    ).orderBy(F.rand(3)).select(CANONICAL)
    assert write_ordered(rows, str(tmp_path / "out"), ["thread_title", "post_index"], rows_per_file=150) == 1000
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    read = [spark.read.csv(str(f), header=True, multiLine=True, quote='"', escape='"').collect() for f in files]
    assert len(files) >= 7 and max(map(len, read)) <= 150
    assert [(r[1], int(r[0])) for part in read for r in part] == [(f"t{i:02}", j) for i in range(10) for j in range(1, 101)]


def test_without_hot_keys_the_join_sends_no_list_around(skewed):
    facts, table = skewed
    plan = spread_join(facts, table.hint("merge"), "key")._jdf.queryExecution().toString()
    assert "_salts" not in plan
    few = spread_join(facts, table, "key").count()
    assert few == spread_join(facts, table, "key", "left", 100).count() == facts.count()


def test_the_keys_of_the_left_side_are_counted_in_one_pass(spark, skewed):
    _, table = skewed
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    seen_ = F.udf(seen, "long").asNondeterministic()
    left = spark.range(0, 60, numPartitions=3).select(seen_("id").alias("n")).select(F.concat(F.lit("k"), "n").alias("key"))
    joined = spread_join(left, table, "key")
    assert read.value == 60
    assert joined.count() == 60


def test_rows_that_an_inner_join_cannot_match_are_not_dealt(spark, skewed):
    facts, table = skewed
    few = table.where("value < 3 or value is null").unionByName(spark.sql("select null as key, 9L as value"))
    want = facts.join(few, "key")
    for rows_per_task in (10, 1_000_000):
        got = spread_join(facts, few, "key", "inner", rows_per_task)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # Without a hot key the filter is in the plan; with one, only what passes it is staged.
    plan = spread_join(facts, few, "key", "inner")._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan
    floats = [spark.createDataFrame([(x,)], "key double") for x in (0.0, -0.0)]
    assert spread_join(*floats, "key", "inner").count() == 1
    other = spark.createDataFrame([(1,)], "key int"), spark.createDataFrame([(1,)], "key long")
    assert spread_join(*other, "key", "inner").count() == 1
