import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postloom.functions.select import Selector
from postloom.operators.extract import elements
from postloom.operators.sentiment import score
from postloom.schemas import PAGES
from postloom.streaming.incremental import append_new, enrich_new, new_files


def arrive(spark, folder, ids):
    rows = [(i, f"http://h/{i}", f'<p>good {i}<a href="/{i}">x</a></p>' * 2) for i in ids]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(folder)


def links(pages):
    return elements(pages, Selector(tag="a")).select("page_id", "pos", "href")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for ids in (range(3), range(3, 5)):
        arrive(spark, folder, ids)
    for _ in range(2):
        append_new(links(new_files(spark, folder, PAGES, files_per_batch=1)), out, log)
        assert rows(spark.read.parquet(out)) == rows(links(spark.read.parquet(folder)))
    arrive(spark, folder, [9])
    append_new(links(new_files(spark, folder, PAGES)), out, log)
    assert rows(spark.read.parquet(out)) == rows(links(spark.read.parquet(folder)))


def test_a_restart_after_a_failed_batch_loses_and_doubles_nothing(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    arrive(spark, folder, range(3))
    append_new(links(new_files(spark, folder, PAGES)), out, log)
    arrive(spark, folder, range(3, 6))
    broken = links(new_files(spark, folder, PAGES)).withColumn(
        "href",
        F.when(F.col("page_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("href")),
    )
    with pytest.raises(StreamingQueryException):
        append_new(broken, out, log)
    append_new(links(new_files(spark, folder, PAGES)), out, log)
    assert rows(spark.read.parquet(out)) == rows(links(spark.read.parquet(folder)))


def test_scores_are_added_once_even_when_a_batch_plays_again(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    calls = []

    def enrich(batch):
        scored = score(batch, lexicon, "html").select("page_id", "sentiment_score")
        calls.append(1)
        if len(calls) == 2:
            # The batch was written, and the run died before it was noted as done.
            meta = json.loads(spark.read.text(f"{log}/metadata").first()[0])
            scored.withColumns(
                {"stream_id": F.lit(meta["id"]), "batch_id": F.lit(1)}
            ).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("stream_id", "batch_id").parquet(out)
            raise RuntimeError("lost")
        return scored

    arrive(spark, folder, range(3))
    enrich_new(new_files(spark, folder, PAGES), enrich, out, log)
    arrive(spark, folder, range(3, 6))
    with pytest.raises(StreamingQueryException):
        enrich_new(new_files(spark, folder, PAGES), enrich, out, log)
    enrich_new(new_files(spark, folder, PAGES), enrich, out, log)
    got = spark.read.parquet(out).select("page_id", "sentiment_score")
    want = score(spark.read.parquet(folder), lexicon, "html").select("page_id", "sentiment_score")
    assert rows(got) == rows(want) and len(calls) == 3


def test_another_checkpoint_over_a_table_adds_rows_and_takes_none(spark, tmp_path):
    first, second, out = (str(tmp_path / n) for n in ("in1", "in2", "out"))
    arrive(spark, first, range(3))
    arrive(spark, second, range(100, 102))
    keep = lambda batch: batch.select("page_id")
    enrich_new(new_files(spark, first, PAGES), keep, out, str(tmp_path / "log1"))
    enrich_new(new_files(spark, second, PAGES), keep, out, str(tmp_path / "log2"))
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 100, 101]


def arrivals(spark, folder, lots, schema):
    """A stream of files that are written lot by lot."""
    from postloom.streaming.incremental import new_files

    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(folder)
    return new_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1).withWatermark("at", "1 hour")


EXTRACT = (
    "url string, readable boolean, page_title string, n_items int, page_count int, "
    "posts array<struct<post_index: int, post_date: string, post_content: string>>, at timestamp"
)


def extract(url, last, text, hour):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1) + timedelta(hours=hour)
    return (url, True, None, 1, last, [(1, "d", text)], at)


def run_last_pages(spark, folder, lots, out, log):
    from postloom.streaming.threads import last_page_extracts

    append_new(last_page_extracts(arrivals(spark, folder, lots, EXTRACT), "at"), out, log)
    rows = spark.read.parquet(out).collect()
    return sorted((r.thread_url, r.last_page, r.missing, r.posts[0][2] if r.posts else None) for r in rows)


def test_last_page_comes_first_last_or_never_and_a_restart_goes_on(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    first = [
        [extract("u/t1p3", 3, "one-3", 0), extract("u/t2", 2, "two-1", 0), extract("u/t4", 2, "four-1", 0)],
        [extract("u/t1", 3, "one-1", 1), extract("u/t3", 1, "three-1", 1), extract("u/t3", 1, "a copy", 1)],
    ]
    want = [("u/t1", 3, False, "one-3"), ("u/t3", 1, False, "three-1")]
    assert run_last_pages(spark, folder, first, out, log) == want
    # A run of its own goes on from the log: page 2 of the second thread completes it.
    second = [[extract("u/t2p2", 2, "two-2", 2), extract("u/t1p2", 3, "one-2", 2)]]
    want = sorted([*want, ("u/t2", 2, False, "two-2")])
    assert run_last_pages(spark, folder, second, out, log) == want
    # A thread that grew gives its new last page; one that never ended is missing in time.
    third = [[extract("u/t3p2", 2, "three-2", 5)], [extract("u/t9", 1, "nine", 60)], [extract("u/t8", 1, "eight", 61)]]
    got = run_last_pages(spark, folder, third, out, log)
    assert ("u/t3", 2, False, "three-2") in got and ("u/t4", 2, True, None) in got
    assert sum(r[0] == "u/t2" for r in got) == 1
    assert run_last_pages(spark, folder, [], out, log) == got


def test_titles_before_and_after_their_pages(spark, tmp_path):
    from datetime import datetime, timedelta

    from postloom.operators.posts import page_outcomes
    from postloom.sites import SITE_3
    from postloom.streaming.threads import titled_pages

    hours = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    links = "thread_url string, thread_title string, at timestamp"

    def run(page_lots, link_lots):
        pages = arrivals(spark, str(tmp_path / "pages"), page_lots, EXTRACT)
        listed = arrivals(spark, str(tmp_path / "links"), link_lots, links).withColumnRenamed("at", "listed")
        titled = titled_pages(pages, listed, "at", "listed")
        append_new(page_outcomes(titled, SITE_3, need_title=True), str(tmp_path / "out"), str(tmp_path / "log"))
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.url, r.thread_title, r.post_content, r.reason) for r in rows)

    # The first title is there before its page, the second after it and after a restart.
    got = run([[extract("b", 1, "text b", 0)], [extract("a", 1, "text a", 1)], [extract("c", 1, "text c", 0)]], [[("a", "A", hours(0))]])
    assert got == [("a", "A", "text a", None)]
    got = run([[extract("y", 1, "y", 80)]], [[("b", "B", hours(2))], [("z", "Z", hours(90))]])
    assert got == [
        ("a", "A", "text a", None),
        ("b", "B", "text b", None),
        ("c", None, None, "no title"),
    ]


def test_a_batch_of_one_file_is_enriched_by_all_cores(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    arrive(spark, folder, range(200))

    def placed(batch):
        return batch.select("page_id", F.spark_partition_id().alias("task"))

    enrich_new(new_files(spark, folder, PAGES, files_per_batch=1), placed, out, log)
    got = spark.read.parquet(out)
    assert sorted(r.page_id for r in got.select("page_id").collect()) == list(range(200))
    assert got.select("task").distinct().count() == spark.sparkContext.defaultParallelism
