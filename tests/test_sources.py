import csv
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.schemas import CSV_HEADERS, POSTS, SCORED_POSTS
from postloom.sources.pages import dealt, read_html_files
from postloom.sources.posts_csv import (
    read_posts,
    rejected_posts,
    snapshot_path,
    write_posts,
    write_snapshot,
)
from postloom.sources.tables import VersionedTable, append_each, append_sources

HEADER = [CSV_HEADERS[c] for c in POSTS.names]
ROWS = [
    [1, "t", "d", 'line1\nline2, "q" end', "u"],
    [2, "t", "d", 'back\\slash " q', "u"],
    [3, "t", "d", "", "u"],
    [4, "t", "d", "  \n ", "u"],
    [5, "t", "d", "NA", "u"],
    [6, "t", "d", "none", "u"],
    [7, "t", "d", "2024", "u"],
    [8, " padded ", "d", "same", "u"],
    [8, " padded ", "d", "same", "u"],
]


@pytest.fixture
def written(tmp_path):
    path = tmp_path / "posts.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([HEADER, *ROWS])
    return str(path)


def test_reads_what_a_csv_writer_wrote(spark, written):
    got = sorted(tuple(r) for r in read_posts(spark, written, POSTS).fillna("").collect())
    assert got == sorted(tuple(r) for r in ROWS)


def test_short_rows_end_in_nulls(spark, tmp_path):
    path = tmp_path / "posts.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow([CSV_HEADERS[c] for c in SCORED_POSTS.names])
        writer.writerow([*ROWS[0], "en", 0.5])
        writer.writerow(ROWS[1])
    got = read_posts(spark, str(path), SCORED_POSTS).orderBy("post_index").collect()
    assert [(r.translated_post_content, r.sentiment_score) for r in got] == [("en", 0.5), (None, None)]


def written_as(tmp_path, *lines):
    path = tmp_path / "given.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(lines)
    return str(path)


def test_columns_are_found_by_their_names(spark, tmp_path):
    order = [3, 0, 4, 2, 1]
    path = written_as(tmp_path, *[[row[i] for i in order] + ["more"] for row in [HEADER, *ROWS]])
    got = sorted(tuple(r) for r in read_posts(spark, path, POSTS).fillna("").collect())
    assert got == sorted(tuple(r) for r in ROWS)


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    good, short = [1, "t", "d", "a\nb", "u"], [2, "t"]
    path = written_as(tmp_path, HEADER, good, short, ["x1", "t", "d", "c", "u"], [3, "t", "d", "c", "u", "six"], ["", "t", "d", "c", "u"])
    rows = sorted((tuple(r) for r in read_posts(spark, path, POSTS).collect()), key=str)
    assert rows == sorted([tuple(good), (2, "t", None, None, None), (None, "t", "d", "c", "u")], key=str)
    aside = {r.reason: r.record for r in rejected_posts(spark, path, POSTS).collect()}
    assert set(aside) == {"bad post_index", "surplus field"}
    assert aside["surplus field"].rstrip() == "3,t,d,c,u,six" and aside["bad post_index"].startswith("x1,t")


def test_files_of_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(HEADER) + "\n1,t,d,c,u\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(",".join(reversed(HEADER)) + "\nu,c,d,t,1\n", encoding="utf-8")
    with pytest.raises(Exception):
        read_posts(spark, str(tmp_path), POSTS).collect()


def test_missing_tokens_are_text_unless_asked(spark, written):
    plain = read_posts(spark, written, POSTS).where("post_index in (5, 6)").orderBy("post_index")
    assert [r.post_content for r in plain.collect()] == ["NA", "none"]
    asked = read_posts(spark, written, POSTS, na_as_null=True).where("post_index in (5, 6)")
    assert [r.post_content for r in asked.orderBy("post_index").collect()] == [None, "none"]


def test_a_csv_reader_reads_what_we_wrote(spark, written, tmp_path):
    out = tmp_path / "out"
    write_posts(read_posts(spark, written, POSTS).coalesce(1), str(out))
    file = next(out.glob("*.csv"))
    with open(file, newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == HEADER
    assert sorted(got[1:]) == sorted([str(v) for v in r] for r in ROWS)


def test_snapshot_is_named_after_the_run(spark, written, tmp_path):
    at = datetime(2024, 9, 18, 1, 2, 3)
    path = write_snapshot(read_posts(spark, written, POSTS), str(tmp_path / "posts"), at)
    assert path.endswith("posts_20240918_010203") == (path == snapshot_path(str(tmp_path / "posts"), at))
    assert read_posts(spark, path, POSTS).count() == len(ROWS)


def test_html_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.html").write_text("<p>x\ny</p>", encoding="utf-8")
    (tmp_path / "2.html").write_text("<p>å</p>", encoding="utf-8")
    (tmp_path / "3.txt").write_text("no", encoding="utf-8")
    got = {r.url.rsplit("/", 1)[1]: r.html for r in read_html_files(spark, str(tmp_path)).collect()}
    assert got == {"1.html": "<p>x\ny</p>", "2.html": "<p>å</p>"}


def test_a_small_input_is_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert dealt(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == 8
    wide = spark.range(100).repartition(9)
    assert dealt(wide) is wide


def test_sources_append_under_their_name(spark, tmp_path):
    path = str(tmp_path / "t")
    append_sources({"a": spark.range(2), "b": spark.range(3)}, path)
    append_sources({"a": spark.range(2)}, path)
    got = spark.read.parquet(path).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 4, "b": 3}


def test_a_failing_source_stops_no_other(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    outcome = append_each(
        {"a": lambda: spark.range(2), "bad": lambda: bad, "gone": lambda: spark.read.parquet("/no"),
         "b": lambda: spark.range(3)},
        path,
    )
    assert [k for k, v in outcome.items() if v is None] == ["a", "b"]
    got = spark.read.parquet(path).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 2, "b": 3}


def test_a_table_is_replaced_by_what_is_read_from_it(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(3)) == 1
    before = table.read()
    assert table.replace(before.withColumn("x", F.col("id") + 1)) == 2
    assert sorted(tuple(r) for r in table.read().collect()) == [(0, 1), (1, 2), (2, 3)]
    assert before.count() == 3


def test_html_files_in_their_own_encodings(spark, tmp_path):
    from postloom.sources.pages import decode_pages, read_html_files

    text = "<p>åäö – “€” ñ</p>"
    given = {
        "utf8": (f'<meta charset="UTF-8">{text}', "utf-8", b""),
        "unsaid": (text, "utf-8", b""),
        "latin": (f"<meta charset=iso-8859-1>{text}", "cp1252", b""),
        "western": (f"<meta content='text/html; charset=windows-1252'>{text}", "cp1252", b""),
        "unsaid_western": (text, "cp1252", b""),
        "little": (text, "utf-16-le", b"\xff\xfe"),
        "big": (text, "utf-16-be", b"\xfe\xff"),
        "marked": (f"<meta charset=latin1>{text}", "utf-8", b"\xef\xbb\xbf"),
        "greek": ("<meta charset=iso-8859-7><p>αβγ</p>", "iso-8859-7", b""),
        "commented": (f"<!-- <meta charset=koi8-r> -->{text}", "utf-8", b""),
        "unknown": (f"<meta charset=no-such>{text}", "utf-8", b""),
    }
    for name, (html, codec, mark) in given.items():
        (tmp_path / f"{name}.html").write_bytes(mark + html.encode(codec))
    (tmp_path / "broken.html").write_bytes(b"<meta charset=utf-8>a\xffb")
    (tmp_path / "odd.html").write_bytes(b"\xff\xfea\x00b")
    (tmp_path / "empty.html").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not a page")
    rows = {r.url.rsplit("/", 1)[1][:-5]: r for r in read_html_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {*given, "broken", "odd"}  # Spark reads no empty file
    for name, (html, codec, _) in given.items():
        assert rows[name].html == html, name
    assert rows["latin"].encoding == rows["unsaid_western"].encoding == "windows-1252"
    assert (rows["greek"].encoding, rows["big"].encoding) == ("iso-8859-7", "utf-16be")
    assert rows["broken"].html == "<meta charset=utf-8>a�b"
    assert rows["odd"].html == "a�"
    nothing = spark.createDataFrame([(1, None, "old")], "id int, content binary, html string")
    assert [tuple(r) for r in decode_pages(nothing).collect()] == [(1, None, None)]
