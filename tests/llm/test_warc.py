import base64
import gzip
import hashlib
import io

import pytest
from helpers import frame
from pyspark.sql import functions as F

from postloom.llm import warc
from postloom.sources.scratch import new_path

HTTP = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n"


def convert(spark, rows, version):
    """ARC rows through files to WARC rows read back."""
    schema = "url string, ip string, date string, mime string, content binary"
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(frame(spark, rows, schema).coalesce(2), arc, version)
    read = warc.read_arc(spark, arc)
    page = warc.http_header(F.col("http"), "X-Page-Id").cast("long")
    warc.write_warc(warc.convert(read, page), out)
    return read.collect(), warc.read_warc(spark, out).withColumn("page", page).collect(), out


@pytest.mark.parametrize("version", [1, 2])
def test_records_come_back(spark, version):
    tricky = b"a\r\n\r\nWARC/1.1\r\nfiledesc:// 1 2 3 4 5\n\n\xc3\xa9"
    payloads = [b"", b"same", b"same", tricky, b"x" * 300_000, b"\n", b"", b"same"]
    rows = [(f"http://h/{i} b\n", "1.2.3.4", "20010203040506", "text/html", HTTP % i + p) for i, p in enumerate(payloads)]
    rows.append(("dns:h", None, "20010203040506", None, b"20010203 h 1.2.3.4"))
    old, new, out = convert(spark, rows, version)
    assert len(old) == len(new) == len(rows) and {r.version for r in old} == {version}
    by_page = {r.page: r for r in new}
    for i, p in enumerate(payloads):
        row = by_page[i]
        last = max(j for j, q in enumerate(payloads) if q == p)
        assert row.uri == f"http://h/{i}%20b%20" and row.time == "2001-02-03T04:05:06Z"
        assert row.payload_digest == warc.sha1_base32(p)
        if i == last:
            assert (row.type, row.refers_to, row.payload_bytes) == ("response", None, len(p))
            assert row.found_digest == row.payload_digest
        else:
            assert (row.type, row.refers_to, row.payload_bytes) == ("revisit", by_page[last].record_id, 0)
    assert by_page[None].type == "resource" and by_page[None].payload_bytes == 18
    assert len({r.record_id for r in new}) == len(new)
    # The identifiers are those of any other run.
    assert {r.record_id for r in convert(spark, rows, version)[1]} == {r.record_id for r in new}


def test_small_payloads_can_be_kept_whole(spark):
    rows = [(f"u{i}", "-", "20010203040506", "m", HTTP % i + b"ab") for i in range(3)]
    arc = new_path(spark, "arc")
    warc.write_arc(frame(spark, rows, "url string, ip string, date string, mime string, content binary"), arc, 1)
    read = warc.read_arc(spark, arc)
    page = warc.http_header(F.col("http"), "X-Page-Id").cast("long")
    types = lambda least: sorted(r.type for r in warc.convert(read, page, least).collect())
    assert types(3) == ["response"] * 3 and types(2) == ["response", "revisit", "revisit"]


def parse(data):
    return list(warc.parse_arc("f", io.BufferedReader(io.BytesIO(data))))


BODY = f"1 0 old\n{warc.FIELDS[1]}\n\n".encode()
HEAD = b"filedesc://x 0.0.0.0 19960923142103 text/plain %d\n" % len(BODY) + BODY


def test_legacy_lines():
    good = HEAD + b"\nhttp://a/b c 1.1.1.1 19960923142103 text/html 5\nhello\n"
    rows = parse(good)
    assert [(r[2], r[3], r[7], r[9], r[10]) for r in rows] == [(1, "http://a/b c", False, b"hello", None)]
    assert parse(good[:-3])[0][7] is True  # the file breaks off in the record
    assert parse(HEAD + b"\nnot a header\n")[0][10] == "no header line"
    assert parse(b"http://a 1 2 text/html 5\nhello")[0][10] == "no version record"
    assert parse(b"") == []
    body = f"2 0 x\n{warc.FIELDS[2]}\n".encode()
    two = b"filedesc://x 0 19960923142103 text/plain 200 - - 0 - %d\n" % len(body) + body
    row = parse(two + b"u 1.1.1.1 19960923142103 text/html 404 sum loc 99 file 3\nabcrest")[0]
    assert row[2:7] == (2, "u", "1.1.1.1", "19960923142103", "text/html") and row[9] == b"abc"


def test_written_files_are_warc(spark):
    _, _, out = convert(spark, [("u", "i", "20010203040506", "m", HTTP % 1 + b"pay")], 1)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(out).collect() if r.length]
    text = b"".join(gzip.decompress(f) for f in files)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"pay\r\n\r\n")
    (headers, block), = warc.parse_warc(io.BufferedReader(io.BytesIO(text)))
    assert block == HTTP % 1 + b"pay" and int(headers["content-length"]) == len(block)
    assert headers["warc-block-digest"] == "sha1:" + warc.sha1_base32(block)


def test_digests_and_no_rows(spark):
    for value in (b"", b"abc", b"\xff" * 20):
        assert base64.b32decode(warc.sha1_base32(value)) == hashlib.sha1(value).digest()
    assert convert(spark, [], 2)[:2] == ([], [])


def test_pages_without_an_id_or_text(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "u", None), (2, None, ""), (None, "u", "x"), (4, "u", "x"), (4, "u", "x"), (6, "u", "y")]
    frame(spark, rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = entry.queries()["op1_warc"](spark, str(tmp_path)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=str)
    want = [
        (1, 0, "revisit", 2), (2, 0, "response", None), (None, 1, "revisit", 4), (4, 1, "revisit", 4),
        (4, 1, "response", None), (6, 1, "response", None),
    ]
    assert got == sorted(want, key=str)


def test_legacy_header_lines_of_all_kinds(spark):
    line = b"http://a/ 1.2.3.4 19970102030405 text/html; charset=utf-8 5\nhello\n"
    broken = b"http://b/ 1.2.3.4 1997 text/html five\nsome text\n\nhttp://in.text/ and more\n"
    row, problem, last = parse(HEAD + b"\n" + line + broken + line)
    assert row[3:7] == ("http://a/", "1.2.3.4", "19970102030405", "text/html; charset=utf-8")
    assert problem[10] == "no header line" and last[3:10] == row[3:10] and problem[1] < last[1]
    # A length that is too short: the rest of the content is passed over.
    short = line.replace(b" 5\nhello", b" 2\nhello")
    assert [r[10] for r in parse(HEAD + short + line)] == [None, "no header line", None]
    two = b"filedesc://x 0 19960923142103 text/plain 200 - - 0 - %d\n" % len(BODY2) + BODY2
    row = parse(two + b"http://c/ - 20010101 text/html; a=b 302 - http://d/ 0 f.arc.gz 3\nabc")[0]
    assert row[3:7] == ("http://c/", "-", "20010101", "text/html; a=b") and row[9] == b"abc"


BODY2 = f"2 0 old\n{warc.FIELDS[2]}\n\n".encode()


def test_dates_are_completed_or_rejected(spark):
    from pyspark.sql import functions as F

    dates = {
        "19970203040506": "1997-02-03T04:05:06Z", "199702030405": "1997-02-03T04:05:00Z",
        "1997020304": "1997-02-03T04:00:00Z", "19970203": "1997-02-03T00:00:00Z",
        "20240229": "2024-02-29T00:00:00Z", "20230229": None, "19971301": None, "-": None, "": None,
        "1997": None, "199702": None, "19970203246000": None, "1997020304050": None, None: None,
    }
    rows = frame(spark, [(d,) for d in dates], "date string")
    assert {r[0]: r[1] for r in rows.select("date", warc.warc_time(F.col("date"))).collect()} == dates


def test_rejected_records_are_a_table_and_every_time_is_valid(spark):
    records = [
        ("u 1", "i", "19970101", "text/html; charset=utf-8", HTTP % 1 + b"pay"),
        ("u2", "i", "-", "m", HTTP % 2 + b"lost"),
        ("u3", "a b\n", "1997", "m\nn", HTTP % 3 + b"lost too"),
    ]
    rows = frame(spark, records, "url string, ip string, date string, mime string, content binary")
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(rows.coalesce(1), arc, 1)
    old = warc.read_arc(spark, arc)
    assert {(r.url, r.problem) for r in warc.rejected(old).collect()} == {("u2", "no valid date"), ("u3", "no valid date")}
    warc.write_warc(warc.convert(old, warc.http_header(old["http"], "X-Page-Id").cast("long")), out)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(out).collect() if r.length]
    text = b"".join(gzip.decompress(f) for f in files)
    (headers, _), = warc.parse_warc(io.BufferedReader(io.BytesIO(text)))
    assert headers["warc-date"] == "1997-01-01T00:00:00Z" and headers["warc-target-uri"] == "u%201"
