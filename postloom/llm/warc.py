"""Legacy ARC archives, version 1 and 2, to WARC.

An ARC file opens with a record that says its version; that decides the fields of every later
header line. Fields are found around the date, as old addresses and content types may hold blanks,
and the content is as long as the line declares. Each record becomes a WARC record: an identifier from its
address, time and content, the time in ISO form, the type from the content (an HTTP answer is a
response, anything else a resource), and SHA-1 digests in base 32. Of responses with equal
payloads one is written whole; the others are revisits, with their HTTP headers and a reference.

Archives are written by Spark's text writer, as gzip files of the session's shared folder, and
read back as binary files, one file per row; a file holds what one task wrote.
"""

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.joins import fits
from postloom.sources.scratch import stage

BATCH = 4 << 20
SHORTEST = 0
#: The field lists of both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename"
    " Archive-length",
}
#: The header line of a record: an address that may hold blanks, then fields anchored on the date.
_LINE = {
    1: re.compile(rb"(.+?) (\S+) (\d{4,14}|-) (.*) (\d+)\r?\n?"),
    2: re.compile(rb"(.+?) (\S+) (\d{4,14}|-) (.*?) (\d{3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)\r?\n?"),
}
#: Where a broken record is passed over, what the next header line must look like.
_ADDRESS, _DATED = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:\S"), re.compile(rb"\d{8,14}")
LONGEST_LINE = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SCHEMA = (
    "file string, offset long, version int, url string, ip string, date string, mime string, "
    "truncated boolean, http binary, payload binary, problem string, payload_bytes long, "
    "payload_digest string, http_digest string, content_digest string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: DataFrame, path: str, version: int) -> None:
    """Writes `records(url, ip, date, mime, content)`, content binary, as ARC files of a version.
    Blanks and control characters of an address are percent-encoded, those of an IP or date become
    `_`, control characters of a content type become blanks; null fields become `-`."""
    field = lambda c: F.coalesce(F.col(c), F.lit("-"))
    plain = lambda c: F.regexp_replace(field(c), r"[\x00-\x20]", "_")
    url = F.regexp_replace(field("url"), r"[\x00-\x20]", "%20")
    size = F.octet_length("content").cast("string")
    middle = [plain("ip"), plain("date"), F.regexp_replace(field("mime"), r"[\x00-\x1f]", " ")]
    if version == 2:
        middle += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-")]
    line = F.concat_ws(" ", url, *middle, size)
    rows = records.select(
        F.concat(F.encode(F.concat(line, F.lit("\n")), "UTF-8"), F.col("content")).alias("record")
    )
    body = f"{version} 0 converted\n{FIELDS[version]}\n"
    rest = " 200 - - 0 -" if version == 2 else ""
    head = f"filedesc://archive.arc 0.0.0.0 19700101000000 text/plain{rest} {len(body)}\n{body}"

    def run(batches):
        opened = False
        for batch in batches:
            if not opened:
                yield pa.RecordBatch.from_arrays([pa.array([head.encode()], pa.binary())], ["record"])
                opened = True
            yield batch

    _write(rows.mapInArrow(run, "record binary"), path, "\n")


def _write(rows: DataFrame, path: str, separator: str) -> None:
    text = rows.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", separator).option("compression", "gzip").mode("append").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _batches(rows, schema):
    """Arrow batches of about `BATCH` bytes of content."""
    names, part, size = schema.names, [], 0
    for row in rows:
        part.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes)) + 256
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], names)


def split_http(content: bytes) -> tuple[bytes | None, bytes]:
    """(status line and headers with their blank line, payload); (None, all) if it is no answer."""
    if not content.startswith(b"HTTP/"):
        return None, content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def parse_arc(file: str, stream, content: bool = True):
    """Rows of `ARC_SCHEMA`, with null payloads unless `content`.

    A file that breaks off in a record gives it as truncated. A line that is no header gives a row
    that says so in `problem`, and reading goes on at the next line that is one beyond doubt: an
    address with its scheme, and a date of eight digits or more. A file without a version record
    gives one such row."""
    version, offset, lost = 0, 0, False
    while True:
        line = stream.readline(LONGEST_LINE)
        at, offset = offset, offset + len(line)
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        kinds = [version] if version else [2, 1]
        match = next((m for k in kinds if (m := _LINE[k].fullmatch(line))), None)
        sure = match and _ADDRESS.match(line) and _DATED.fullmatch(match[3])
        if not match or (lost and not sure):
            if not lost:
                problem = "no header line" if version else "no version record"
                yield (file, at, version, *[None] * 7, problem, *[None] * 4)
            if not version:
                return
            lost = True
            continue
        lost = False
        fields = [f.decode("utf-8", "replace") for f in match.groups()]
        size = int(fields[-1])
        body = stream.read(size)
        offset += len(body)
        if not version:
            found = body.split(b" ", 1)[0]
            if not line.startswith(b"filedesc:") or found not in (b"1", b"2"):
                yield (file, at, 0, *[None] * 7, "no version record", *[None] * 4)
                return
            version = int(found)
            continue
        http, payload = split_http(body)
        yield (
            file, at, version, *fields[:4], len(body) < size, http, payload if content else None, None,
            len(payload), sha1_base32(payload), sha1_base32(http or b""), sha1_base32(body),
        )


def read_arc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Rows of `ARC_SCHEMA` from every archive below the path; without `content` the payloads stay
    behind, for passes that only need the digests."""
    kinds = pa.schema(
        [
            ("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()),
            ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("truncated", pa.bool_()),
            ("http", pa.binary()), ("payload", pa.binary()), ("problem", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http_digest", pa.string()),
            ("content_digest", pa.string()),
        ]
    )

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                stream = gzip.GzipFile(fileobj=io.BytesIO(data.as_py()))
                rows = parse_arc(file.as_py(), io.BufferedReader(stream, 1 << 20), content)
                yield from _batches(rows, kinds)

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


def http_header(http: Column, name: str) -> Column:
    """The value of an HTTP header, null where it is missing."""
    value = F.regexp_extract(F.decode(http, "ISO-8859-1"), rf"(?i)\r\n{name}: *([^\r\n]*)", 1)
    return F.when(value != "", value)


def _urn(*parts: Column) -> Column:
    """A name-based identifier, the same for the same record in every run."""
    digest = F.sha1(F.encode(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "UTF-8"))
    piece = lambda at, n: F.substring(digest, at, n)
    return F.concat(
        F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3),
        F.lit("-8"), piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">"),
    )


def convert(
    arc: DataFrame, order: Column, least: int = SHORTEST, digests: DataFrame | None = None
) -> DataFrame:
    """WARC records of the readable ARC records: (record_id, type, uri, time, ip, payload_digest,
    refers_to, refers_uri, refers_time, truncated, block_digest, block).

    Of responses whose payloads are equal and have at least `least` bytes, the one with the
    greatest `order` (then file and offset; null is least) stays a response; the others become
    revisits. What is no HTTP answer becomes a resource and is never a revisit. Only digests are
    grouped; a digest that many records share is combined map-side. `digests` is the same archive
    without its payloads, where that is cheaper to read than `arc` once more.
    """
    rows = _described(arc, order)
    first = _described(arc if digests is None else digests, order).where(
        (F.col("type") == "response") & (F.col("payload_bytes") >= least)
    )
    first = first.groupBy("payload_digest").agg(
        F.max(F.struct("rank", "record_id", "uri", "time")).alias("first"), F.count("*").alias("n")
    )
    first = stage(first.where("n > 1").drop("n"), "shared-payloads")
    # Sent around while it is small, so that contents stay where they are; else they are shuffled.
    joined = rows.join(F.broadcast(first) if fits(first) else first, "payload_digest", "left")
    again = (
        (F.col("type") == "response")
        & (F.col("payload_bytes") >= least)
        & F.col("first").isNotNull()
        & (F.col("first.rank") != F.col("rank"))
    )
    return joined.select(
        "record_id",
        F.when(again, "revisit").otherwise(F.col("type")).alias("type"),
        "uri",
        "time",
        "ip",
        "payload_digest",
        F.when(again, F.col("first.record_id")).alias("refers_to"),
        F.when(again, F.col("first.uri")).alias("refers_uri"),
        F.when(again, F.col("first.time")).alias("refers_time"),
        "truncated",
        F.when(again, F.col("http_digest")).otherwise(F.col("content_digest")).alias("block_digest"),
        F.when(again, F.col("http"))
        .when(F.col("http").isNull(), F.col("payload"))
        .otherwise(F.concat("http", "payload"))
        .alias("block"),
    )


def warc_time(date: Column) -> Column:
    """A legacy date of 8, 10, 12 or 14 digits as YYYY-MM-DDThh:mm:ssZ, what it lacks taken as
    zero; null for others, and for days and hours that do not exist."""
    whole = F.rpad(F.when(F.length(date).isin(8, 10, 12, 14) & date.rlike(r"^\d+$"), date), 14, "0")
    part = lambda at, size: F.substring(whole, at, size)
    day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    clock = F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2))
    real = day.try_cast("date").isNotNull() & clock.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")
    return F.when(real, F.concat(day, F.lit("T"), clock, F.lit("Z")))


def rejected(arc: DataFrame) -> DataFrame:
    """(file, offset, url, date, problem) of what `convert` leaves out: lines that are no header,
    files without a version record, and records whose date cannot be a WARC-Date."""
    reason = F.coalesce("problem", F.when(warc_time(F.col("date")).isNull(), "no valid date"))
    return arc.select("file", "offset", "url", "date", reason.alias("problem")).where("problem is not null")


def _described(arc: DataFrame, order: Column) -> DataFrame:
    """The readable records with what WARC calls their type, address, time and identifier; the
    others are in `rejected`."""
    rows = arc.where("problem is null").where(warc_time(F.col("date")).isNotNull()).select(
        F.when(F.col("http").isNull(), "resource").otherwise("response").alias("type"),
        F.col("url").alias("uri"),
        warc_time(F.col("date")).alias("time"),
        "ip",
        "payload_digest",
        "payload_bytes",
        "http_digest",
        "content_digest",
        "truncated",
        "http",
        "payload",
        F.struct(order.alias("order"), F.col("file"), F.col("offset")).alias("rank"),
    )
    return rows.withColumn(
        "record_id", _urn(F.col("uri"), F.col("time"), F.col("payload_digest"), F.col("rank.order"))
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records of `convert` as WARC 1.1 files."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    given = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    http = F.col("type") != "resource"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("time")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest")),
        F.when(F.col("type") == "revisit", line("WARC-Profile", F.lit(REVISIT))).otherwise(""),
        given("WARC-Refers-To", F.col("refers_to")),
        given("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        given("WARC-Refers-To-Date", F.col("refers_time")),
        F.when(F.col("truncated"), line("WARC-Truncated", F.lit("length"))).otherwise(""),
        line(
            "Content-Type",
            F.when(http, "application/http; msgtype=response").otherwise("application/octet-stream"),
        ),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    _write(records.select(F.concat(F.encode(head, "UTF-8"), F.col("block")).alias("record")), path, "\r\n\r\n")


def parse_warc(stream):
    """(headers by lower-case name, block) of each record; the block is as long as declared."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        headers = {}
        for line in iter(stream.readline, b"\r\n"):
            if not line:
                raise ValueError("the file ends inside a record's headers")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, time, refers_to, payload_digest as declared, http, payload_bytes and
    found_digest of the payload that is there) of every record below the path."""
    kinds = pa.schema(
        [
            *((n, pa.string()) for n in ("record_id", "type", "uri", "time", "refers_to", "payload_digest")),
            ("http", pa.binary()), ("payload_bytes", pa.int64()), ("found_digest", pa.string()),
        ]
    )
    names = ["warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to"]

    def rows(stream):
        for headers, block in parse_warc(stream):
            http, payload = split_http(block)
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            yield (*map(headers.get, names), digest, http, len(payload), sha1_base32(payload))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))
                yield from _batches(rows(io.BufferedReader(stream, 1 << 20)), kinds)

    return _files(spark, path).select("content").mapInArrow(
        run,
        "record_id string, type string, uri string, time string, refers_to string, "
        "payload_digest string, http binary, payload_bytes long, found_digest string",
    )
