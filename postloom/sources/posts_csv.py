"""Post tables in CSV files, as spreadsheets and csv writers produce them."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.text import na_to_null
from postloom.schemas import CSV_HEADERS

# Quotes are doubled inside quoted fields, fields may span lines, blanks are kept.
DIALECT = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


_RECORD, _SURPLUS = "_postloom_record", "_postloom_surplus"


def read_posts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    headers: dict = CSV_HEADERS,
    *,
    na_as_null: bool = False,
) -> DataFrame:
    """Typed rows of `schema`, columns found by their header names, wherever they stand.

    A column that the files lack is null, as is the end of a row shorter than the header. Other
    columns are left out. Text is never guessed into numbers. With `na_as_null`, a field that is
    wholly a missing token ("NA", "null", ...) reads as null. Rows that do not parse are in
    `rejected_posts`. The files of a folder must have one header; another one raises.
    """
    rows = _parsed(spark, path, schema, headers).where("reason is null")
    rows = rows.select("row.*")
    if na_as_null:
        texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({c: na_to_null(F.col(c)) for c in texts})
    return rows


def rejected_posts(
    spark: SparkSession, path: str, schema: T.StructType, headers: dict = CSV_HEADERS
) -> DataFrame:
    """(record, reason) of the rows that `read_posts` leaves out: "surplus field" for more fields
    than the header has, "bad <column>" for a value that is not of its column's type."""
    return _parsed(spark, path, schema, headers).where("reason is not null").select(
        "record", "reason"
    )


def _parsed(spark, path, schema, headers) -> DataFrame:
    """(row, record, reason) of every record."""
    found = spark.read.options(**DIALECT, inferSchema=False).csv(path).columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in found])
    rows = (
        spark.read.schema(texts.add(_RECORD, "string"))
        .options(**DIALECT, enforceSchema=False, columnNameOfCorruptRecord=_RECORD)
        .csv(path)
    )
    # A record with other than the header's number of fields is kept as it is; one more column
    # tells whether it has too many.
    wider = T.StructType(
        [*(T.StructField(f"c{i}", T.StringType()) for i in range(len(found))),
         T.StructField(_SURPLUS, T.StringType())]
    )
    dialect = {k: str(v).lower() if isinstance(v, bool) else v for k, v in DIALECT.items() if k not in ("header", "encoding")}
    surplus = F.from_csv(F.col(_RECORD), wider.simpleString()[7:-1].replace(":", " "), dialect)
    reason = F.when(surplus[_SURPLUS].isNotNull(), "surplus field")
    columns = []
    for field in schema.fields:
        name = headers[field.name]
        if name not in found:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{name}`")
        typed = text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)
        reason = F.coalesce(
            reason, F.when(text.isNotNull() & typed.isNull(), f"bad {field.name}")
        )
        columns.append(typed.alias(field.name))
    whole = F.to_csv(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(found)])) if found else F.lit("")
    return rows.select(
        F.struct(*columns).alias("row"), F.coalesce(F.col(_RECORD), whole).alias("record"), reason.alias("reason")
    )


def write_posts(df: DataFrame, path: str, headers: dict = CSV_HEADERS, mode: str = "overwrite"):
    """Header row first, one file per partition; null and "" are both an empty field."""
    named = df.withColumnsRenamed({c: headers[c] for c in df.columns})
    options = {k: v for k, v in DIALECT.items() if k != "multiLine"}
    named.write.mode(mode).options(**options, emptyValue="").csv(path)


def write_ordered(
    df: DataFrame,
    path: str,
    order: list[str],
    headers: dict = CSV_HEADERS,
    rows_per_file: int = 1_000_000,
    mode: str = "overwrite",
) -> int:
    """CSV files whose names, in order, give the rows in `order`, at most `rows_per_file` in each;
    returns the number of rows. Ranges are sorted side by side, so no task sorts everything; rows
    that are equal in `order` lie in one range. Nulls come first. Counts the rows first."""
    rows = df.count()
    ranges = max(1, -(-rows // rows_per_file))
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    named = sorted_.withColumnsRenamed({c: headers[c] for c in df.columns})
    options = {k: v for k, v in DIALECT.items() if k != "multiLine"}
    writer = named.write.mode(mode).options(**options, emptyValue="")
    writer.option("maxRecordsPerFile", rows_per_file).csv(path)
    return rows


def snapshot_path(prefix: str, at: datetime) -> str:
    return f"{prefix}_{at:%Y%m%d_%H%M%S}"


def write_snapshot(df: DataFrame, prefix: str, at: datetime, headers: dict = CSV_HEADERS) -> str:
    """A CSV export named after the run's time, which the caller passes in."""
    path = snapshot_path(prefix, at)
    write_posts(df, path, headers)
    return path
