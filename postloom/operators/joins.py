"""Joins that hold when a side outgrows memory or a key holds a third of all rows."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.sources.scratch import stage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
ROWS_PER_TASK = 1_000_000
NULL_SALTS = 1 << 16
MAX_HOT_KEYS = 10_000


def fits(table: DataFrame, max_rows=MAX_BROADCAST_ROWS, max_bytes=MAX_BROADCAST_BYTES) -> bool:
    """Whether the table, measured now, is small enough to be sent to every executor. Texts,
    binaries and nested values count in full; no more rows are looked at than may be sent."""

    def bytes_of(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(c.alias("v"))))
        return F.lit(0)

    sizes = [F.coalesce(bytes_of(f), F.lit(0)) for f in table.schema]
    width = sum(sizes, F.lit(16 * len(table.columns))).cast("long")
    rows = table.limit(max_rows + 1).select(width.alias("w"))
    size = rows.agg(F.count("*").alias("rows"), F.sum("w").alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def fingerprint(*parts: Column) -> Column:
    """128 bits of the values, as a short join key for long texts."""
    return F.md5(F.concat_ws("\x1f", *parts))


#: Bits of a token filter for each token of its table, at most, and look-ups per token.
BITS_PER_TOKEN, MAX_FILTER_BITS, LOOK_UPS = 12, 1 << 24, 4
#: Keys of which equal values have equal hashes; floats and collated strings may not.
FILTERED_KINDS = {"string", "binary", "boolean", "tinyint", "smallint", "int", "bigint", "date"}


def _filter_bits(c: Column, bits: int) -> list[Column]:
    """The places of a token in a filter of `bits` (a power of two)."""
    last = F.lit(bits - 1).cast("long")
    return [F.xxhash64(c, F.lit(i)).bitwiseAND(last) for i in range(LOOK_UPS)]


def token_filter(table: DataFrame, token: str):
    """A function from a token column to whether it may be in the table: never false for one that
    is. The bits are set in each task, merged by word of 64, and travel as a constant of at most
    `MAX_FILTER_BITS`; a table too large for them lets more strangers through and loses nothing."""
    tokens = table.where(F.col(token).isNotNull()).select(token)
    bits = min(MAX_FILTER_BITS, max(1 << 10, 1 << (BITS_PER_TOKEN * tokens.count()).bit_length()))
    places = tokens.select(F.explode(F.array(*_filter_bits(F.col(token), bits))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    merged = places.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("set")).collect()
    words_ = [0] * (bits >> 6)
    for row in merged:
        words_[row["at"]] = row["set"]
    constant = F.from_json(F.lit(json.dumps(words_)), "array<bigint>")

    def maybe(c):
        held = F.lit(True)
        for bit in _filter_bits(c, bits):
            word = F.get(constant, F.shiftright(bit, 6).cast("int"))
            held = held & (F.getbit(word, bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return held

    return maybe


def hot_keys(counts: DataFrame, key: str, rows: str, rows_per_task: int) -> DataFrame:
    """(_hot, _salts) of the keys with more than `rows_per_task` rows, from a table of counts.
    There are at most (all rows / rows_per_task) of them, and `rows_per_task` is raised until they
    are at most `MAX_HOT_KEYS`."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    rows_per_task = max(rows_per_task, -(-total // MAX_HOT_KEYS))
    return counts.where((F.col(rows) > rows_per_task) & F.col(key).isNotNull()).select(
        F.col(key).alias("_hot"), F.ceil(F.col(rows) / rows_per_task).cast("int").alias("_salts")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
    rows: str | None = None,
) -> DataFrame:
    """Inner or left join on one column, with each hot key of `left` split over many tasks.

    A key with n left rows is dealt onto ceil(n / rows_per_task) salts, and its right rows are
    copied once per salt, so the result is exact. Only hot keys carry a salt count, and their
    list is short by construction (see `hot_keys`), so it is broadcast; without one, this is the
    plain join. Null keys match nothing
    and are dealt widely, by content. Where there is a hot key, `left` is staged first and dealt
    by the place of its rows there, which keeps equal rows apart and which a retried task sees
    again. Without a given `hot`, the keys of `left` are counted in a pass of their own, combined
    map-side: give a `left` that is cheap to read twice. Before they are counted, those that a
    filter of the keys of `right` rules out go from the left of an inner join. Where `right` itself
    has the number of left rows per key, name that column in `rows`.
    """
    if hot is None and how == "inner":
        kinds = {df.schema[key].dataType.simpleString() for df in (left, right)}
        if len(kinds) == 1 and kinds <= FILTERED_KINDS:
            left = left.where(token_filter(right, key)(F.col(key)))
    if hot is None:
        # Written out, as `hot_keys` reads them for their sum and again for the keys.
        counts = stage(left.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
        hot = hot_keys(counts, key, "_n", rows_per_task)
    few = hot.collect()  # at most MAX_HOT_KEYS
    if not few:
        number = F.xxhash64(*left.columns) + F.spark_partition_id()
        salt = F.when(F.col(key).isNull(), F.pmod(number, F.lit(NULL_SALTS))).otherwise(F.lit(0))
        copied = (right.drop(rows) if rows else right).withColumn("_salt", F.lit(0))
        return left.withColumn("_salt", salt.cast("int")).join(copied, [key, "_salt"], how).drop("_salt")
    hot = left.sparkSession.createDataFrame(few, hot.schema)
    left = stage(left, "dealt-rows")
    number = F.monotonically_increasing_id()
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(number, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), F.pmod(number, F.col("_salts")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    if rows:
        salts = F.ceil(F.col(rows) / rows_per_task).cast("int")
        copied = right.withColumn("_salts", F.greatest(salts, F.lit(1))).drop(rows)
    else:
        copied = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").drop("_hot")
    copied = copied.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return dealt.drop("_hot", "_salts").join(
        copied.drop("_salts"), [key, "_salt"], how
    ).drop("_salt")


def lookup(
    df: DataFrame, table: DataFrame, key: str, how: str = "left", small: bool | None = None
) -> DataFrame:
    """Join to a table with one row per key: broadcast when measured small, spread beyond that or
    where `small` is False."""
    small = small is not False and fits(table)
    return df.join(F.broadcast(table), key, how) if small else spread_join(df, table, key, how)
