"""Values of a token table for each token of a text."""

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import is_blank
from postloom.operators.joins import fingerprint, fits, lookup, token_filter  # noqa: F401

MAX_INLINE_ROWS = 50_000
MAX_INLINE_BYTES = 4 << 20


def inlines(table: DataFrame) -> bool:
    """Whether the table is small enough to travel inside the plan as one constant."""
    return fits(table, MAX_INLINE_ROWS, MAX_INLINE_BYTES)


def one_per_token(table: DataFrame, token: str, value: str) -> DataFrame:
    """Unique tokens; of several values the least, so that every run agrees."""
    return table.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(value).alias(value))


def constant_lookup(table: DataFrame, token: str, value: str):
    """A function from a token column to its value in the table, or null. The table, which must
    be within the inline bound, becomes a constant: an array of small maps, addressed by hash."""
    table = one_per_token(table, token, value)
    kind = table.schema[value].dataType.simpleString()
    size = 1 << 14
    slot = F.pmod(F.xxhash64(token), F.lit(size)).cast("int")
    slots = [None] * size
    for row in table.select(slot.alias("slot"), token, value).collect():
        slots[row["slot"]] = {**(slots[row["slot"]] or {}), row[token]: row[value]}
    return _slotted(slots, kind, lambda tok: F.xxhash64(tok))


def _slotted(slots: list, kind: str, hashed):
    """A function from a column to its value in a constant array of small maps."""
    constant = F.from_json(F.lit(json.dumps(slots, default=str)), f"array<map<string,{kind}>>")

    def get(key):
        return F.try_element_at(
            F.get(constant, F.pmod(hashed(key), F.lit(len(slots))).cast("int")), key
        )

    return get


def constant_map(values: dict[str, float], kind: str = "double"):
    """A function from a string column to its value in `values`, or null. A look-up costs the same
    however many values there are."""
    slots = [None] * (1 << max(4, (2 * len(values)).bit_length()))
    for key, value in values.items():
        slot = zlib.crc32(key.encode()) % len(slots)
        slots[slot] = {**(slots[slot] or {}), key: value}
    return _slotted(slots, kind, F.crc32)


def token_hits(
    texts: DataFrame, tokens: str, table: DataFrame, token: str, value: str, small=None
) -> DataFrame:
    """One row per (text, position) whose token is in the table. Only `table`'s tokens survive
    the join, and each row carries a short key, not its text. Where the table is not `small`,
    tokens that a filter of its tokens rules out go before anything is shuffled (`spread_join`)."""
    # The outer form, as the inner one adds a size filter that splits every text again.
    exploded = texts.select(
        *[c for c in texts.columns if c != tokens], F.posexplode_outer(tokens).alias("pos", token)
    ).where("pos is not null")
    table = one_per_token(table, token, value)
    return lookup(exploded, table, token, "inner", small)


def token_values(
    df: DataFrame,
    tokens: str | Column,
    table: DataFrame,
    token: str,
    value: str,
    out: str,
    inline: bool | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Adds `out`: for each element of the array `tokens` its value in the table, or null. How the
    table is looked up is for `token_lookup`."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    found, values = token_lookup(df, tokens, table, token, value, inline, small)
    return found.withColumn(out, values(tokens)).drop(FOUND)


#: What `token_lookup` adds, to be dropped when its function has been used.
FOUND = "_found"


def token_lookup(
    df: DataFrame,
    tokens: Column,
    table: DataFrame,
    token: str,
    value: str,
    inline: bool | None = None,
    small: bool | None = None,
    text: Column | None = None,
):
    """`df`, and a function over it from the array `tokens` to an array of their values or nulls.
    With the function apart, a caller makes the tokens once for all that it does with them.

    A table within the inline bound is a constant of the plan: no shuffle, no explode. Beyond it
    the tokens of each distinct text are joined to the table, by broadcast while it is `small`,
    and gathered per text again, in a column `FOUND`. Given as an expression over other columns,
    `tokens` are made again where they are used and never shuffled with their rows. Where they are
    made of a `text`, without tokens if blank, it is that text's print that rows are joined by, and
    no tokens are made for it.
    """
    if inline is not False and inlines(table):
        found = constant_lookup(table, token, value)
        return df, lambda made: F.transform(made, found)
    small = small is not False and fits(table)
    key = fingerprint(tokens) if text is None else F.when(~is_blank(text), fingerprint(text))
    keyed = df.withColumn("_key", key)
    texts = df.select(key.alias("_key"), tokens.alias("_tokens"))
    if not small:
        # Tokens will be shuffled: copies of a text become one row first.
        texts = texts.groupBy("_key").agg(F.first("_tokens").alias("_tokens"))
    hits = token_hits(texts, "_tokens", table, token, value, small)
    # A set, as copies of a text give the same hits; combined before they move.
    found = hits.groupBy("_key").agg(
        F.array_sort(F.collect_set(F.struct("pos", value))).alias(FOUND)
    )
    joined = lookup(keyed, found, "_key", small=False).drop("_key")
    return joined, lambda made: _aligned(F.col(FOUND), value, F.size(made))


def _aligned(found: Column, value: str, size: Column) -> Column:
    """Sorted (pos, value) pairs as an array of `size` with nulls in the gaps, in one pass."""
    found = F.coalesce(found, F.array())
    nothing = F.lit(None)
    filled = F.flatten(
        F.transform(
            found,
            lambda hit, i: F.concat(
                F.array_repeat(
                    nothing, hit["pos"] - F.coalesce(F.get(found, i - 1)["pos"], F.lit(-1)) - 1
                ),
                F.array(hit[value]),
            ),
        )
    )
    last = F.coalesce(F.get(found, F.size(found) - 1)["pos"], F.lit(-1))
    return F.concat(filled, F.array_repeat(nothing, size - 1 - last))
