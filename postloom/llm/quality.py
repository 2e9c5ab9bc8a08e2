"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

A document's counts are taken in one pass over its whole text. Its rates, as whole numbers per
10,000, go into sketches: counts per cell, where a cell holds values that agree in their leading
`BITS` bits, so a quantile is right to one part in 2**(BITS - 1). Sketches merge by adding counts.
They need no randomness and no order, so a retried task changes nothing. A group with few
documents uses the merged sketch of its language, and then of all documents.

A rate is out of bounds where it lies further above its group's median than `reach` times the way
from the lower quartile to the median, plus an allowance. What lies above the median has no say in
it, so up to half of a group may be junk; for rates that can be too small the same holds below. In
a merged sketch the norms of several sources meet, so there the way is half the middle half's width
and counts from its ends.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.words import NOT_BLANK, Words, find_words, hash_words, mix, shingles, text_pieces
from postloom.sources.scratch import Workspace, stage

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
BITS = 6
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """`allowance` is per rate and per 10,000; `low` names the rates that can also be too small."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_docs: int = 100
    reach: int = 12
    allowance: dict = field(
        default_factory=lambda: {
            "symbols": 1_000,
            "dup_lines": 1_000,
            "repeats": 1_800,
            "word_length": 30_000,
        }
    )
    low: tuple = ("word_length",)


def rates() -> dict[str, Column]:
    """Whole numbers per 10,000 words; null where there are none."""
    per = lambda c: F.expr(f"({c} * 10000L) div nullif(n_words, 0)")
    return {
        "symbols": per("n_symbols"),
        "dup_lines": per("n_dup_lines"),
        "repeats": per("n_repeat_words"),
        "word_length": per("word_chars"),
    }


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(hashes: np.ndarray, words: Words, window: int) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in it."""
    values, first = shingles(hashes, words.first, window)
    # A text shorter than a window has one value, which stands for no window.
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(values)) - np.repeat(first[:-1], counts) + np.repeat(words.first[:-1], counts)
    key = mix(values ^ mix(text.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= words.counts[text] >= window
    edge = np.zeros(len(hashes) + window + 1, np.int64)
    np.add.at(edge, start[twice], 1)
    np.add.at(edge, start[twice] + window, -1)
    return _sums(np.cumsum(edge)[: len(hashes)] > 0, words.first)


def _duplicate_lines(data, offsets, words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    breaks = data == 0x0A
    lines = find_words((~breaks).astype(np.uint8), offsets, np.array([False, True] + [False] * 254))
    # A line counts if a word starts in it.
    at = np.searchsorted(words.starts, lines.starts)
    filled = np.zeros(len(lines.starts), bool)
    inside = at < len(words.starts)
    filled[inside] = words.starts[at[inside]] < lines.ends[inside]
    text = lines.text[filled].astype(np.uint64)
    kept = Words(lines.starts[filled], lines.ends[filled], lines.first, offsets)
    keys = np.sort(mix(hash_words(data, kept) ^ mix(text)))
    distinct = np.ones(len(keys), bool)
    distinct[1:] = keys[1:] != keys[:-1]
    if distinct.all():
        return np.zeros(len(offsets) - 1, np.int64)
    # Few texts repeat a line, so only here are lines looked at text by text.
    hashes = hash_words(data, kept)
    out = np.zeros(len(offsets) - 1, np.int64)
    ends = np.searchsorted(text, np.arange(len(out) + 1, dtype=np.uint64))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b - a > 1:
            out[i] = b - a - len(np.unique(hashes[a:b]))
    return out


def count_texts(texts: pa.Array, window: int) -> Iterator[list[np.ndarray]]:
    """The five counts, a piece of the column at a time."""
    for _, data, offsets in text_pieces(texts):
        words = find_words(data, offsets, NOT_BLANK)
        hashes = hash_words(data, words)
        begins_character = (data & 0xC0) != 0x80
        yield [
            words.counts,
            _sums(begins_character & NOT_BLANK[data], offsets),
            _sums(_SYMBOL[data], offsets),
            _duplicate_lines(data, offsets, words),
            _repeated_words(hashes, words, window),
        ]


def measure(docs: DataFrame, keys: list[str], text: str = "text", window: int = 5) -> DataFrame:
    """The columns `keys` and the five counts; a null text counts as empty."""
    names = [f"k{i}" for i in range(len(keys))]
    source = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            parts = list(zip(*count_texts(batch.column(len(names)), window)))
            counts = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            counts = counts or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *(pa.array(c, pa.int64()) for c in counts)],
                [*names, *COUNTS],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema][: len(names)]
    return source.mapInArrow(run, ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))


def cell(value: Column) -> Column:
    """The least value that agrees with a non-negative one in its leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by..., rate, cell, n): one row per cell; merging is summing n. Combined map-side, and at
    most 2**(BITS - 1) cells per doubling of the value."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), cell(v).alias("cell")) for k, v in values.items()]))
    cells = rows.select(*by, named.alias("_"))
    return cells.groupBy(*by, "_.rate", "_.cell").agg(F.count("*").alias("n"))


def merge(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by, "rate", "cell").agg(F.sum("n").alias("n"))


def quartiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rate, n, low, mid, high): documents and the cells of the quartiles."""
    group = Window.partitionBy(*by, "rate")
    upto = F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumns({"upto": upto, "all": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") * 4 > (F.col("all") - 1) * q, F.col("cell")))
    return ranked.groupBy(*by, "rate").agg(
        F.max("all").alias("n"), at(1).alias("low"), at(2).alias("mid"), at(3).alias("high")
    )


def bounds(cells: DataFrame, language: str, source: str, rules: Rules) -> DataFrame:
    """(language, source, bounds): per rate the least and the greatest value that is in bounds."""
    allowance = F.create_map(*[F.lit(x) for pair in rules.allowance.items() for x in pair])
    own = quartiles(cells, [language, source])
    by_language = merge(cells, [language])
    wider = quartiles(by_language, [language])
    widest = quartiles(merge(by_language, []), [])
    rename = lambda df, tag: df.select(
        *[F.col(c).alias(f"{tag}_{c}") for c in df.columns]
    )
    wide, all_ = rename(wider, "l"), rename(widest, "a")
    joined = own.join(
        wide, own[language].eqNullSafe(wide[f"l_{language}"]) & (own["rate"] == wide["l_rate"])
    ).join(all_, F.col("rate") == F.col("a_rate"))
    pick = lambda c: (
        F.when(F.col("n") >= rules.min_docs, F.col(c))
        .when(F.col("l_n") >= rules.min_docs, F.col(f"l_{c}"))
        .otherwise(F.col(f"a_{c}"))
    )
    low, high, allowed = pick("low"), pick("high"), allowance[F.col("rate")]
    alone, mid = F.col("n") >= rules.min_docs, F.col("mid")
    wide = F.floor((high - low) * rules.reach / 2)
    bound = F.struct(
        (F.when(alone, mid - (high - mid) * rules.reach).otherwise(low - wide) - allowed).alias("least"),
        (F.when(alone, mid + (mid - low) * rules.reach).otherwise(high + wide) + allowed).alias("most"),
    )
    return joined.groupBy(language, source).agg(
        *[
            F.max(F.when(F.col("rate") == r, bound)).alias(f"_{r}")
            for r in rules.allowance
        ]
    )


def judge(
    docs: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    source: str = "source",
    rules: Rules | None = None,
) -> DataFrame:
    """(doc, the five counts, base_failed, kept) per row of `docs`.

    `base_failed`: fewer than `min_words` words, or too many of them in repeated windows; such
    documents do not enter the sketches. The others are kept if no rate is out of the bounds of
    their language and source. A null language or source is a value of its own. Null and empty
    texts have no words and fail. Repeated rows are judged one by one; other columns are not read.
    """
    rules = rules or Rules()
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    counted = measure(docs, [doc, language, source], text, rules.window)
    counted = stage(counted.withColumn("base_failed", failed), "quality-counts")
    with Workspace(docs.sparkSession) as work:
        cells = work.stage(sketch(counted.where("not base_failed"), ["k1", "k2"], rates()), "cells")
        limits = stage(bounds(cells, "k1", "k2", rules), "quality-bounds")
    limits = limits.withColumnsRenamed({"k1": "_language", "k2": "_source"})
    judged = counted.join(
        limits, F.col("k1").eqNullSafe(F.col("_language")) & F.col("k2").eqNullSafe(F.col("_source")), "left"
    )
    fine = ~F.col("base_failed")
    for name, value in rates().items():
        fine = fine & (value <= F.col(f"_{name}.most"))
        if name in rules.low:
            fine = fine & (value >= F.col(f"_{name}.least"))
    return judged.select(F.col("k0").alias(doc), *COUNTS, "base_failed", F.coalesce(fine, F.lit(False)).alias("kept"))
