"""Repeated stretches of words, by relative Lempel-Ziv parsing against an index of all texts.

Every distinct text is a reference block. Its index entries are anchors: of the eight-word grams
in each 35-word window the one with the least hash, so that equal windows have equal anchors at
equal places. An anchor that comes more than once has one reference, its first place by (text,
position). A text is parsed from left to right: a factor begins at an anchor and goes on from
anchor to anchor as long as the words between are those of the reference and the next anchor's
reference lies just there too. A factor of a whole window or more is a repeat, here and at its
reference. Windows that stick out over factor boundaries, and those of the references themselves,
are checked one by one: their fingerprints, 64 bits beside the anchor's 64, are counted over all
texts.

No group is ever gathered: an anchor's reference is a minimum, combined map-side; hot anchors are
spread; windows are counts. A text's own anchors and spans are one row's work.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import (
    NOT_BLANK,
    Words,
    _Powers,
    find_words,
    hash_words,
    joined_words,
    mix,
    text_pieces,
)
from postloom.operators.joins import hot_keys, spread_join
from postloom.sources.scratch import Workspace, new_path, stage

WINDOW, GRAM = 35, 8
PIECE = 1 << 20
ROWS_PER_TASK = 1_000_000


class Stretches:
    """Fingerprints of runs of words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _Powers.upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value ^ mix((end - start).astype(np.uint64)))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    done, low = 1, values
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[: len(low) - (width - done)], low[width - done :])


class Anchors:
    """The anchors of a piece of texts: `at` (word), `doc`, `print` (of the gram), `between` (of
    the words up to and with the next anchor's gram; 0 for a text's last), and the windows that
    have it, `low` to `high`."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int, gram: int):
        self.stretches = Stretches(hashes)
        n, none = len(hashes), np.zeros(0, np.int64)
        self.at = self.doc = self.low = self.high = none
        self.print = self.between = np.zeros(0, np.uint64)
        if n < window:
            return
        place = np.arange(n - gram + 1)
        bits = np.uint64(max(n.bit_length(), 20))
        grams = self.stretches.of(place, place + gram)
        rank = (grams >> bits << bits) | place.astype(np.uint64)
        owner = (least_of(rank, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        text = words.text
        windows = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
        owner = owner[windows]
        if not len(owner):
            return
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        self.at = owner[first]
        self.doc = text[self.at]
        self.low = windows[first]
        self.high = windows[np.append(first[1:], len(windows)) - 1] + 1
        self.print = grams[self.at]
        self.between = np.zeros(len(self.at), np.uint64)
        pair = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        self.between[pair] = self.stretches.of(self.at[pair], self.at[pair + 1] + gram)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def anchors_of(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(print, key, at, between) of every anchor of (key, text)."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in text_pieces(batch.column(1), PIECE):
                words = find_words(data, offsets, NOT_BLANK)
                found = Anchors(words, hash_words(data, words), window, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(found.print),
                        batch.column(0).take(pa.array(first + found.doc)),
                        pa.array((found.at - words.first[found.doc]).astype(np.int32)),
                        _signed(found.between),
                    ],
                    ["print", "key", "at", "between"],
                )

    return texts.select("key", "text").mapInArrow(run, "print long, key binary, at int, between long")


_PARSED = (
    "key binary, repeats array<struct<start: int, end: int>>,"
    " sources array<struct<key: binary, start: int, end: int>>,"
    " open array<struct<print: long, window: long, start: int>>"
)


def _lists(rows: np.ndarray, n: int, names: list[str], columns: list[pa.Array]) -> pa.Array:
    """A list of structs for each of n rows, from columns in the order of rows."""
    ends = np.searchsorted(rows, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names))


def parse(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Factors (key, text, found) with found an array of (at, ref_key, ref_at, same): the repeated
    anchors with their references, `same` where the words up to the next anchor agree.

    `repeats` are factors that lie elsewhere too, `sources` the same places at their references,
    `open` the windows of repeated anchors that no factor holds."""

    def run(batches):
        for batch in batches:
            found, at_found = batch.column(2), 0
            for first, data, offsets in text_pieces(batch.column(1), PIECE):
                n = len(offsets) - 1
                words = find_words(data, offsets, NOT_BLANK)
                anchors = Anchors(words, hash_words(data, words), window, gram)
                keys = batch.column(0).slice(first, n)
                lists = found.slice(first, n)
                entries = lists.flatten()
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                doc = np.repeat(np.arange(n), sizes)
                entry = [entries.field(i) for i in range(4)]
                at, ref_at = (entry[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
                same = entry[3].to_numpy(zero_copy_only=False).astype(bool)
                # References as numbers; those of the own text are -1 less than none.
                names = pa.chunked_array([entry[1]]).combine_chunks().dictionary_encode()
                ref = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own = pa.compute.index_in(keys, names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
                place = words.first[doc] + at
                order = np.argsort(place, kind="stable")
                doc, at, ref, ref_at, same, place = (x[order] for x in (doc, at, ref, ref_at, same, place))
                number = np.searchsorted(anchors.at, place)
                itself = (ref == own[doc]) & (ref_at == at)
                # A factor goes on where the next anchor of the text has its reference next to ours.
                on = np.zeros(len(at), bool)
                on[:-1] = (
                    same[:-1]
                    & (number[1:] == number[:-1] + 1)
                    & (doc[1:] == doc[:-1])
                    & (ref[1:] == ref[:-1])
                    & (ref_at[1:] - ref_at[:-1] == at[1:] - at[:-1])
                )
                head = np.flatnonzero(np.concatenate([[True], ~on[:-1]])) if len(at) else at
                tail = np.append(head[1:], len(at)) - 1 if len(at) else at
                length = at[tail] + gram - at[head]
                whole = (length >= window) & ~itself[head]
                head, tail, length = head[whole], tail[whole], length[whole]
                # Windows of repeated anchors, without those inside a factor.
                inside = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(inside, place[head], 1)
                np.add.at(inside, place[head] + length - window + 1, -1)
                inside = np.cumsum(inside[:-1]) > 0
                count = anchors.high[number] - anchors.low[number]
                ends = np.cumsum(count)
                start = np.repeat(anchors.low[number] - (ends - count), count) + np.arange(
                    int(ends[-1]) if len(ends) else 0
                )
                of = np.repeat(number, count)[~inside[start]]
                start = start[~inside[start]]
                row = words.text[start] if len(start) else start
                local = (start - words.first[row]).astype(np.int32)
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        _lists(doc[head], n, ["start", "end"], [small(at[head]), small(at[head] + length)]),
                        _lists(
                            doc[head],
                            n,
                            ["key", "start", "end"],
                            [
                                names.dictionary.take(pa.array(ref[head])),
                                small(ref_at[head]),
                                small(ref_at[head] + length),
                            ],
                        ),
                        _lists(
                            row,
                            n,
                            ["print", "window", "start"],
                            [
                                _signed(anchors.print[of]),
                                _signed(anchors.stretches.of(start, start + window)),
                                pa.array(local),
                            ],
                        ),
                    ],
                    ["key", "repeats", "sources", "open"],
                )

    return texts.select("key", "text", "found").mapInArrow(run, _PARSED)


_CUT = "key binary, copies long, n_words long, spans array<struct<start: long, end: long>>, kept string"


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(key, copies, n_words, spans, kept) from (key, copies, text, spans): spans merged, and the
    words outside them joined by one space. A text that comes twice is a repeat as a whole."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in text_pieces(batch.column(2), PIECE):
                n = len(offsets) - 1
                words = find_words(data, offsets, NOT_BLANK)
                copies = batch.column(1).slice(first, n).to_numpy(zero_copy_only=False)
                lists = batch.column(3).slice(first, n)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                base = np.repeat(words.first[:-1], sizes)
                entries = lists.flatten()
                edges = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edges, base + entries.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edges, base + entries.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edges[:-1]) > 0
                gone |= np.repeat((copies > 1) & (words.counts >= window), words.counts)
                text = words.text
                begins, stops = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1] | (text[1:] != text[:-1])
                stops[:-1] &= ~gone[1:] | (text[1:] != text[:-1])
                start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                row = text[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(words.counts.astype(np.int64)),
                        _lists(
                            row,
                            n,
                            ["start", "end"],
                            [pa.array(start - words.first[row]), pa.array(end - words.first[row])],
                        ),
                        joined_words(data, words, ~gone),
                    ],
                    ["key", "copies", "n_words", "spans", "kept"],
                )

    return texts.select("key", "copies", "text", "spans").mapInArrow(run, _CUT)


def text_key(text) -> F.Column:
    """128 bits of the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(key, text, copies), written in buckets of the key, so that what is found by key later
    meets the texts without moving them again."""
    spark = docs.sparkSession
    texts = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    counted = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, buckets = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = counted.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key")
    writer.option("path", new_path(spark, "texts")).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved before its name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return written


def repeated_stretches(
    docs: DataFrame,
    text: str = "text",
    *,
    window: int = WINDOW,
    gram: int = GRAM,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(key, copies, n_words, spans, kept) of every distinct text of `docs`; `text_key` gives the
    key of a text, `copies` its number of rows.

    A window is `window` consecutive words between ASCII blanks. `spans` are the words (start,
    end, none next to another) that lie in a window whose words also begin anywhere else, in
    another row or in the same text; `kept` is the rest, joined by one space. Null and empty texts
    are one text without words. Rows of equal text are repeats of each other. Other columns of
    `docs` are not read. Texts of fewer words than a window are kept whole.
    """
    texts = distinct_texts(docs, text)
    with Workspace(docs.sparkSession) as work:
        spans = _spans(texts, work, window, gram, rows_per_task)
        spans = stage(spans, "repeated-spans")
    return cut(texts.join(spans, "key", "left"), window)


def _spans(texts: DataFrame, work: Workspace, window: int, gram: int, rows_per_task: int) -> DataFrame:
    """(key, spans) of the texts that have any, not merged."""
    anchors = anchors_of(texts, window, gram)
    index = anchors.groupBy("print").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "at", "between")).alias("ref")
    )
    index = work.stage(index.where("n > 1"), "anchor-index")
    hot = hot_keys(index, "print", "n", rows_per_task)
    entries = index.select("print", "n", F.col("ref.key").alias("ref_key"), "ref.at", "ref.between")
    entries = entries.withColumnsRenamed({"at": "ref_at", "between": "ref_between"})
    met = spread_join(anchors, entries, "print", "inner", rows_per_task, hot=hot, rows="n")
    same = (F.col("between") == F.col("ref_between")) & (F.col("between") != 0)
    found = met.groupBy("key").agg(
        F.collect_list(F.struct("at", "ref_key", "ref_at", same.alias("same"))).alias("found")
    )
    parsed = work.stage(parse(texts.join(found, "key"), window, gram), "factors")
    # A reference is told the longest factor from each place of it; factors repeat, so map-side.
    at_source = (
        parsed.select(F.explode("sources").alias("s"))
        .groupBy("s.key", "s.start")
        .agg(F.max("s.end").alias("end"))
    )
    open_ = parsed.select("key", F.inline("open"))
    twice = open_.groupBy("print", "window").agg(F.count("*").alias("n")).where("n > 1")
    twice = work.stage(twice.withColumn("id", F.xxhash64("print", "window")), "repeated-windows")
    hot = hot_keys(twice.groupBy("id").agg(F.sum("n").alias("n")), "id", "n", rows_per_task)
    again = spread_join(
        open_.withColumn("id", F.xxhash64("print", "window")),
        twice.select("id", F.col("print").alias("_p"), F.col("window").alias("_w")),
        "id",
        "inner",
        rows_per_task,
        hot=hot,
    ).where("print = _p and window = _w")
    ends = again.select("key", "start", (F.col("start") + window).alias("end"))
    whole = parsed.select("key", F.inline("repeats"))
    return (
        whole.unionByName(at_source)
        .unionByName(ends)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
