"""Two tokenizers' tokens of the same texts, aligned by the bytes they stand for.

A text is tokenised whole by both. Where a token of each ends at one byte and the next token of
each begins with a space, the text is cut; what lies between two cuts is a window, known by its
two rows of ids alone. Windows repeat as words do, so a window's alignment is remembered under
its ids and only new ones are worked out. A corpus-wide count of linked id pairs comes from
partial counts per task; it is then laid against each text's links. For that the links are written
in stretches, so that what is read in one go follows the stretch and not the length of the texts.
"""

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.bpe import PATTERN, Vocabulary
from postloom.llm.words import mix, pieces, text_pieces, thrifty
from postloom.operators.joins import hot_keys, spread_join
from postloom.sources.scratch import Workspace, stage

PIECE = 1 << 18
#: Windows that a task remembers; about 600 bytes each.
REMEMBERED = 60_000
#: Pairs that a task counts before it hands them on, and links that are looked at together.
COUNTED, LINKS = 1 << 18, 1 << 18
#: Links in a row that is read again: Spark reads some thousand rows at a time, however long.
STRETCH = 256
#: Linked id pairs that are sent to every task, 16 bytes each; more are joined.
MAX_SENT_PAIRS = 4_000_000


class Side:
    """The bytes of each id of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.length[ids]
        return self.bytes[np.repeat(self.start[ids], lengths) + _steps(lengths)]


def byte_level_tokens(path: str) -> list[bytes]:
    """Tokens by id, without special ones, of a byte-level vocabulary whose merges stand in the
    order of their ids, so that ids serve as ranks."""
    vocabulary = Vocabulary.load(path)
    made = [merged for _, merged in vocabulary.pairs.values()]
    if made != sorted(made):
        raise ValueError(f"the merges of {path} do not stand in the order of their ids")
    special = set(vocabulary.special.values())
    return [b"" if i in special else t for i, t in enumerate(vocabulary.tokens)]


def piece_tokens(model: bytes) -> list[bytes]:
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    name = pieces.id_to_piece
    return [
        bytes([int(name(i)[3:5], 16)]) if pieces.is_byte(i) else name(i).replace("▁", " ").encode()
        for i in range(pieces.get_piece_size())
    ]


def vocabulary_size(piece_path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def _steps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds; wraps like its type."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Aligner:
    """Tokenises and aligns; one per task."""

    def __init__(self, byte_tokens: list[bytes], model: bytes):
        ranks = {t: i for i, t in enumerate(byte_tokens) if t}
        self.bytes_ = tiktoken.Encoding(
            "bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a, self.b = Side(byte_tokens), Side(piece_tokens(model))
        self.decimal = Side([b"%d" % i for i in range(max(len(self.a.length), len(self.b.length)))])
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []

    def tokenise(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of A, their first per text, ids of B, theirs); none where the bytes differ."""
        rows = [data[i:j].tobytes().decode() for i, j in zip(offsets, offsets[1:])]
        of_a = [self.bytes_.encode_ordinary(" " + t) if t else [] for t in rows]
        of_b = self.pieces.encode(rows, num_threads=1) if rows else []
        want = np.where(np.diff(offsets) > 0, np.diff(offsets) + 1, 0)
        spaced = np.full(int(want.sum()), 0x20, np.uint8)
        begin = np.cumsum(want) - want
        filled = np.flatnonzero(want)
        # The space of each text, and then its bytes.
        body = np.ones(len(spaced), bool)
        body[begin[filled]] = False
        spaced[body] = data
        good = want > 0
        for ids, side in ((of_a, self.a), (of_b, self.b)):
            for t in filled.tolist():
                row = np.array(ids[t], np.int64)
                spelt = side.spell(row)
                good[t] &= len(spelt) == want[t] and bool(
                    (spelt == spaced[begin[t] : begin[t] + want[t]]).all()
                )
        out = []
        for ids in (of_a, of_b):
            kept = [np.array(row if ok else [], np.int64) for row, ok in zip(ids, good.tolist())]
            first = np.concatenate([[0], np.cumsum([len(row) for row in kept])]).astype(np.int64)
            out += [np.concatenate([np.zeros(0, np.int64), *kept]), first]
        return out

    def windows(self, a, first_a, b, first_b):
        """(first token of A, of B) of each window and one past the last, and windows per text."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        after_a, after_b = at_a + 1, at_b + 1
        last = np.zeros(len(a) + 1, bool)
        last[first_a[1:]] = True
        cut = last[after_a]
        inner = np.flatnonzero(~cut)
        cut[inner] = self.a.spaced[a[after_a[inner]]] & self.b.spaced[b[after_b[inner]]]
        from_a = np.concatenate([[0], after_a[cut]])
        from_b = np.concatenate([[0], after_b[cut]])
        first = np.searchsorted(from_a, first_a)
        return from_a, from_b, first

    def align(self, a, b, from_a, from_b) -> np.ndarray:
        """The number, in `groups` and `links`, of each window's alignment."""
        n = len(from_a) - 1
        if not n:
            return np.zeros(0, np.int64)
        size_a, size_b = np.diff(from_a), np.diff(from_b)
        print_ = mix(_sums(mix(a.astype(np.uint64) << np.uint64(24) ^ _steps(size_a).astype(np.uint64)), from_a))
        print_ ^= _sums(
            mix((b.astype(np.uint64) << np.uint64(24) ^ _steps(size_b).astype(np.uint64)) + np.uint64(1 << 60)),
            from_b,
        )
        _, first, same = np.unique(print_, return_index=True, return_inverse=True)
        # Windows of one print are held against the first of them, id by id.
        like = first[same]
        differ = (size_a != size_a[like]) | (size_b != size_b[like])
        for ids, begin, size in ((a, from_a, size_a), (b, from_b, size_b)):
            rows = np.flatnonzero(~differ)
            steps = _steps(size[rows])
            apart = (
                ids[np.repeat(begin[rows], size[rows]) + steps]
                != ids[np.repeat(begin[like[rows]], size[rows]) + steps]
            )
            differ[np.repeat(rows, size[rows])[apart]] = True
        alone = np.flatnonzero(differ)
        kinds = np.concatenate([first, alone])
        same[alone] = len(first) + np.arange(len(alone))
        if len(self.known) + len(kinds) > max(REMEMBERED, len(kinds)):
            self.known.clear()
            self.groups.clear()
            self.links.clear()
        numbers, new = np.empty(len(kinds), np.int64), []
        packed_a, packed_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        bounds = ((4 * x).tolist() for x in (from_a[kinds], from_a[kinds + 1], from_b[kinds], from_b[kinds + 1]))
        for i, (p, q, r, s) in enumerate(zip(*bounds)):
            key = (packed_a[p:q], packed_b[r:s])
            number = self.known.get(key)
            if number is None:
                number = self.known[key] = len(self.known)
                new.append(i)
            numbers[i] = number
        if new:
            new = kinds[new]
            parts = []
            for ids, begin, size in ((a, from_a, size_a), (b, from_b, size_b)):
                size = size[new]
                parts.append(ids[np.repeat(begin[new], size) + _steps(size)])
                parts.append(np.concatenate([[0], np.cumsum(size)]))
            self._learn(parts[0], parts[2], parts[1], parts[3])
        return numbers[same]

    def _learn(self, a, b, from_a, from_b) -> None:
        """Remembers the alignments of many windows: links, and groups as they are written."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        # Each token of A overlaps the tokens of B from the first that ends after its start.
        low = np.searchsorted(ends_b, ends_a - self.a.length[a], "right")
        high = np.searchsorted(ends_b, ends_a, "left")
        count = high + 1 - low
        codes = np.repeat(a, count) * len(self.b.length) + b[np.repeat(low, count) + _steps(count)]
        last_a = ends_b[high] == ends_a
        last_b = np.zeros(len(b), bool)
        last_b[high[last_a]] = True
        # A group is written as its tokens of A and then those of B, each with what follows it.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        after_a = np.flatnonzero(last_a) + 1
        first_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        at_a = np.arange(len(a)) + first_b[group_a]
        at_b = np.arange(len(b)) + after_a[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        width = self.decimal.length[ids] + 1
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ends - 1] = mark
        digits = np.ones(len(out), bool)
        digits[ends - 1] = False
        out[digits] = self.decimal.spell(ids)
        text = out.tobytes()
        bounds = np.concatenate([[0], ends])[from_a + from_b].tolist()
        self.groups += [text[i : j - 1] for i, j in zip(bounds, bounds[1:])]
        packed = codes.tobytes()
        bounds = (8 * np.concatenate([[0], np.cumsum(count)])[from_a]).tolist()
        self.links += [packed[i:j] for i, j in zip(bounds, bounds[1:])]

    def texts(self, column: pa.Array):
        """A struct column per piece of texts, see `align`."""
        for _, data, offsets in text_pieces(column, PIECE):
            a, first_a, b, first_b = self.tokenise(data, offsets)
            from_a, from_b, first = self.windows(a, first_a, b, first_b)
            numbers = self.align(a, b, from_a, from_b)
            kinds, which = np.unique(numbers, return_inverse=True)
            links = [self.links[k] for k in kinds.tolist()]
            texts = [self.groups[k] for k in kinds.tolist()]
            n_groups = np.array([t.count(b";") + 1 for t in texts], np.int64)[which]
            size = np.array([len(x) // 8 for x in links], np.int64)
            start = (np.cumsum(size) - size)[which]
            size = size[which]
            codes = np.frombuffer(b"".join(links), np.int64)[np.repeat(start, size) + _steps(size)]
            n_links = _sums(size, first)
            ends = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
            which = which.tolist()
            digests = [
                hashlib.sha256(b";".join([texts[k] for k in which[i:j]])).hexdigest() if j > i else ""
                for i, j in zip(first[:-1].tolist(), first[1:].tolist())
            ]
            yield [
                pa.array(np.diff(first_a)),
                pa.array(np.diff(first_b)),
                pa.array(_sums(n_groups, first)),
                pa.array(n_links),
                pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)),
            ]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def align(
    docs: DataFrame, byte_path: str, piece_path: str, *, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups_sha256, links) per row of `docs`.

    A is the byte-level vocabulary in the file `byte_path`, of space + text, and B the piece
    model in `piece_path`, which adds the space. Groups are what lies between two places where
    tokens of both end; their hash is over `a1,a2|b1;a3|b2,b3`. A link is a token of A and one of
    B that share bytes; `links` has the code (id of A) * (size of B) + (id of B) of each, in order.

    Null and empty texts, and those whose tokens spell other bytes than space + text, have no
    tokens: zeros and an empty string. Strings of special tokens are plain text. Rows are answered
    one by one, repeated ones too; columns of `docs` that are not named are not read. A text is
    worked on whole: about 100 bytes a token.
    """
    context = docs.sparkSession.sparkContext
    with open(piece_path, "rb") as file:
        sent = context.broadcast((byte_level_tokens(byte_path), file.read()))
    frame = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    names = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches):
        aligner = Aligner(*sent.value)
        for batch in batches:
            at = 0
            for columns in aligner.texts(batch.column(1)):
                rows = batch.column(0).slice(at, len(columns[0]))
                at += len(rows)
                yield pa.RecordBatch.from_arrays([rows, *columns], names)

    kind = frame.schema["doc"].dataType.simpleString()
    return frame.mapInArrow(thrifty(run), f"doc {kind}, {ALIGNED}").withColumnRenamed("doc", doc)


def stretches(aligned: DataFrame) -> DataFrame:
    """(_row, head, links): a row for each `STRETCH` of a text's links, one for a text without any.
    All rows of a text have its number; `head`, in the first of them alone, holds its other columns.
    Made again it may number otherwise: stage it."""
    head = F.struct(*[f"`{c}`" for c in aligned.columns if c != "links"])
    rows = aligned.select(F.monotonically_increasing_id().alias("_row"), head.alias("head"), "links")
    starts = F.sequence(F.lit(1), F.greatest(F.size("links"), F.lit(1)), F.lit(STRETCH))
    return rows.select("*", F.explode(starts).alias("at")).select(
        "_row",
        F.when(F.col("at") == 1, F.col("head")).alias("head"),
        F.slice("links", F.col("at"), F.lit(STRETCH)).alias("links"),
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n) over all links: counted in each task first."""

    def run(batches):
        held = []
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(codes), LINKS):
                held.append(np.unique(codes[at : at + LINKS], return_counts=True))
                if sum(len(c) for c, _ in held) > 2 * COUNTED:
                    held = [_summed(held)]
                    if len(held[0][0]) > COUNTED:
                        yield from _rows(*held.pop())
        if held:
            yield from _rows(*_summed(held))

    counted = aligned.select("links").mapInArrow(thrifty(run), "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def _summed(parts):
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def _rows(codes: np.ndarray, n: np.ndarray):
    for at in range(0, len(codes), 1 << 16):
        yield pa.RecordBatch.from_arrays(
            [pa.array(codes[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["code", "n"]
        )


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """`counts` with `best`: whether no pair of the same id of B has a higher count."""
    counts = counts.withColumn("b", F.col("code") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(
    aligned: DataFrame, size_b: int, *, max_sent: int = MAX_SENT_PAIRS
) -> DataFrame:
    """`aligned` with n_best (links whose pair is the most frequent of its id of B, ties too) and
    count_sum (the corpus-wide counts of its links' pairs), in place of `links`.

    Reads `aligned` once and stages it in stretches. Up to `max_sent` distinct pairs are sent to
    every task; more are joined to the texts' own counts of pairs, hot pairs spread.
    """
    texts = stage(stretches(aligned), "aligned")
    links = texts.select("_row", "links")
    with Workspace(aligned.sparkSession) as work:
        pairs = work.stage(pair_counts(links), "pair-counts")
        pairs = work.stage(with_best(pairs, size_b), "best-pairs")
        if pairs.count() <= max_sent:
            return _with_sums(texts, _scored_by_sent(links, pairs))
        return stage(_with_sums(texts, _scored_by_join(links, pairs, work)), "link-scores")


def _with_sums(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Each text's head once, with the sums of its parts, zero where it has none."""
    names = ["n_best", "count_sum"]
    sums = parts.groupBy("_row").agg(*[F.sum(c).alias(c) for c in names])
    heads = texts.where(F.col("head").isNotNull()).select("_row", "head")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names]
    return heads.join(sums, "_row", "left").select("head.*", *zero)


def _scored_by_sent(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_row, n_best, count_sum) of each stretch."""
    table = pairs.toArrow()
    code = table["code"].to_numpy()
    order = np.argsort(code)
    sent = links.sparkSession.sparkContext.broadcast(
        (code[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order])
    )

    def run(batches):
        for batch in batches:
            codes, n, best = sent.value
            links = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            for i, j in pieces(ends, LINKS):
                own = links.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(codes, own)
                bounds = ends[i : j + 1] - ends[i]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(_sums(best[at].astype(np.int64), bounds)),
                        pa.array(_sums(n[at], bounds)),
                    ],
                    ["_row", "n_best", "count_sum"],
                )

    return links.mapInArrow(thrifty(run), "_row long, n_best long, count_sum long")


def _scored_by_join(links: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """(_row, n_best, count_sum) of each distinct pair of a stretch."""

    def run(batches):
        for batch in batches:
            links = batch.column(1)
            sizes = links.value_lengths().to_numpy(zero_copy_only=False)
            codes = links.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((codes, rows))
            rows, codes = rows[order], codes[order]
            new = np.ones(len(codes), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[first])),
                    pa.array(codes[first]),
                    pa.array(np.diff(np.append(first, len(codes)))),
                ],
                ["_row", "code", "times"],
            )

    own = work.stage(links.mapInArrow(thrifty(run), "_row long, code long, times long"), "own-pairs")
    hot = hot_keys(pairs, "code", "n", 1_000_000)
    return spread_join(own, pairs, "code", "inner", hot=hot).select(
        "_row",
        F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("n") * F.col("times")).alias("count_sum"),
    )
