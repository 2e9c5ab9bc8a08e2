"""Byte-pair encoding and decoding, from the JSON file of a byte-level vocabulary.

A word is a row of symbols. A segment tree over the ranks of its neighbouring pairs has in its
root the lowest rank and, among equal ones, the leftmost place. The pair there is merged, the two
pairs beside it change, and three paths of the tree are updated. That goes on until the root
holds no mergeable pair. Words of up to `LONGEST` bytes are merged many at a time, one row of
arrays per word; longer ones one by one. Each task remembers words it has seen, up to a bound.
"""

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.words import thrifty

LONGEST = 64
REMEMBERED = 60_000
PIECE = 1 << 19
NONE = np.iinfo(np.int32).max

#: Fixed value: how text is cut before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"


def _plain_pattern(limit: int = 0x180) -> re.Pattern:
    """The same for texts below U+0180, with the classes written out."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(limit) if category(chr(c))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+"
        rf"| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


_ANY = regex.compile(
    PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
)
_PLAIN = _plain_pattern()
_BEYOND = re.compile("[^\x00-ſ]")


def cut(text: str) -> list[str]:
    """The words of a text; together they are the text."""
    return (_ANY if _BEYOND.search(text) else _PLAIN).findall(text)


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    tokens: list  # bytes by id
    of_byte: np.ndarray  # id of each single byte
    pairs: dict  # left * size + right -> (rank, id of the merged pair)
    special: dict  # text -> id

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(symbols[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        of_byte = np.zeros(256, np.int64)
        for symbol, byte in symbols.items():
            of_byte[byte] = vocab[symbol]
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a] * size + vocab[b]] = (rank, vocab[a + b])
        return cls(tokens, of_byte, pairs, special)


class PairTable:
    """The mergeable pairs in arrays, for many look-ups at once: open addressing, at most one
    place in four filled, so few look-ups need a second probe."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.tokens)
        bits = (4 * len(vocabulary.pairs) + 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.codes = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        codes = np.array(list(vocabulary.pairs), np.int64)
        values = np.array(list(vocabulary.pairs.values()), np.int32).reshape(-1, 2)
        at, rest = self._slot(codes), np.arange(len(codes))
        while len(rest):
            free = rest[self.codes[at[rest]] == -1]
            self.codes[at[free]] = codes[free]  # of several for one place, the last stays
            here = rest[self.codes[at[rest]] == codes[rest]]
            self.ranks[at[here]], self.merged[at[here]] = values[here, 0], values[here, 1]
            rest = rest[self.codes[at[rest]] != codes[rest]]
            at[rest] = (at[rest] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' places; the rank there is `NONE` for pairs that do not merge."""
        codes = left.astype(np.int64) * self.size + right
        at = self._slot(codes)
        there = self.codes[at]
        rest = np.flatnonzero((there != codes) & (there != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            there = self.codes[at[rest]]
            rest = rest[(there != codes[rest]) & (there != -1)]
        return at


def merge_rows(words: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges every row of byte ids (words x width, the width a power of two); what is merged
    into the symbol to its left becomes -1. All rows take a step at a time. Row r's symbols are
    at r * (width + 1), with an end mark behind them, and its tree at r * 2 * width."""
    n, width = words.shape
    wide, twice = width + 1, 2 * width
    ids = np.zeros((n, wide), np.int32)
    ids[:, :width] = words
    place = np.arange(width, dtype=np.int32)
    after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1))
    after[:, :width][place >= lengths[:, None] - 1] = width
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
    tree = np.full((n, twice), NONE, np.int32)
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()

    def leaves(row, at):
        """Rank and place of the pairs that start there, as one number."""
        base = row * wide
        to = after[base + at]
        rank = table.ranks[table.find(ids[base + at], ids[base + to])]
        return np.where((rank == NONE) | (to >= width), NONE, rank * width + at.astype(np.int32))

    row, at = np.nonzero(place < lengths[:, None] - 1)
    tree[row * twice + width + at] = leaves(row, at)
    levels = tree.reshape(n, twice)
    low = width
    while low > 1:
        half = low >> 1
        pair = levels[:, low : 2 * low].reshape(n, half, 2)
        np.minimum(pair[:, :, 0], pair[:, :, 1], out=levels[:, half:low])
        low = half

    live = np.flatnonzero(levels[:, 1] != NONE)
    while len(live):
        base, root = live * wide, live * twice
        at = (tree[root + 1] % width).astype(np.int64)
        to = after[base + at].astype(np.int64)
        ids[base + at] = table.merged[table.find(ids[base + at], ids[base + to])]
        ids[base + to] = -1
        following = after[base + to]
        after[base + at] = following
        before[base + following] = at
        prior = before[base + at].astype(np.int64)
        has = np.flatnonzero(prior >= 0)
        rows = np.concatenate([live, live[has]])
        changed = np.concatenate([at, prior[has]])
        tree[rows * twice + width + changed] = leaves(rows, changed)
        tree[root + width + to] = NONE
        node = np.concatenate([changed, to]) + width
        rows = np.concatenate([rows * twice, root])
        for _ in range(width.bit_length() - 1):
            node >>= 1
            children = rows + 2 * node
            tree[rows + node] = np.minimum(tree[children], tree[children + 1])
        live = live[tree[root + 1] != NONE]
    out = ids.reshape(n, wide)[:, :width]
    out[place >= lengths[:, None]] = -1
    return out


def merge_one(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same for one word of any length."""
    table = vocabulary.pairs
    size, n = len(vocabulary.tokens), len(word)
    width = 1 << max(n - 1, 0).bit_length()
    none = (1 << 62, 0)
    ids = vocabulary.of_byte[list(word)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(at):
        if after[at] >= n:
            return none
        found = table.get(ids[at] * size + ids[after[at]])
        return (found[0], at) if found else none

    tree = [none] * (2 * width)
    for at in range(n):
        tree[width + at] = leaf(at)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at, value):
        node = at + width
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] is not none and tree[1] != none:
        at = tree[1][1]
        to = after[at]
        ids[at] = table[ids[at] * size + ids[to]][1]
        ids[to] = -1
        after[at] = after[to]
        if after[at] < n:
            before[after[at]] = at
        update(to, none)
        update(at, leaf(at))
        if before[at] >= 0:
            update(before[at], leaf(before[at]))
    return [i for i in ids if i >= 0]


class Encoder:
    """Texts to token ids as packed little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.table = PairTable(vocabulary)
        names = sorted(vocabulary.special, key=len, reverse=True)
        # One group around all of them, so that splitting keeps them, at the odd places.
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def learn(self, words: Iterable[str]) -> None:
        words = list(words)
        data = list(map(str.encode, words))
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        starts = np.cumsum(lengths) - lengths
        # Short rows read a little past their word; those symbols are not looked at.
        flat = np.frombuffer(b"".join([*data, bytes(LONGEST)]), np.uint8)
        width, low = 2, 0
        while width <= LONGEST:
            group = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                rows = self.vocabulary.of_byte[flat[starts[part][:, None] + np.arange(width)]]
                ids = merge_rows(rows, lengths[part], self.table)
                kept = ids >= 0
                packed = ids[kept].astype("<u4").tobytes()
                ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                self.known.update(
                    zip(
                        map(words.__getitem__, part.tolist()),
                        [packed[i:j] for i, j in zip([0, *ends], ends)],
                    )
                )
            low, width = width, 2 * width
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            self.known[words[i]] = np.array(merge_one(data[i], self.vocabulary), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """One packed row of ids per text; specials in a text become their own ids."""
        cuts = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            cuts.append([p if i % 2 else cut(p) for i, p in enumerate(parts)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words: set[str] = set()
        for parts in cuts:
            words.update(*parts[::2])
        self.learn(words.difference(self.known))
        known, special = self.known.__getitem__, self.vocabulary.special
        return [
            b"".join(
                special[part].to_bytes(4, "little") if i % 2 else b"".join(map(known, part))
                for i, part in enumerate(parts)
            )
            for parts in cuts
        ]


def decode_ids(packed: bytes, tokens: list[bytes]) -> str:
    """The text of the ids; bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
    ids = np.frombuffer(packed, "<u4")
    return b"".join(map(tokens.__getitem__, ids[ids < len(tokens)].tolist())).decode("utf-8", "replace")


def _slices(column: pa.Array):
    """Texts of about a megabyte together."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= PIECE:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the binary column `ids` in place of `text`: packed little-endian unsigned
    32-bit token ids of the whole text. A null or empty text has none. Repeated rows are encoded
    one by one. Special tokens that stand in a text become their ids, as in the file's own
    library, and nothing is added around a text. A column named `ids`, in any case, is replaced."""
    # Plain values: a class would be looked for on the executors.
    sent = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.load(path)))
    others = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]

    def run(batches):
        encoder = Encoder(Vocabulary(**sent.value))
        for batch in batches:
            at = 0
            for part in _slices(batch.column(len(others))):
                rows = pa.array(encoder.encode(part), pa.binary())
                kept = [c.slice(at, len(part)) for c in batch.columns[: len(others)]]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*kept, rows], [*others, ids])

    frame = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text))
    schema = with_field(frame.drop(text).schema, ids, T.BinaryType())
    return frame.mapInArrow(thrifty(run), schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`frame` with the string column `text` made from packed ids; null ids give an empty text.
    A column named `text` is replaced."""
    frame = frame.drop(text)
    sent = frame.sparkSession.sparkContext.broadcast(Vocabulary.load(path).tokens)
    place = frame.columns.index(ids)

    def run(batches):
        for batch in batches:
            texts = [decode_ids(v.as_py() or b"", sent.value) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text]
            )

    return frame.mapInArrow(run, with_field(frame.schema, text, T.StringType()))


def id_array(frame: DataFrame, ids: str = "ids") -> DataFrame:
    """`frame` with packed ids as array<int>."""
    place = frame.columns.index(ids)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            rows = [np.frombuffer(v.as_py() or b"", "<i4") for v in column]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            arrays = list(batch.columns)
            arrays[place] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    kinds = [
        f"`{f.name}` " + ("array<int>" if f.name == ids else f.dataType.simpleString())
        for f in frame.schema
    ]
    return frame.mapInArrow(run, ", ".join(kinds))
