"""Words of many texts at once: NumPy arrays over the bytes that Arrow hands over.

A batch of texts is one byte buffer and its offsets. It is worked on in pieces of about a
megabyte, so memory follows the piece (or one longer text), never the batch.
"""

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)

#: ASCII blanks end words, all other bytes belong to them: [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and everything beyond ASCII: [0-9A-Za-z\x80-\xFF]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def free_name(frame: DataFrame, name: str) -> str:
    """The name, or with underscores added where the frame has it, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thrifty(run: Callable) -> Callable:
    """A function for mapInArrow whose worker, which lives on from task to task and from stage to
    stage, gives the memory that a task has freed back to the machine when the task is done."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `limit` bytes together, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def text_pieces(texts: pa.Array, limit: int = PIECE):
    """(first text, bytes, offsets from 0) of each piece."""
    data, offsets = text_buffer(texts)
    for i, j in pieces(offsets, limit):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


@dataclass
class Words:
    """Words by byte position; those of text t are `first[t]` to `first[t + 1]`."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # of the texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes, never across two texts."""
    inside = is_word[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets), offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = max(n, PIECE + 1)
            cls.up = np.cumprod(np.full(size, _ODD, np.uint64))
            cls.down = np.cumprod(np.full(size, _ODD_INVERSE, np.uint64))
        return cls.up, cls.down


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """64 bits of each word's bytes, the same wherever the word stands."""
    out = np.empty(len(words.starts), np.uint64)
    at = 0
    while at < len(out):
        # Words that span a piece together, or one longer word.
        to = int(np.searchsorted(words.ends, words.starts[at] + PIECE, "right"))
        to = max(to, at + 1)
        base, end = words.starts[at], words.ends[to - 1]
        up, down = _Powers.upto(end - base)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=sums[1:])
        starts, ends = words.starts[at:to] - base, words.ends[at:to] - base
        out[at:to] = (sums[ends] - sums[starts]) * down[starts]
        at = to
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): hashes of every k consecutive words of each text, in order. A text of
    fewer words, but not none, has its whole sequence as one."""
    n, counts = len(hashes), np.diff(first)
    ahead = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the text's end
    values = np.zeros(n, np.uint64)
    for i in range(k):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(n - i, 0)] = hashes[i:]
        shifted[ahead <= i] = 0
        values = values * np.uint64(_ODD) + shifted
    values = mix(values)
    here = ahead >= k
    short = (counts > 0) & (counts < k)
    here[first[:-1][short]] = True
    per_text = np.where(counts >= k, counts - k + 1, short)
    return values[here], np.concatenate([[0], np.cumsum(per_text)])


def joined_words(data: np.ndarray, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(kept)
    lengths, rows = words.ends[at] - words.starts[at], words.text[at]
    last = np.ones(len(at), bool)
    last[:-1] = rows[1:] != rows[:-1]
    room = lengths + ~last
    ends = np.cumsum(room)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(ends - room, lengths) + steps] = data[np.repeat(words.starts[at], lengths) + steps]
    bounds = np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(len(words.first)), "left")]
    return pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)
    ).cast(pa.string())
