"""Periodic runs of words, found on the grammar that Re-Pair makes of each text.

Re-Pair names repeated neighbours, round by round, until no two neighbours come twice in a text.
What is left is a short top string over terminals and nonterminals. A run lies either within one
derivation of a nonterminal, where it crosses the boundary between the two halves of the smallest
one that holds it, or across boundaries of the top string. So only boundaries are looked at: each
nonterminal's once, whatever its number of uses, and the runs found there are carried to all its
places. A run that is cut by the end of a nonterminal is whole at a boundary further up; intervals
of one period that lie in another are dropped.

A document is one row's work and texts are taken in pieces of a megabyte, so memory follows the
piece or one longer text (about 300 bytes a word of it).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.words import NOT_BLANK, find_words, hash_words, joined_words, mix, text_pieces

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of a boundary and a period that are compared at once.
PAIRS = 1 << 20
#: Two primes below 2^31, and a base for each.
_PRIMES = (np.uint64((1 << 31) - 1), np.uint64((1 << 31) - 19))
_BASES = (np.uint64(1_000_003_979), np.uint64(1_500_450_271))


@dataclass
class Grammar:
    """`start`, `middle`, `end` of each nonterminal's first place, all its places (`symbol`,
    `place`, ordered by symbol), and the places where a symbol of a top string begins."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    symbol: np.ndarray
    place: np.ndarray
    top: np.ndarray


def re_pair(symbols: np.ndarray, doc: np.ndarray) -> Grammar:
    """The grammar of each document's symbols, all documents of a piece in the same rounds.

    In a round every pair of neighbours that comes at least twice in its document, not counting
    overlaps, is ranked by its number of uses; a use is replaced where no overlapping use ranks
    higher. The most frequent pair of a document is thus replaced throughout, and as many others
    as do not touch it in the same round.
    """
    # A terminal is a word of one document, so that no pair spans two of them.
    sym = np.unique(mix(symbols ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True)[1]
    sym = sym.astype(np.int64)
    pos, n_terminals = np.arange(len(sym)), int(sym.max(initial=-1)) + 1
    size = np.ones(n_terminals, np.int64)
    starts, middles, ends, symbols_at, places_at, top = [], [], [], [], [], []
    made = 0
    while len(sym) > 1:
        here = doc[pos]
        left, right = sym[:-1], sym[1:]
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        inside = here[:-1] == here[1:]
        # Of equal symbols in a row, every second pair is free.
        alike = inside & (left == right)
        run_start = np.maximum.accumulate(np.where(alike, -1, np.arange(len(alike))))
        inside &= ~alike | ((np.arange(len(alike)) - run_start) % 2 == 1)
        at = np.flatnonzero(inside)
        _, group, uses = np.unique(key[at], return_inverse=True, return_counts=True)
        rank = np.zeros(len(sym) + 1, np.uint64)
        uses = uses[group].astype(np.uint64)
        often = uses >= 2
        at = at[often]
        tie = mix(key[at]) >> np.uint64(32)
        rank[at + 1] = (np.minimum(uses[often], np.uint64((1 << 32) - 1)) << np.uint64(32)) | tie
        # rank[i + 1] is that of the pair at i.
        chosen = at[(rank[at + 1] > rank[at]) & (rank[at + 1] >= rank[at + 2])] if len(at) else at
        _, first, group, uses = np.unique(
            key[chosen], return_index=True, return_inverse=True, return_counts=True
        )
        kept = uses >= 2
        chosen_kept = kept[group]
        name = (np.cumsum(kept) - 1)[group][chosen_kept]
        first = chosen[first[kept]]
        chosen = chosen[chosen_kept]
        if not len(chosen):
            break
        starts.append(pos[first])
        middles.append(pos[first] + size[sym[first]])
        size = np.concatenate([size, size[sym[first]] + size[sym[first + 1]]])
        ends.append(pos[first] + size[n_terminals + made :])
        symbols_at.append(made + name)
        places_at.append(pos[chosen])
        sym = sym.copy()
        sym[chosen] = n_terminals + made + name
        made += len(first)
        left_over = np.ones(len(sym), bool)
        left_over[chosen + 1] = False
        # Documents in which nothing was replaced have no repeated pair any more.
        active = np.zeros(int(doc[-1]) + 1, bool)
        active[here[chosen]] = True
        top.append(pos[left_over & ~active[here]])
        left_over &= active[here]
        sym, pos = sym[left_over], pos[left_over]
    top.append(pos)
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    symbol, place = join(symbols_at), join(places_at)
    order = np.argsort(symbol, kind="stable")
    return Grammar(
        join(starts), join(middles), join(ends), symbol[order], place[order], np.sort(join(top))
    )


class Prints:
    """Fingerprints of stretches: two polynomials modulo primes below 2^31."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(1, np.uint64)
            step = base
            while len(power) <= self.n:
                power = np.concatenate([power, power * step % prime])
                step = step * step % prime
            power = power[: self.n + 1]
            terms = (mix(symbols ^ prime) % prime) * power[:-1] % prime
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % prime)
            self.powers.append(power)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        out = []
        for prime, sums, power in zip(_PRIMES, self.sums, self.powers):
            part = (sums[start + length] + prime - sums[start]) % prime
            out.append(part * power[self.n - start] % prime)
        return (out[0] << np.uint64(31)) | out[1]

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, ahead: bool) -> np.ndarray:
        """How far the stretches that begin (or, not `ahead`, end) at a and b agree."""
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            back = 0 if ahead else middle
            same = self.of(a - back, middle) == self.of(b - back, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            high = np.maximum(low, high)
        return low


def _expand(first: np.ndarray, count: np.ndarray):
    """(row, value) of `count` consecutive values from `first`, in parts of about `PAIRS`."""
    at = 0
    total = np.cumsum(count)
    while at < len(count):
        before = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, before + PAIRS, "right")), at + 1)
        rows = np.repeat(np.arange(at, to), count[at:to])
        begin = total[at:to] - count[at:to] - before
        yield rows, first[rows] + np.arange(len(rows)) - begin[rows - at]
        at = to


def boundary_runs(
    symbols: np.ndarray, doc: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, start, end, period) of the runs at each boundary `middle`, cut at `low`, `high`.

    A run of four periods has two of them on one side of a boundary in it: a square that starts
    or ends there. Its root is between G and 2G words for a power G of two, so the G words at its
    start come again G to 2G words later. Places are grouped by their G words, fewer places each
    time G doubles, and a boundary looks up its partners by distance.
    """
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if not len(middle) or n < 2:
        return none, none, none, none
    prints = Prints(symbols)
    end_of = np.searchsorted(doc, doc, "right")  # the end of each place's document
    covered_to, covered_from = middle.copy(), middle.copy()
    found = []

    def squares(rows: np.ndarray, at: np.ndarray, q: np.ndarray):
        """Keeps and widens what is a square of root q at `at`."""
        same = prints.of(at, q) == prints.of(at + q, q)
        rows, at, q = rows[same], at[same], q[same]
        if not len(rows):
            return
        end = at + q + prints.common(at, at + q, high[rows] - at - q, True)
        start = at - prints.common(at, at + q, at - low[rows], False)
        np.maximum.at(covered_to, rows, end)
        np.minimum.at(covered_from, rows, start)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append((rows[long], start[long], end[long], q[long]))

    # Period one: the same word twice, right after the boundary or right before it.
    rows = np.flatnonzero(middle + 2 <= high)
    squares(rows, middle[rows], np.ones(len(rows), np.int64))
    rows = np.flatnonzero((middle - 2 >= low) & (covered_from > middle - 2))
    squares(rows, middle[rows] - 2, np.ones(len(rows), np.int64))
    g, places = 2, np.arange(n)
    while True:
        places = places[places + g <= end_of[places]]
        if len(places) < 2:
            break
        print_ = mix(prints.of(places, g) ^ mix(doc[places].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(print_, kind="stable")  # places stay in order within a group
        ordered = print_[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] >= 2
        if not many.any():
            break
        places_by, group = places[order][many], group[many]
        at_group = np.full(n + 1, -1)
        at_group[places_by] = group
        code = group * (n + 1) + places_by
        # Squares that start at the boundary, beyond what known runs there cover.
        for forward in (True, False):
            x = middle if forward else np.maximum(middle - g, 0)
            room = (high - middle if forward else middle - low) // 2
            least = (covered_to - middle if forward else middle - covered_from) // 2 + 1
            least = np.maximum(least, g)
            most = np.minimum(room, 2 * g - 1)
            rows = np.flatnonzero((least <= most) & (at_group[x] >= 0))
            if not len(rows):
                continue
            x, least, most = x[rows], least[rows], most[rows]
            base = at_group[x] * (n + 1)
            near, far = (x + least, x + most) if forward else (x - most, x - least)
            near = np.maximum(near, 0)
            first = np.searchsorted(code, base + near, "left")
            count = np.maximum(np.searchsorted(code, base + far, "right") - first, 0)
            for part, at in _expand(first, count):
                y = places_by[at]
                q = y - x[part] if forward else x[part] - y
                owner = rows[part]
                squares(owner, middle[owner] if forward else middle[owner] - 2 * q, q)
        places, g = np.sort(places_by), 2 * g
    if not found:
        return none, none, none, none
    return tuple(np.concatenate(column) for column in zip(*found))


def find_runs(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs, by start and then period. `doc` says which
    document each place belongs to and never falls."""
    n = len(symbols)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    grammar = re_pair(symbols, doc)
    begin_of = np.searchsorted(doc, doc, "left")
    end_of = np.searchsorted(doc, doc, "right")
    # The top strings, whose runs stand where they stand.
    top = grammar.top[grammar.top > begin_of[grammar.top]]
    _, *parts = boundary_runs(symbols, doc, begin_of[top], top, end_of[top])
    # Nonterminals that can hold a run, each looked at where it stands first.
    large = np.flatnonzero(grammar.end - grammar.start >= LEAST_WORDS)
    owner, start, end, period = boundary_runs(
        symbols, doc, grammar.start[large], grammar.middle[large], grammar.end[large]
    )
    owner = large[owner]
    first = np.searchsorted(grammar.symbol, owner, "left")
    count = np.searchsorted(grammar.symbol, owner, "right") - first
    moved = [tuple(parts)]
    for rows, at in _expand(first, count):
        shift = grammar.place[at] - grammar.start[owner[rows]]
        part = np.stack([start[rows] + shift, end[rows] + shift, period[rows]])
        moved.append(tuple(np.unique(part, axis=1)))
    return merge([np.concatenate(column) for column in zip(*moved)], n)


def merge(parts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without intervals that lie in another one of the same period."""
    start, end, period = parts
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(period * (n + 1) + end) if len(end) else end
    kept = np.ones(len(end), bool)
    kept[1:] = (period[1:] != period[:-1]) | (period[1:] * (n + 1) + end[1:] > reach[:-1])
    start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _answers(texts: pa.Array):
    """(n_words, runs, collapsed) columns of each piece."""
    for _, data, offsets in text_pieces(texts):
        words = find_words(data, offsets, NOT_BLANK)
        doc = words.text
        start, end, period = find_runs(hash_words(data, words), doc)
        rows = doc[start]
        base = words.first[rows]
        list_ends = np.searchsorted(rows, np.arange(len(offsets)), "left").astype(np.int32)
        runs = pa.ListArray.from_arrays(
            pa.array(list_ends),
            pa.StructArray.from_arrays(
                [pa.array(start - base), pa.array(end - start), pa.array(period)],
                ["start", "length", "period"],
            ),
        )
        edges = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, end, -1)
        dropped = np.cumsum(edges[:-1]) > 0
        collapsed = joined_words(data, words, ~dropped)
        yield pa.StructArray.from_arrays(
            [pa.array(words.counts.astype(np.int64)), runs, collapsed],
            ["n_words", "runs", "collapsed"],
        )


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
PERIODIC = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def detect(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """`docs` with the struct `into`: n_words, runs (start, length, period in words, by start and
    then period) and collapsed, the words that no run repeats joined by one space.

    Words are what stands between ASCII blanks. A run is a stretch with smallest period q and at
    least max(6, 4q) words that cannot be widened; all of it but the first q words is a repeat.
    Null and empty texts have no words, no runs and an empty collapsed text. Rows are answered one
    by one, repeated ones too; other columns stay, one named `into` (in any case) is replaced.
    """
    others = [c for c in docs.columns if c.lower() != into.lower()]
    place = others.index(text)
    frame = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*frame.schema.fields, T.StructField(into, PERIODIC)])

    def run(batches):
        for batch in batches:
            at = 0
            for found in _answers(batch.column(place)):
                rows = batch.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays([*rows.columns, found], [*others, into])

    return frame.mapInArrow(run, schema)
