"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. A document's words are fed
through it; after each word it knows the longest run ending there that some item contains. Runs
that reach `window` words, and whole items of fewer words, are hits.

Words are looked up in bulk first: only stretches in which every neighbouring pair of words also
neighbours in some item can hold a hit of two words or more, so only those are fed through.

Automata are built in tasks and travel to tasks, so their size is bounded: items are dealt to parts
of about `MAX_ITEM_BYTES` of text, an item larger than a sixteenth of that in overlapping pieces, and
each part has an automaton of its own, written as a row of a staged table. A pass over the documents
takes up to `PASS_PARTS` of them along and hashes a text once for all; more parts are more passes,
with a written table between them. The driver holds one pass's automata at a time.
"""

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import (
    ALNUM,
    LOWER,
    find_words,
    free_name,
    hash_words,
    text_pieces,
    thrifty,
)
from postloom.sources.scratch import Workspace, remove, stage

MAX_ITEM_BYTES = 2 << 20
PASS_PARTS = 4
WINDOW = 10


@dataclass
class Growing:
    """The automaton while items are added; states by number, 0 is the empty run."""

    step: list = field(default_factory=lambda: [{}])
    link: list = field(default_factory=lambda: [-1])
    length: list = field(default_factory=lambda: [0])

    def add(self, last: int, word: int) -> int:
        """The state of `last`'s longest run and one more word."""
        step, link, length = self.step, self.link, self.length
        to = step[last].get(word)
        if to is not None and length[to] == length[last] + 1:
            return to
        if to is not None:
            return self._clone(last, word, to)
        new = self._state(length[last] + 1, {})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            to = step[at][word]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, word, to)
        return new

    def _state(self, length: int, step: dict) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _clone(self, at: int, word: int, to: int) -> int:
        """Splits off the runs of `to` that end `at` and one more word."""
        copy = self._state(self.length[at] + 1, dict(self.step[to]))
        self.link[copy] = self.link[to]
        self.link[to] = copy
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = copy
            at = self.link[at]
        return copy


@dataclass
class Automaton:
    """Items as word numbers, in flat arrays; plain values, so that executors need no install.

    The steps from state s are `words[first[s]:first[s + 1]]`, sorted, and lead to `targets`.
    """

    window: int
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place
    pairs: np.ndarray  # sorted codes of neighbouring words
    shortest: int  # words in the shortest possible hit
    first: array
    words: array
    targets: array
    link: array
    length: array
    owners: array  # which of `groups` holds the items of the state's last `window` words
    whole: array  # nearest state up the links that is a short item
    groups: list  # tuples of item names
    short: dict  # state -> [(words, item)] of whole short items

    def step(self, state: int, word: int) -> int:
        """The state that a word leads to, 0 if none."""
        end = self.first[state + 1]
        at = bisect_left(self.words, word, self.first[state], end)
        return self.targets[at] if at < end and self.words[at] == word else 0

    def scan(self, words: list[int], at: int, marks: list, found: set) -> int:
        """Feeds words that stand from place `at`; adds [start, end) of hits to `marks` and items
        to `found`. Returns the longest run seen."""
        state = run = longest = 0
        for place, word in enumerate(words, at):
            to = self.step(state, word)
            while state and not to:
                state = self.link[state]
                run = self.length[state]
                to = self.step(state, word)
            state = to
            run = run + 1 if state else 0
            longest = max(longest, run)
            if run >= self.window:
                marks.append((place + 1 - self.window, place + 1))
                found.update(self.groups[self.owners[state]])
            up = self.whole[state]
            while up:
                for n, name in self.short[up]:
                    if n <= run:
                        marks.append((place + 1 - n, place + 1))
                        found.add(name)
                up = self.whole[self.link[up]]
        return longest


def _packed(grown: Growing, texts: list[tuple[str, list[int]]], window: int) -> dict:
    """The flat arrays of a full automaton, and which items each window stands in."""
    step, link, length = grown.step, grown.link, grown.length
    size = len(step)
    short: dict[int, list] = {}
    ends = []  # (state, name) after each word of an item from its first whole window on
    for name, words in texts:
        state = 0
        for n, word in enumerate(words, 1):
            state = step[state][word]
            if n >= window:
                ends.append((state, name))
        if 0 < len(words) < window:
            short.setdefault(state, []).append((len(words), name))
    # The state up the links that stands for the last `window` words.
    reach, whole = array("i", bytes(4 * size)), array("i", bytes(4 * size))
    for state in sorted(range(1, size), key=length.__getitem__):
        up = link[state]
        reach[state] = reach[up] if length[up] >= window else state
        whole[state] = state if state in short else whole[up]
    items: dict[int, set] = {}
    for state, name in ends:
        items.setdefault(reach[state], set()).add(name)
    number: dict[tuple, int] = {(): 0}
    own = {at: number.setdefault(tuple(sorted(names)), len(number)) for at, names in items.items()}
    order = [sorted(s.items()) for s in step]
    return {
        "first": array("i", np.append(0, np.cumsum([len(s) for s in order])).astype(np.int32).tobytes()),
        "words": array("i", (word for s in order for word, _ in s)),
        "targets": array("i", (to for s in order for _, to in s)),
        "link": array("i", link),
        "length": array("i", length),
        "owners": array("i", (own.get(r, 0) for r in reach)),
        "whole": whole,
        "groups": list(number),
        "short": short,
    }


def build_automaton(items: list[tuple[str, str]], window: int = WINDOW) -> Automaton:
    """From (name, text) items; items without words take no part."""
    hashed = []
    for first, lower, words, hashes in _hashed(pa.array([text for _, text in items], pa.string())):
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:]), first):
            if b > a:
                hashed.append((items[i][0], hashes[a:b]))
    every = np.concatenate([h for _, h in hashed]) if hashed else np.zeros(0, np.uint64)
    vocabulary = np.unique(every)
    numbered = [(name, np.searchsorted(vocabulary, h)) for name, h in hashed]
    codes = [n[:-1] * len(vocabulary) + n[1:] for _, n in numbered]
    pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    shortest = min([window, *(len(n) for _, n in numbered)])
    texts = [(name, n.tolist()) for name, n in numbered]
    grown = Growing()
    for _, words in texts:
        last = 0
        for word in words:
            last = grown.add(last, word)
    return Automaton(window, vocabulary, pairs, shortest, **_packed(grown, texts, window))


def _hashed(texts: pa.Array):
    for first, data, offsets in text_pieces(texts):
        lower = LOWER[data]
        words = find_words(lower, offsets, ALNUM)
        yield first, lower, words, hash_words(lower, words)


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.searchsorted(table, values)
    place[place == len(table)] = 0
    return place, table[place] == values


def _stretches(numbers, known, words, automaton) -> list[tuple[int, int]]:
    """[start, end) of words, within one text, all of whose neighbouring pairs are item pairs."""
    n = len(numbers)
    joined = np.zeros(n, bool)  # word i goes on from word i - 1
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    _, there = _member(
        numbers[both - 1] * len(automaton.vocabulary) + numbers[both], automaton.pairs
    )
    joined[both[there]] = True
    joined[words.first[:-1][words.first[:-1] < n]] = False
    starts = np.flatnonzero(known & ~joined)
    ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
    long = ends - starts >= automaton.shortest
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def find_hits(texts: pa.Array, *machines: Automaton):
    """Per text: words, hits as [start, end) over words, items and the longest run. A text is
    hashed once for all automata."""
    for _, _, words, hashes in _hashed(texts):
        by_text: dict[int, list] = {}
        for machine in machines:
            numbers, known = _member(hashes, machine.vocabulary)
            stretches = _stretches(numbers, known, words, machine)
            owner = np.searchsorted(words.first, [s for s, _ in stretches], "right") - 1
            for text, (a, b) in zip(owner.tolist(), stretches):
                by_text.setdefault(text, []).append((machine, a, numbers[a:b].tolist()))
        for text, (first, end) in enumerate(zip(words.first[:-1], words.first[1:])):
            marks, found, longest = [], set(), 0
            for machine, a, stretch in by_text.get(text, ()):
                longest = max(longest, machine.scan(stretch, a - int(first), marks, found))
            yield int(end - first), merged(marks), found, longest


def merged(spans) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint sorted ones; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut_items(items: DataFrame, window: int, limit: int) -> DataFrame:
    """Items of more than `limit` bytes in pieces of about that size. Pieces overlap by a word less
    than a window, so each window stands whole in one; none is shorter than a window."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) <= limit:
                    names.append(name)
                    texts.append(text)
                    continue
                words = find_words(data, np.array([0, len(data)]), ALNUM)
                n = len(words.starts)
                size = max(window, n * limit // len(data))
                for at in range(0, max(n - window + 1, 1), size):
                    last = min(n, at + size + window - 1) - 1
                    part = data[words.starts[at] : words.ends[last]] if n else data[:0]
                    names.append(name)
                    texts.append(part.tobytes().decode())
            columns = [pa.array(names, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "text"])

    return items.mapInArrow(run, "name string, text string")


def automata(
    items: DataFrame, item: str, text: str, window: int, work: Workspace
) -> tuple[DataFrame, int]:
    """(part, machine) as a staged table, and the number of parts. Equal items are one; items with
    a null name are named by the empty string."""
    items = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")
    ).where("text is not null").distinct()
    pieces = work.stage(_cut_items(items, window, MAX_ITEM_BYTES // 16), "items")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // MAX_ITEM_BYTES) or 1

    def build(key, table):
        rows = sorted(zip(table["name"].to_pylist(), table["text"].to_pylist()))
        machine = pickle.dumps(vars(build_automaton(rows, window)))
        part = pa.array([key[0].as_py()], pa.int32())
        return pa.table({"part": part, "machine": pa.array([machine], pa.binary())})

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)).cast("int"))
    built = dealt.groupBy("part").applyInArrow(build, "part int, machine binary")
    return work.stage(built, "automata"), parts


def passes(machines: DataFrame, parts: int) -> Iterator[Broadcast]:
    """The automata of one pass after the other, as plain values; at least one pass."""
    for at in range(0, parts, PASS_PARTS):
        rows = machines.where(F.col("part").between(at, at + PASS_PARTS - 1)).collect()
        sent = [pickle.loads(r.machine) for r in sorted(rows)]
        yield machines.sparkSession.sparkContext.broadcast(sent)


_REPORT = "n_words long, spans array<struct<start: int, end: int>>, items array<string>, longest int"


def scan_texts(
    texts: DataFrame,
    text: str,
    report: str,
    machines: DataFrame,
    parts: int,
    work: Workspace | None = None,
) -> DataFrame:
    """Adds the struct column `report` to a frame; each pass adds to what the ones before found.
    What lies between two passes is removed when the next is written, the last with `work`."""
    frame = texts.withColumn(report, F.from_json(F.lit(None).cast("string"), _REPORT))
    place, last = frame.columns.index(text), len(frame.columns) - 1
    between = Workspace(texts.sparkSession)
    for number, sent in enumerate(passes(machines, parts)):
        if number:
            frame = between.stage(frame, "scanned")
            for path in between.paths[:-1]:
                remove(between.spark, path)
            del between.paths[:-1]

        def run(batches, sent=sent):
            machines = [Automaton(**m) for m in sent.value]
            for batch in batches:
                reports = []
                before = batch.column(last).to_pylist()
                for old, (n, spans, names, longest) in zip(
                    before, find_hits(batch.column(place), *machines)
                ):
                    if old:
                        spans = merged(spans + [(s["start"], s["end"]) for s in old["spans"]])
                        names = names | set(old["items"])
                        longest = max(longest, old["longest"])
                    spans = [{"start": a, "end": b} for a, b in spans]
                    reports.append(
                        {"n_words": n, "spans": spans, "items": sorted(names), "longest": longest}
                    )
                columns = batch.columns[:last] + [pa.array(reports, batch.schema.field(last).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        frame = frame.mapInArrow(thrifty(run), frame.schema)
    if work:
        work.paths += between.paths
    return frame


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc, n_words, n_hit, n_items, items, spans, longest, contaminated) per row of `docs`.

    Null and empty texts have no words. Repeated rows are answered one by one; items of equal name
    count once. An empty benchmark hits nothing. Columns of `docs` that are not named are not read.
    `longest` counts runs within a piece of an item, see `_cut_items`.
    """
    with Workspace(docs.sparkSession) as work:
        machines, parts = automata(benchmark, item, item_text, window, work)
        frame = docs.select(F.col(doc).alias("_row"), F.col(text).alias("_text"))
        frame = scan_texts(frame, "_text", "_report", machines, parts)
    n_hit = F.aggregate(
        "_report.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )
    return frame.select(
        F.col("_row").alias(doc),
        "_report.n_words",
        n_hit.alias("n_hit"),
        F.size("_report.items").cast("long").alias("n_items"),
        "_report.items",
        "_report.spans",
        "_report.longest",
        (F.size("_report.spans") > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; each goes from its first to its last word."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = find_words(data, np.array([0, len(data)]), ALNUM)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : words.starts[a]].tobytes())
        at = int(words.ends[b - 1])
    kept.append(data[at:].tobytes())
    return b"".join(kept).decode()


def clean_text(text: str, machines: list[Automaton]) -> tuple[str, int, int]:
    """(text without hits, words, words cut), again until no hit is left."""
    total = cut = 0
    while True:
        n, spans, _, _ = next(find_hits(pa.array([text]), *machines))
        total = total or n
        if not spans:
            return text, total, cut
        cut += sum(b - a for a, b in spans)
        text = cut_words(text, spans)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    length: str | None = None,
) -> DataFrame:
    """`docs` with benchmark spans cut from the texts.

    A hit of at least `window` words, or a whole shorter item, is cut out. A document of whose
    words more than `max_coverage` would go is dropped. All other rows and columns stay as they
    are, null and empty texts too; but where `length` names a column, it holds the code points of
    each text that was cut.
    """
    spark = docs.sparkSession
    place = docs.columns.index(text)
    sized = docs.columns.index(length) if length else None
    with Workspace(spark) as work:
        machines, parts = automata(benchmark, item, item_text, window, work)
        if parts > PASS_PARTS:
            return _clean_in_rounds(docs, text, machines, parts, max_coverage, length, work)
        sent = next(passes(machines, parts))

    def run(batches):
        machines = [Automaton(**m) for m in sent.value]
        for batch in batches:
            texts = batch.column(place)
            hit = [i for i, (_, spans, _, _) in enumerate(find_hits(texts, *machines)) if spans]
            if not hit:
                yield batch
                continue
            new, gone = texts.to_pylist(), set()
            sizes = batch.column(sized).to_pylist() if length else []
            for i in hit:
                new[i], n, cut = clean_text(new[i], machines)
                if cut > max_coverage * n:
                    gone.add(i)
                if length:
                    sizes[i] = len(new[i])
            yield _with_texts(batch, place, new, sized, sizes, gone)

    return docs.mapInArrow(thrifty(run), docs.schema)


def _with_texts(batch, place, texts, sized, sizes, gone) -> pa.RecordBatch:
    """The batch with other texts and lengths and without the rows `gone`."""
    columns = list(batch.columns)
    columns[place] = pa.array(texts, columns[place].type)
    if sized is not None:
        columns[sized] = pa.array(sizes, columns[sized].type)
    keep = pa.array([i for i in range(batch.num_rows) if i not in gone], pa.int64())
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).take(keep)


def _clean_in_rounds(docs, text, machines, parts, max_coverage, length, work) -> DataFrame:
    """`decontaminate` for a benchmark of several passes: a round marks the hits of all passes and
    cuts them at once; texts that were cut go round again until nothing is found in them."""
    report, words, lost = (free_name(docs, n) for n in ("_report", "_words", "_lost"))
    place, n = docs.columns.index(text), len(docs.columns)
    sized = docs.columns.index(length) if length else None

    def cutting(batches):
        for batch in batches:
            new = batch.column(place).to_pylist()
            sizes = batch.column(sized).to_pylist() if length else []
            total, cut = (batch.column(n + i).to_pylist() for i in (0, 1))
            gone = set()
            for i, found in enumerate(batch.column(n + 2).to_pylist()):
                spans = [(s["start"], s["end"]) for s in found["spans"]]
                total[i] = total[i] or found["n_words"]
                cut[i] += sum(b - a for a, b in spans)
                new[i] = cut_words(new[i], spans)
                if cut[i] > max_coverage * total[i]:
                    gone.add(i)
                if length:
                    sizes[i] = len(new[i])
            done = _with_texts(batch, place, new, sized, sizes, set())
            columns = done.columns[:n] + [pa.array(total, pa.int64()), pa.array(cut, pa.int64())]
            keep = pa.array([i for i in range(batch.num_rows) if i not in gone], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names).take(keep)

    going = docs.withColumn(words, F.lit(0).cast("long")).withColumn(lost, F.lit(0).cast("long"))
    names, schema = going.columns, going.schema
    finished = []
    while True:
        marked = work.stage(scan_texts(going, text, report, machines, parts, work), "marked")
        hit = F.size(F.col(f"`{report}`.spans")) > 0
        finished.append(marked.where(~hit).select(docs.columns))
        going = work.stage(marked.where(hit).mapInArrow(cutting, schema), "cut")
        if going.isEmpty():
            break
    for more in finished[1:]:
        finished[0] = finished[0].unionByName(more)
    return stage(finished[0], "decontaminated")
