"""Licence notices in documents, found by winnowed fingerprints and measured by alignment.

Every run of `gram` words of a template has a hash; of each `window` neighbouring hashes the
least is a fingerprint. An inverted index leads from fingerprints to (template, place). Texts are
winnowed the same way, so a shared run of gram + window - 1 words always shares a fingerprint.
Of a template of fewer than `short` words every pair of neighbouring words is indexed, and looked
for at every place of a text.
Each shared one proposes that the template starts at a certain word of the text. Around each
proposal the template is aligned with the text inside a band of `band` words to either side, or
half the template where that is less. The words that tell licences apart must be among the matched.
"""

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.license_texts import COMMON, HARMLESS, NOTICES, TELLING
from postloom.llm.words import ALNUM, LOWER, find_words, hash_words, shingles, text_pieces


@dataclass(frozen=True)
class Settings:
    """`least` is the share of a template's words that must be matched."""

    gram: int = 3
    window: int = 3
    band: int = 8
    least: float = 0.8
    short: int = 20


def winnow(values: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the text) of each fingerprint: a hash that is the least, the rightmost of
    equal ones, of some `window` neighbours. A text of fewer hashes has its least one."""
    n, counts = len(values), np.diff(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(first[:-1], counts)
    left = np.repeat(counts, counts) - place  # hashes from here to the text's end
    best, at = values.copy(), np.arange(n)
    for i in range(1, window):
        ahead = np.minimum(np.arange(n) + i, n - 1)
        better = (left > i) & (values[ahead] <= best)
        best[better], at[better] = values[ahead][better], ahead[better]
    # A window starts where it fits, or at the start of a shorter text.
    starts = (left >= window) | (place == 0)
    chosen = np.unique(at[starts])
    return text[chosen], place[chosen]


class Index:
    """Templates as word hashes, and where their fingerprints stand."""

    def __init__(self, templates: list[tuple[str, str]], settings: Settings):
        self.settings, self.names, self.words = settings, [], []
        places, pairs = defaultdict(list), defaultdict(list)
        telling = sorted((_words(t) for t in TELLING), key=len, reverse=True)
        common = set(_words(COMMON))
        self.harmless, self.telling = set(_words(HARMLESS)), []
        for name, text in templates:
            for data, words, hashes in hashed_words(pa.array([text], pa.string())):
                if not len(hashes):
                    continue
                number = len(self.names)
                self.names.append(name)
                self.words.append(hashes)
                own = hashes.tolist()
                self.telling.append(_telling_runs(own, telling))
                if len(own) < settings.short:
                    for place, value in enumerate(shingles(hashes, words.first, 2)[0].tolist()):
                        if not common.issuperset(own[place : place + 2]):
                            pairs[value].append((number, place))
                    continue
                values, first = shingles(hashes, words.first, settings.gram)
                for place in winnow(values, first, settings.window)[1].tolist():
                    places[int(values[place])].append((number, place))
        self.fingerprints = np.array(sorted(places), np.uint64)
        self.places = [places[f] for f in self.fingerprints.tolist()]
        self.pairs = np.array(sorted(pairs), np.uint64)
        self.pair_places = [pairs[f] for f in self.pairs.tolist()]

    def told(self, template: int, text: list[int]) -> bool:
        """Whether the telling runs of the template are in the matched words of a text."""
        own = self.words[template].tolist()
        return all(
            any(
                text[at : at + b - a] == own[a:b]
                and self._beside(own[:a][::-1], text[:at][::-1])
                and self._beside(own[b:], text[at + b - a :])
                for at in range(len(text) - (b - a) + 1)
            )
            for a, b in self.telling[template]
        )

    def _beside(self, own: list[int], text: list[int]) -> bool:
        """No word but harmless ones is put in before the template's next word. Another word may
        stand in its place."""
        if not own or not text or own[0] == text[0] or own[1:2] == text[1:2] != []:
            return True
        near = text[:4]
        return own[0] not in near or self.harmless.issuperset(near[: near.index(own[0])])


def _words(text: str) -> list[int]:
    return [h for _, _, hashes in hashed_words(pa.array([text], pa.string())) for h in hashes.tolist()]


def _telling_runs(own: list[int], telling: list[list[int]]) -> list[tuple[int, int]]:
    """(place, end) of the first one of each telling run; the longer ones are looked for first."""
    taken, runs = set(), []
    for run in telling:
        for a in range(len(own) - len(run) + 1):
            b = a + len(run)
            if own[a:b] == run:
                if taken.isdisjoint(range(a, b)):
                    runs.append((a, b))
                    taken.update(range(a, b))
                break
    return runs


def hashed_words(texts: pa.Array):
    for _, data, offsets in text_pieces(texts):
        lower = LOWER[data]
        words = find_words(lower, offsets, ALNUM)
        yield data, words, hash_words(lower, words)


def align(template: np.ndarray, text: np.ndarray, start: int, band: int):
    """(matched words, first, end) of the best alignment of the template with the text, where the
    template's word i may only meet words start + i - band to start + i + band. Matches count 2,
    words without a partner cost 1. `first` and `end` are places of matched words of the text."""
    width = 2 * band + 1
    # A state is (score, matches, first matched word, end); cell k stands for word start + i + k - band.
    empty = (0, 0, -1, -1)
    row = [empty] * width
    best = empty
    n = len(text)
    for i in range(len(template)):
        new = []
        for k in range(width):
            at = start + i + k - band
            # The diagonal keeps k; a template word without a partner comes from k + 1 above.
            options = [empty]
            score, matches, first, end = row[k]
            if 0 <= at < n and text[at] == template[i]:
                options.append((score + 2, matches + 1, first if matches else at, at + 1))
            else:
                options.append((score - 2, matches, first, end))
            if k + 1 < width:
                score, matches, first, end = row[k + 1]
                options.append((score - 1, matches, first, end))
            if k:
                score, matches, first, end = new[k - 1]
                options.append((score - 1, matches, first, end))
            cell = max(options)
            new.append(cell)
            if cell > best:
                best = cell
        row = new
    return best[1], best[2], best[3]


def matches_in(words: np.ndarray, shared: list[tuple[int, int]], index: Index):
    """Matches of one text as (template, matched words, first, end), of which no two overlap.

    `shared` has (template, proposed start). Of proposals within a band of each other the middle
    one is aligned. Of overlapping matches the one with more matched words stays."""
    settings, found = index.settings, []
    by_template = defaultdict(set)
    for template, start in shared:
        by_template[template].add(start)
    for template, starts in by_template.items():
        own = index.words[template]
        # Short templates may stand side by side, closer than the band.
        band = min(settings.band, len(own) // 2)
        ordered, group = sorted(starts), []
        for start in [*ordered, None]:
            if group and (start is None or start - group[0] > band):
                n, first, end = align(own, words, group[len(group) // 2], band)
                if n >= settings.least * len(own) and index.told(template, words[first:end].tolist()):
                    found.append((template, n, first, end))
                group = []
            if start is not None:
                group.append(start)
    found.sort(key=lambda m: (-m[1], -m[1] / len(index.words[m[0]]), m[2], m[0]))
    kept, taken = [], []
    for match in found:
        if all(match[3] <= a or match[2] >= b for a, b in taken):
            kept.append(match)
            taken.append((match[2], match[3]))
    return sorted(kept, key=lambda m: m[2])


def scan(
    docs: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = NOTICES,
    settings: Settings | None = None,
) -> DataFrame:
    """(doc, license, template, coverage, first_word, end_word, start, end), one row per match.

    `coverage` is the matched share of the template's words; words are counted from 0, `start`
    and `end` are characters of the text. Null and empty texts match nothing, nor does any text
    where there are no templates. Repeated rows give their matches one by one. Templates are a
    short list that the caller gives; one of a single word is only seen in texts as short, and
    one without words never. Other columns of `docs` are not read.
    """
    settings = settings or Settings()

    def run(batches):
        index = Index(templates, settings)
        for batch in batches:
            rows, at = [], 0
            for data, words, hashes in hashed_words(batch.column(1)):
                rows += [(at + i, *rest) for i, *rest in _piece(data, words, hashes, index)]
                at += len(words.counts)
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.int32()),
                    pa.array(columns[3], pa.float64()),
                    *(pa.array(c, pa.int64()) for c in columns[4:]),
                ],
                ["doc", "license", "template", "coverage", "first_word", "end_word", "start", "end"],
            )

    kind = docs.schema[doc].dataType.simpleString()
    found = docs.select(F.col(doc), F.col(text)).mapInArrow(
        run,
        f"doc {kind}, license string, template int, coverage double, "
        "first_word long, end_word long, start long, end long",
    )
    return found.withColumnRenamed("doc", doc)


def _propose(shared, text, place, value, known: np.ndarray, places):
    if not len(known):
        return
    at = np.searchsorted(known, value)
    at[at == len(known)] = 0
    hits = np.flatnonzero(known[at] == value)
    for t, p, f in zip(text[hits].tolist(), place[hits].tolist(), at[hits].tolist()):
        shared[t] += [(template, p - own) for template, own in places[f]]


def _piece(data, words, hashes, index: Index):
    settings = index.settings
    if not len(hashes):
        return
    shared = defaultdict(list)
    values, first = shingles(hashes, words.first, settings.gram)
    text, place = winnow(values, first, settings.window)
    _propose(shared, text, place, values[first[text] + place], index.fingerprints, index.places)
    values, first = shingles(hashes, words.first, 2)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(values)) - np.repeat(first[:-1], counts)
    _propose(shared, text, place, values, index.pairs, index.pair_places)
    character = None
    for t, proposals in shared.items():
        a, b = words.first[t], words.first[t + 1]
        for template, n, first_word, end_word in matches_in(hashes[a:b], proposals, index):
            if character is None:
                character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            head = character[words.offsets[t]]
            yield (
                t,
                index.names[template],
                template,
                n / len(index.words[template]),
                first_word,
                end_word,
                int(character[words.starts[a + first_word]] - head),
                int(character[words.ends[a + end_word - 1]] - head),
            )

