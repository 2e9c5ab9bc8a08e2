"""Sentiment of a text in [-1, 1] from a word lexicon and rules about the words around."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.select import let
from postloom.functions.text import is_blank, words
from postloom.operators.rules import (
    AFTER_BUT,
    BEFORE_BUT,
    CAPS,
    DAMP,
    EDGE_MARKS,
    EXCLAIM,
    EXCLAIM_MAX,
    LOWER,
    NEGATE,
    NORMALIZE,
    QUESTION,
    QUESTION_MAX,
    Rules,
)
from postloom.operators.tokens import FOUND, constant_map, token_lookup

SCORE = "sentiment_score"

# A token that is one edge mark and a word of two or more characters without punctuation.
_MARKS = "|".join(re.escape(m) for m in sorted(EDGE_MARKS, key=len, reverse=True))
_WORD = r"[^\p{Punct}]{2,}"
EDGE = rf"^(?:(?:{_MARKS})({_WORD})|({_WORD})(?:{_MARKS}))$"


def sentiment_words(text: Column) -> Column:
    """Tokens of two or more characters, one edge mark taken off; emoticons stay whole."""
    kept = F.filter(words(text), lambda w: F.length(w) > 1)
    return F.transform(
        kept,
        # Most tokens hold no mark at their ends; those skip the pattern.
        lambda w: F.when(
            w.rlike(r"^\p{Punct}|\p{Punct}$"), F.regexp_replace(w, EDGE, "$1$2")
        ).otherwise(w),
    )


def _one_of(c: Column, values) -> Column:
    return F.coalesce(c.isin(sorted(values)), F.lit(False)) if values else F.lit(False)


def _value_of(c: Column, table: dict) -> Column:
    """The table's value for c, null where it has none; equal values share one membership test."""
    result = F.lit(None).cast("double")
    for value in sorted(set(table.values())):
        names = [k for k, v in table.items() if v == value]
        result = F.when(_one_of(c, names), F.lit(float(value))).otherwise(result)
    return result


def _negated(lower: Column, rules: Rules) -> Column:
    return _one_of(lower, rules.negations) | F.coalesce(lower.contains("n't"), F.lit(False))


def _upper(word: Column, lower: Column) -> Column:
    return F.coalesce((word != lower) & (word == F.upper(word)), F.lit(False))


def _near(c: Column, value: Column, k: int, caps_differ: Column) -> Column:
    """Valence after the word k places before: its boost, then what negates or intensifies."""
    word, lower = c[f"w{k}"], c[f"l{k}"]
    toward = F.when(value < 0, -1.0).otherwise(1.0)
    away = F.when(value > 0, CAPS).otherwise(-CAPS)
    shouted = F.when(_upper(word, lower) & caps_differ, away).otherwise(0.0)
    boost = (F.get(c["boosts"], k - 1) * toward + shouted) * DAMP[k]
    boost = F.coalesce(boost, F.lit(0.0))

    factor = F.when(F.get(c["negated"], k - 1), NEGATE).otherwise(1.0)
    if k > 1:
        so = lambda j: _one_of(c[f"w{j}"], ["so", "this"])
        never = _one_of(word, ["never"]) & so(k - 1)
        if k == 2:
            factor = F.when(never, 1.5).otherwise(factor)
        else:
            factor = F.when(never | so(1), 1.25).otherwise(factor)
    return F.when(c[f"on{k}"], (value + boost) * factor).otherwise(value)


def _idiom(c: Column, before: Column, rules: Rules) -> Column:
    """Valence after idioms around the word; only where three words precede it."""
    phrase = lambda *names: F.concat(*_spaced(c[n] for n in names))
    # Later in the text wins; of the phrases that end here or before, the first listed.
    phrases = [
        phrase("w0", "n1", "n2"), phrase("w0", "n1"),
        phrase("w1", "w0"), phrase("w2", "w1", "w0"), phrase("w2", "w1"),
        phrase("w3", "w2", "w1"), phrase("w3", "w2"),
    ]
    known = constant_map({k: float(v) for k, v in rules.idioms.items()})
    value = F.coalesce(*[known(p) for p in phrases], before)
    pairs = [k for k in rules.boosters if " " in k]
    soft = _one_of(phrase("w3", "w2"), pairs) | _one_of(phrase("w2", "w1"), pairs)
    return F.when(c["on3"], value + F.when(soft, LOWER).otherwise(0.0)).otherwise(before)


def _may_hold_phrase(words_: Column, rules: Rules) -> Column:
    """Whether any phrase may be in the text at all: most texts skip the phrase step. Runs of two
    words are looked up by the first two words of the phrases, and only those that begin as a phrase
    does, so a word costs one look-up however many phrases there are."""
    phrases = [*rules.idioms, *(k for k in rules.boosters if " " in k)]
    starts = constant_map({" ".join(p.split(" ")[:2]): True for p in phrases}, "boolean")
    first = {p.split(" ")[0] for p in phrases}
    runs = F.zip_with(
        words_,
        F.slice(words_, 2, F.size(words_)),
        lambda a, b: _one_of(a, first) & starts(F.concat_ws(" ", a, b)).isNotNull(),
    )
    return F.exists(runs, lambda hit: hit)


def _spaced(columns):
    joined = []
    for c in columns:
        joined += [F.lit(" "), c] if joined else [c]
    return joined


def _least(c: Column, value: Column) -> Column:
    """Valence after "least", unless it is "at least" or "very least"."""
    hit = c["on1"] & _one_of(c["l1"], ["least"]) & ~_one_of(c["l2"], ["at", "very"])
    return value * F.when(hit, NEGATE).otherwise(1.0)


def _through(value: Column, steps) -> Column:
    """The value after each step in turn, each computed once."""
    if len(steps) == 1:
        return steps[0](value)
    return let(steps[0](value), lambda changed: _through(changed, steps[1:]))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of a score."""
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    asked = count("?")
    return F.least(count("!"), F.lit(EXCLAIM_MAX)) * EXCLAIM + F.when(asked < 2, 0.0).when(
        asked < 4, asked * QUESTION
    ).otherwise(QUESTION_MAX)


def _stressed(total: Column, text: Column) -> Column:
    return total + F.signum(total) * emphasis(text)


def normalized(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + NORMALIZE), 4)


def score(
    posts: DataFrame,
    lexicon: DataFrame,
    text: str = "translated_post_content",
    out: str = SCORE,
    rules: Rules | None = None,
    inline: bool | None = None,
) -> DataFrame:
    """Adds `out`: null for blank text, 0.0 where no word counts, else a score to 4 decimals.

    `lexicon` is (token, valence). A token that occurs again counts with the surroundings of its
    first occurrence. With a lexicon of ordinary size the whole score is one projection.
    """
    rules = rules or Rules()

    def scored(w, lo, v):
        return valence_sum(w, lo, v, rules)

    return _with_score(posts, lexicon, text, out, inline, scored, stressed=True)


def _with_score(posts, lexicon, text, out, inline, total, stressed) -> DataFrame:
    """Adds the normalised `total(words, lower-cased words, values)` of each text."""
    words_ = sentiment_words(F.col(text))
    lower = F.transform(words_, F.lower)
    # After a join the words are made again; only the text moves with its row.
    found, values = token_lookup(
        posts, lower, lexicon, "token", "valence", inline, text=F.col(text)
    )
    found = found.withColumn(
        "_sum",
        let(
            words_,
            lambda w: let(
                F.transform(w, F.lower),
                lambda lo: let(values(lo), lambda v: total(w, lo, v)),
            ),
        ),
    )
    summed = _stressed(F.col("_sum"), F.col(text)) if stressed else F.col("_sum")
    return found.withColumn(out, F.when(~is_blank(F.col(text)), normalized(summed))).drop(
        FOUND, "_sum"
    )


def first_places(hits: Column, w: Column) -> Column:
    """For each hit, in order, a struct of its place and the place of its word's first hit. Hits
    are sorted by word and each run of a word is one slice, so the work grows as a sort."""

    def grouped(s):
        changes = F.filter(
            F.transform(s, lambda e, k: F.when((k == 0) | (e["word"] != F.get(s, k - 1)["word"]), k)),
            lambda k: k.isNotNull(),
        )

        def runs(starts):
            def run(at, k):
                end = F.coalesce(F.get(starts, k + 1), F.size(s))
                return F.transform(
                    F.slice(s, at + 1, end - at),
                    lambda e: F.struct(e["i"].alias("i"), F.get(s, at)["i"].alias("first")),
                )

            return F.array_sort(F.flatten(F.transform(starts, run)))

        return let(changes, runs)

    pairs = F.transform(hits, lambda i: F.struct(F.get(w, i).alias("word"), i.alias("i")))
    return let(F.array_sort(pairs), grouped)


def valence_sum(w: Column, lo: Column, v: Column, rules: Rules) -> Column:
    """Sum of the valences of a text's words, each changed by the words around it.

    `w`, `lo` and `v` are its words, their lower case and their lexicon values, aligned.
    """

    def counts(i):
        return F.get(v, i).isNotNull() & ~_one_of(F.get(lo, i), rules.boosters)

    def total(row):
        hits, but = row["hits"], row["but"]
        caps = (row["shouted"] > 0) & (row["shouted"] < F.size(w))

        def place(i, k):
            first = F.get(row["firsts"], k)["first"]
            weight = F.when(but < 0, 1.0).when(i < but, BEFORE_BUT).when(i > but, AFTER_BUT)
            return F.struct(
                first.alias("at"),
                F.coalesce(weight, F.lit(1.0)).alias("weight"),
            )

        def around(p):
            at = p["at"]
            before = F.array(*[F.get(lo, at - k) for k in (1, 2, 3)])
            kind_of = (F.get(lo, at) == "kind") & _one_of(F.get(lo, at + 1), ["of"])
            return F.struct(
                F.when(kind_of, 0.0).otherwise(p["weight"]).alias("weight"),
                F.get(v, at).cast("double").alias("v"),
                *[F.get(w, at - k).alias(f"w{k}") for k in range(4)],
                *[F.get(lo, at - k).alias(f"l{k}") for k in range(4)],
                *[
                    ((at >= k) & F.get(v, at - k).isNull()).alias(f"on{k}")
                    for k in (1, 2, 3)
                ],
                *[F.get(w, at + k).alias(f"n{k}") for k in (1, 2)],
                F.transform(before, lambda x: _value_of(x, rules.boosters)).alias("boosts"),
                F.transform(before, lambda x: _negated(x, rules)).alias("negated"),
            )

        def valence(c):
            louder = F.when(c["v"] > 0, CAPS).otherwise(-CAPS)
            shout = F.when(_upper(c["w0"], c["l0"]) & caps, louder).otherwise(0.0)
            steps = [
                lambda x: x + shout,
                *[lambda x, k=k: _near(c, x, k, caps) for k in (1, 2, 3)],
                lambda x: F.when(row["idiom"], _idiom(c, x, rules)).otherwise(x),
                lambda x: _least(c, x),
            ]
            return _through(c["v"], steps)

        words_around = F.transform(F.transform(hits, place), around)
        return F.aggregate(
            words_around, F.lit(0.0), lambda acc, c: acc + valence(c) * c["weight"]
        )

    def described(hits):
        return let(
            F.struct(
                hits.alias("hits"),
                first_places(hits, w).alias("firsts"),
                (F.array_position(lo, rules.contrast) - 1).cast("int").alias("but"),
                F.size(F.filter(F.zip_with(w, lo, _upper), lambda up: up)).alias("shouted"),
                _may_hold_phrase(w, rules).alias("idiom"),
            ),
            total,
        )

    positions = F.filter(F.transform(v, lambda _, i: i), counts)
    return let(positions, lambda hits: F.when(F.size(hits) == 0, 0.0).otherwise(described(hits)))


def lexicon_sum(
    posts: DataFrame,
    lexicon: DataFrame,
    text: str = "translated_post_content",
    out: str = SCORE,
    inline: bool | None = None,
) -> DataFrame:
    """The lexicon alone: sum of valences of lower-cased tokens, normalised. No rules."""

    def plain(w, lo, v):
        return F.aggregate(
            v, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
        )

    return _with_score(posts, lexicon, text, out, inline, plain, stressed=False)
