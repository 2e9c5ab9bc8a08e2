import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions.margins import margin, softmax
from postloom.operators import translate as tr
from postloom.operators.models import margin_2class, margin_3class, model_score
from postloom.operators.rules import Rules
from postloom.operators.sentiment import first_places, lexicon_sum, score
from postloom.operators.tokens import token_values

LEXICON = {
    "good": 1.9, "bad": -2.5, "great": 3.1, "happy": 2.7, "shit": -2.6, "like": 1.5,
    "death": -2.9, "kiss": 1.8, "kind": 2.4, "smart": 1.7, "horrible": -2.5, "very": 0.5, ":)": 2.0,
}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, x string")


def scores(df, lexicon, **options):
    got = score(df, lexicon, "x", **options).orderBy("id").collect()
    return [r["sentiment_score"] for r in got]


def brute(text):
    """The published rules, straight from their description, one text at a time."""
    if text is None or not text.strip():
        return None
    rules = Rules()
    marks = sorted(
        '. ! ? , ; : - \' " !! !!! ?? ??? ?!? !?! ?!?! !?!?'.split(), key=len, reverse=True
    )
    punctuation = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def bare(token):
        for mark in marks:
            for rest in (
                token[len(mark):] if token.startswith(mark) else "",
                token[: -len(mark)] if token.endswith(mark) else "",
            ):
                if len(rest) > 1 and not punctuation & set(rest):
                    return rest
        return token

    w = [bare(t) for t in text.split() if len(t) > 1]
    lo = [x.lower() for x in w]
    up = [x.isupper() for x in w]
    caps = 0 < sum(up) < len(w)

    def negates(word):
        return word in rules.negations or "n't" in word

    def one(i):
        if lo[i] in rules.boosters or lo[i] not in LEXICON:
            return 0.0
        if lo[i] == "kind" and i + 1 < len(w) and lo[i + 1] == "of":
            return 0.0
        v = LEXICON[lo[i]]
        if up[i] and caps:
            v += 0.733 if v > 0 else -0.733
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            j = i - k
            if j < 0 or lo[j] in LEXICON:
                continue
            s = rules.boosters.get(lo[j], 0.0)
            if s:
                s = -s if v < 0 else s
                if up[j] and caps:
                    s += 0.733 if v > 0 else -0.733
            v += s * damp
            if k == 2 and w[j] == "never" and w[i - 1] in ("so", "this"):
                v *= 1.5
            elif k == 3 and (
                (w[j] == "never" and w[i - 2] in ("so", "this")) or w[i - 1] in ("so", "this")
            ):
                v *= 1.25
            elif negates(lo[j]):
                v *= -0.74
            if k == 3:
                v = phrase(i, v)
        if i > 0 and lo[i - 1] == "least" and "least" not in LEXICON:
            if i == 1 or lo[i - 2] not in ("at", "very"):
                v *= -0.74
        return v

    def phrase(i, v):
        spans = [(i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2)]
        for a, b in spans:
            known = rules.idioms.get(" ".join(w[a : b + 1]))
            if known is not None:
                v = known
                break
        for b in (i + 1, i + 2):
            if b < len(w):
                v = rules.idioms.get(" ".join(w[i : b + 1]), v)
        if {" ".join(w[i - 3 : i - 1]), " ".join(w[i - 2 : i])} & set(rules.boosters):
            v -= 0.293
        return v

    at = lo.index("but") if "but" in lo else None
    total = 0.0
    for i, word in enumerate(w):
        v = one(w.index(word))
        total += v if at is None or i == at else v * 0.5 if i < at else v * 1.5
    asked = text.count("?")
    loud = min(text.count("!"), 4) * 0.292
    loud += 0 if asked < 2 else asked * 0.18 if asked < 4 else 0.96
    total += loud if total > 0 else -loud if total < 0 else 0
    return round(total / math.sqrt(total * total + 15), 4)


SENTENCES = [
    "smart, handsome, and good!", "not good", "not very good", "The food is GOOD but bad",
    "never so good", "it was never so very good", "kind of bad", "that was kind of bad", "least good",
    "it was at least good", "it was the very least good", None, "", " \n\t", "nothing here",
    "good good not good", "a kiss of death is bad", "that is the shit", "I like it?? yes??",
    "It isn't that good", "good!!!! :)", "so GOOD", "VERY good day", "not REALLY that good",
    "extremely bad day", "barely good", "sort of good really", "it is sort of good",
    "I am so this good", "never this good", "without any good", "good, bad? great!!!", "'good'",
    "kind people are kind of kind", "BAD", "bad BUT good but great", "yeah right this is great",
    "a bad ass day is good", "a b c", "good bad", "???", "cut the mustard is good ok", "(good)",
    "a very happy and HORRIBLE day!!!!!", "can't be good", "nor good nor bad", "great?!? great?",
]


def test_compound_against_the_rules(spark, lexicon):
    want = [brute(s) for s in SENTENCES]
    df = texts(spark, SENTENCES)
    assert scores(df, lexicon) == want
    assert scores(df, lexicon, inline=False) == want


def test_compound_on_random_texts(spark, lexicon):
    rng = np.random.default_rng(7)
    vocabulary = (
        list(LEXICON) * 2 + "very not never so this but kind of sort least at the shit bomb GOOD BAD "
        "VERY isn't barely a day. good! bad? great, ok x yeah right BUT hand to mouth".split()
    )
    rows = [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(400)]
    assert scores(texts(spark, rows), lexicon) == [brute(s) for s in rows]


def test_score_bounds_and_row_count(spark, lexicon):
    df = texts(spark, SENTENCES * 3)
    got = score(df, lexicon, "x").collect()
    assert len(got) == len(SENTENCES) * 3
    for row in got:
        blank = row.x is None or not row.x.strip()
        assert (row.sentiment_score is None) == blank
        assert blank or -1 <= row.sentiment_score <= 1


def test_a_long_text_is_scored_whole(spark, lexicon):
    # Far apart in one text of half a million words; a quadratic step would not come back.
    text = "good " + "word " * 500_000 + "not bad"
    only = [brute("good"), None]
    got = scores(texts(spark, [text]), lexicon)
    total = 1.9 + -2.5 * -0.74
    assert got == [round(total / math.sqrt(total * total + 15), 4)] and only[0] is not None


def test_many_hits_in_one_text(spark, lexicon):
    rows = [" ".join(["good", "bad", "the", "great"] * 10_000)]
    total = scores(texts(spark, rows), lexicon)
    assert total == [brute(rows[0])]


def test_scoring_shuffles_nothing(spark, lexicon):
    df = score(spark.range(10).select(F.lit("good day").alias("x")), lexicon, "x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_decimal_lexicon_gives_the_same_scores(spark, lexicon):
    exact = lexicon.select("token", F.col("valence").cast("decimal(10,4)").alias("valence"))
    for inline in (True, False):
        df = texts(spark, SENTENCES)
        assert scores(df, exact, inline=inline) == scores(df, lexicon)


def test_plain_lexicon_sum(spark, lexicon):
    got = lexicon_sum(texts(spark, ["good bad", "x", " ", "GOOD!!"]), lexicon, "x").orderBy("id")
    sum_ = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert [r.sentiment_score for r in got.collect()] == [sum_(-0.6), 0.0, None, sum_(1.9)]


def test_token_values_three_ways(spark):
    table = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "0"), (None, "9")], "token string, v string")
    rows = [["a", "x", "b", "a"], [], ["x"], None, ["b"], ["a", "x", "b", "a"], ["x", "x", "a"]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t array<string>")
    want = [
        [{"a": "0", "b": "2"}.get(t) for t in r] if r is not None else None for r in rows
    ]
    for options in ({"inline": True}, {"inline": False}, {"inline": False, "small": False}):
        got = token_values(df, "t", table, "token", "v", "out", **options).orderBy("id")
        assert [r["out"] for r in got.where("t is not null").collect()] == [w for w in want if w is not None]


# Translation

POSTS = ["hej", "hej", "okänd", None, "", " \n", "bra", "hej"]


@pytest.fixture(scope="module")
def memory(spark):
    return spark.createDataFrame(
        [("hej", "hello"), ("hej", "hi there"), ("bra", "good"), (" ", "blank")],
        "source_text string, target_text string",
    )


@pytest.mark.parametrize("small", [True, False])
def test_memory_hit_miss_and_blank(spark, memory, small):
    got = tr.translate(texts(spark, POSTS), memory, "x", small=small, rows_per_task=1).orderBy("id")
    assert [(r.translated_post_content, r.via) for r in got.collect()] == [
        ("hello", "memory"), ("hello", "memory"), ("okänd", "original"), ("", "blank"),
        ("", "blank"), ("", "blank"), ("good", "memory"), ("hello", "memory"),
    ]


def test_backend_gets_each_missing_text_once(spark, memory):
    asked = spark.sparkContext.accumulator(0)

    def backend():
        def run(batch):
            asked.add(len(batch))
            if "sten" in batch:
                raise ValueError("refused")
            return [t.upper() for t in batch]

        return run

    rows = POSTS + ["sten", "ny", "ny", "sten"]
    got = tr.translate(texts(spark, rows), memory, "x", make_backend=backend).orderBy("id").collect()
    by_text = {r.x: (r.translated_post_content, r.via) for r in got if r.x and r.x.strip()}
    assert by_text == {
        "hej": ("hello", "memory"), "bra": ("good", "memory"), "okänd": ("OKÄND", "backend"),
        "ny": ("NY", "backend"), "sten": ("sten", "original"),
    }
    assert len(got) == len(rows)
    # okänd, ny and sten once, and again one by one where a batch was refused.
    assert asked.value <= 6


def test_dictionary_counts_rows(spark, memory):
    got = tr.dictionary(texts(spark, POSTS), memory, "x").collect()
    assert {r.x: (r.rows, r.translation) for r in got} == {
        "hej": (3, "hello"), "okänd": (1, "okänd"), "bra": (1, "good"),
    }


@pytest.mark.parametrize("inline", [True, False])
def test_glossary(spark, inline):
    glossary = spark.createDataFrame([("det", "it"), ("är", "is")], "token string, target string")
    rows = ["Det  är\nbra", "inget", None, " ", "det det"]
    got = tr.glossary_translate(texts(spark, rows), glossary, "x", inline=inline).orderBy("id")
    assert [r.translated_post_content for r in got.collect()] == ["it is bra", "inget", "", "", "it it"]


# Margins and models


def test_margins(spark):
    rows = [[0.0, 0.0], [1000.0, -1000.0], [1.0, 2.0], None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, l array<float>")
    got = [r.m for r in df.select("id", margin_2class(F.col("l")).alias("m")).orderBy("id").collect()]
    assert got[:2] == [0.0, -1.0] and got[3] is None
    assert got[2] == pytest.approx((math.e**2 - math.e) / (math.e**2 + math.e))
    three = spark.createDataFrame([([0.0, 0.0, 0.0],), ([-5.0, 100.0, 5.0],)], "l array<float>")
    for row in three.select(margin_3class(F.col("l")).alias("m")).collect():
        assert -1 <= row.m <= 1


def test_margin_does_not_change_when_logits_shift(spark):
    df = spark.createDataFrame([([0.5, -1.5, 2.0],)], "l array<double>")
    shifted = F.transform("l", lambda x: x + 300)
    a, b, total = df.select(
        margin(F.col("l"), 2, 0), margin(shifted, 2, 0),
        F.aggregate(softmax(F.col("l")), F.lit(0.0), lambda acc, x: acc + x),
    ).first()
    assert a == pytest.approx(b) and total == pytest.approx(1)


def test_model_score(spark):
    def load():
        def predict(batch):
            hit = np.array(["good" in t for t in batch], dtype=np.float32)
            return np.stack([1 - hit, hit], axis=1)

        return predict

    got = model_score(texts(spark, ["good", "bad", None, " "]), load, 1, 0, "x").orderBy("id").collect()
    m = (math.e - 1) / (math.e + 1)
    assert [r.sentiment_score for r in got] == [pytest.approx(m), pytest.approx(-m), None, None]


def test_first_places_of_repeated_words(spark):
    words = ["b", "a", "b", "c", "a", "b", "d"]
    hits = [0, 1, 2, 4, 5, 6]
    df = spark.createDataFrame([(words, hits), (words, [])], "w array<string>, hits array<int>")
    got = [
        [(p.i, p.first) for p in r.f]
        for r in df.select(first_places(F.col("hits"), F.col("w")).alias("f")).collect()
    ]
    assert got == [[(i, words.index(words[i])) for i in hits], []]


def test_memory_is_not_shuffled_and_a_new_session_goes_on_with_it(spark, tmp_path):
    from postloom.operators.memory import Memory, one_per_print, translate_by_memory

    asked = spark.sparkContext.accumulator(0)

    def backend():
        def run(texts):
            asked.add(len(texts))
            return [None if "no" in t else t.upper() for t in texts]

        return run

    path = str(tmp_path / "memory")
    posts = spark.createDataFrame(
        [(1, "one"), (2, "two"), (3, "one"), (4, " "), (5, None), (6, "say no")], "id long, post_content string"
    )

    def run(rows):
        found = translate_by_memory(rows, Memory(spark, path, 4), make_backend=backend)
        return {r.id: (r.translated_post_content, r.via) for r in found.collect()}

    assert run(posts.where("id = 1")) == {1: ("ONE", "backend")}
    assert asked.value == 1
    spark.sql(f"DROP TABLE {Memory(spark, path, 4).name}")  # as a new session, which knows no table
    want = {
        1: ("ONE", "memory"), 2: ("TWO", "backend"), 3: ("ONE", "memory"), 4: ("", "blank"),
        5: ("", "blank"), 6: ("say no", "original"),
    }
    assert run(posts) == want
    assert asked.value == 3
    want[2] = ("TWO", "memory")
    assert run(posts) == want and asked.value == 4  # the refused text alone
    texts = one_per_print(posts, "post_content")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = Memory(spark, path, 4).lookup(texts, "post_content")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    # The one exchange is that of the distinct texts.
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_a_token_filter_loses_nothing_and_lets_few_strangers_through(spark):
    from postloom.operators.tokens import token_filter

    table = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("token"))
    maybe = token_filter(table.unionByName(spark.sql("select null as token")), "token")
    seen = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("t"))
    assert table.where(maybe(F.col("token"))).count() == 3000
    assert 3000 <= seen.where(maybe(F.col("t"))).count() < 3000 + 270
    nothing = token_filter(table.where("false"), "token")
    assert seen.where(nothing(F.col("t"))).count() == 0


def test_only_hits_are_shuffled_for_a_table_beyond_broadcast(spark):
    from postloom.operators.tokens import one_per_token, token_filter, token_hits

    texts = spark.range(200).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("w"), i + F.col("id") * 50)).alias("tokens")
    )
    table = spark.createDataFrame([(f"w{i}", float(i)) for i in range(0, 10_000, 100)], "token string, value double")
    hits = token_hits(texts, "tokens", table, "token", "value", small=False)
    assert hits.count() == 99
    # The filter stands before the join, and lets through little more than the hits.
    assert "getbit" in hits._jdf.queryExecution().optimizedPlan().toString()
    before = texts.select(F.posexplode("tokens").alias("pos", "token"))
    maybe = token_filter(one_per_token(table, "token", "value"), "token")
    assert before.count() == 10_000 and 99 <= before.where(maybe(F.col("token"))).count() < 199


def test_score_does_not_slow_with_the_number_of_idioms(spark):
    posts = spark.createDataFrame([(1, "this is the bomb and good"), (2, "not a thing good")], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bomb", -1.0)], "token string, valence double")
    few = Rules()
    many = Rules(idioms={**few.idioms, **{f"made up {i}": 1.0 for i in range(20_000)}})
    scores = [
        [r[0] for r in score(posts, lexicon, "t", rules=r).orderBy("id").select("sentiment_score").collect()]
        for r in (few, many)
    ]
    assert scores[0] == scores[1] and scores[0][0] > 0


def test_texts_are_moved_by_their_prints(spark):
    posts = texts(spark, ["ja", "ja", "nej", " ", None])
    plan = tr.distinct_texts(posts, "x")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(_print" in plan and "hashpartitioning(x" not in plan
    rows = [(r.x, r.rows) for r in tr.distinct_texts(posts, "x").collect()]
    assert sorted(rows) == [("ja", 2), ("nej", 1)]


def test_a_joined_score_makes_the_words_twice_and_keys_rows_by_their_text(spark, lexicon):
    """Once for the tokens that are joined, once where the score is taken."""
    posts = texts(spark, [*SENTENCES, *SENTENCES[:2], None, " \n", "　"])
    found = score(posts, lexicon, "x", inline=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2, plan
    inline = score(posts, lexicon, "x", inline=True)
    assert found.exceptAll(inline).isEmpty() and inline.exceptAll(found).isEmpty()


def test_without_a_backend_rows_meet_the_memory_in_one_join(spark, memory):
    import os

    from postloom.sources.scratch import shared_dir

    posts = texts(spark, POSTS * 3)
    place = shared_dir(spark).removeprefix("file:") + "/postloom"
    made = lambda: {f for f in os.listdir(place) if f.startswith("dictionary-")} if os.path.isdir(place) else set()
    before = made()
    large = tr.translate(posts, memory, "x", small=False, rows_per_task=2)
    assert made() == before
    small = tr.translate(posts, memory, "x", small=True)
    assert large.columns == small.columns
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


@pytest.mark.parametrize("inline", [True, False])
def test_a_glossary_makes_the_tokens_once(spark, inline):
    glossary = spark.createDataFrame([("hej", "hello"), ("ja", "yes")], "token string, target string")
    posts = texts(spark, ["Hej  du", "ja\nja", "nej  ja ", None, " ", "inget  alls"])
    found = tr.glossary_translate(posts, glossary, "x", inline=inline, known="hit")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Joined, once more for the tokens that meet the glossary.
    assert plan.count("split(") == (1 if inline else 2), plan
    assert [(r[tr.TRANSLATED], r.hit) for r in found.orderBy("id").collect()] == [
        ("hello du", True), ("yes yes", True), ("nej yes", True), ("", False), ("", False), ("inget alls", False),
    ]


def test_a_backend_is_sent_batches_of_bounded_size(spark, tmp_path):
    """Of rows and of bytes, whatever the partition holds; the session's setting comes back."""
    from collections.abc import Iterator

    import pandas as pd

    names = list(tr.BATCH_LIMITS)
    before = [spark.conf.get(n) for n in names]
    sizes = spark.sparkContext.accumulator(0)
    posts = spark.range(0, 3000, numPartitions=1).select("id", F.concat(F.lit("t"), "id").alias("x"))

    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            sizes.add(1)
            yield pd.Series([len(s)] * len(s))

    size = F.pandas_udf(batches, "int")
    with tr.bounded_batches(spark):
        rows = posts.select(size("x").alias("n")).collect()
        long_ = posts.select(size(F.repeat("x", 10_000)).alias("n")).collect()
    assert max(r.n for r in rows) <= tr.BATCH_LIMITS[names[0]]
    assert max(r.n for r in long_) <= 200
    assert [spark.conf.get(n) for n in names] == before

    def backend():
        def run(asked):
            if len(asked) > 64 or "t7" in asked:
                raise ValueError("refused")
            return [t.upper() for t in asked]

        return run

    answers = posts.select("id", tr.backend_udf(backend)(F.when(F.col("id") % 5 < 3, F.col("x"))).alias("a"))
    want = [None if i % 5 > 2 or i == 7 else f"T{i}" for i in range(3000)]
    assert [r.a for r in answers.orderBy("id").collect()] == want
