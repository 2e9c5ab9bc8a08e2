import hashlib
import random
import re
from collections import Counter

from helpers import SF, documents

import __spark_entry__ as entry
from postloom.llm import lempel_ziv


def plain(texts, window):
    """[(n_words, spans, kept)] by counting the windows themselves."""
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(r[i : i + window]) for r in rows for i in range(len(r) - window + 1))
    out = []
    for r in rows:
        gone = set()
        for i in range(len(r) - window + 1):
            if counts[tuple(r[i : i + window])] > 1:
                gone.update(range(i, i + window))
        starts = sorted(i for i in gone if i - 1 not in gone)
        ends = sorted(i + 1 for i in gone if i + 1 not in gone)
        out.append((len(r), list(zip(starts, ends)), " ".join(w for i, w in enumerate(r) if i not in gone)))
    return out


def check(spark, texts, **options):
    docs = documents(spark, texts).select("*", lempel_ziv.text_key("text").alias("key"))
    found = lempel_ziv.repeated_stretches(docs.drop("key"), **options)
    rows = docs.select("doc_id", "key").join(found, "key").collect()
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], r.kept) for r in rows}
    want = plain(texts, options.get("window", lempel_ziv.WINDOW))
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


def some_texts(seed, n):
    """Random words with shared passages, edited copies, periods and exact copies."""
    rnd = random.Random(seed)
    prose = lambda k: [f"w{rnd.randrange(500)}" for _ in range(k)]
    passages = [prose(rnd.choice([20, 34, 35, 36, 50, 120])) for _ in range(8)]
    texts = []
    for _ in range(n):
        words = prose(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            passage = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                passage[rnd.randrange(len(passage))] = "edit"
            a = rnd.randrange(len(passage))
            words += passage[a:] if rnd.random() < 0.3 else passage
            words += prose(rnd.choice([0, 0, 3, 40]))
        if rnd.random() < 0.1:
            words += prose(rnd.choice([1, 2, 7, 40])) * 6
        texts.append(" ".join(words))
        if rnd.random() < 0.1:
            texts.append(texts[-1])
        elif rnd.random() < 0.1:
            texts.append(rnd.choice(texts) + " and more")
    return texts


def test_random_texts_against_brute_force(spark):
    check(spark, some_texts(1, 300))


def test_hot_anchors_are_spread(spark):
    check(spark, some_texts(2, 150), rows_per_task=5)


def test_other_windows(spark):
    check(spark, some_texts(3, 100), window=12, gram=4)
    check(spark, some_texts(4, 60), window=9, gram=9)


def test_few_different_words(spark):
    rnd = random.Random(9)
    check(spark, [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(200))) for _ in range(60)], window=10, gram=3)


def test_null_empty_short_and_repeated_texts(spark):
    w = " ".join(f"w{i}" for i in range(35))
    check(spark, [None, "", None, " \n", "short", "short", w, w, w + " x", "x " + w, w[3:], "a " * 35, "b " * 36])


def test_a_window_that_only_two_later_texts_share(spark):
    head = [f"h{i}" for i in range(30)]
    tails = [[f"t{k}-{i}" for i in range(40)] for k in (0, 1, 1, 2)]
    check(spark, [" ".join(head + t + [f"end{i}"]) for i, t in enumerate(tails)])


def test_very_long_text(spark):
    rnd = random.Random(3)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(200_000)]
    check(spark, [" ".join(long), " ".join(long[1000:1100]), " ".join(long[150_000:] + long[:40])])


def test_empty_table(spark):
    assert lempel_ziv.repeated_stretches(documents(spark, ["x"]).where("false")).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in entry.queries()["op11_substring_dedup"](spark, SF).collect()}
    assert len(found) == len(docs)
    for doc, (n, spans, kept) in zip(docs, plain([d.text for d in docs], 35)):
        row = found[doc.doc_id]
        assert (row.n_words, row.n_removed) == (n, sum(b - a for a, b in spans))
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed > 0 for r in found.values()) > 5
