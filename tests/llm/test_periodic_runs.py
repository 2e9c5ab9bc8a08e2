import hashlib
import random
import re
import zlib

import pytest
from helpers import SF, documents

import __spark_entry__ as entry
from postloom.llm import periodic_runs


def plain_runs(words):
    """[(start, length, period)] by every period, one place after the other."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q):
                root = words[start : start + length]
                if not any(root[d:] == root[:-d] for d in range(1, q)):
                    found.add((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def answers(spark, texts):
    rows = periodic_runs.detect(documents(spark, texts)).collect()
    return {r.doc_id: r.periodic for r in rows}


def check(spark, texts):
    found = answers(spark, texts)
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = words_of(text)
        runs = plain_runs(words)
        assert [tuple(r) for r in found[i].runs] == runs, text
        assert found[i].n_words == len(words)
        assert found[i].collapsed == collapsed(words, runs)


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(400):
        letters = rnd.choice([1, 2, 2, 3, 5, 40])
        words = [str(rnd.randrange(letters)) for _ in range(rnd.choice([1, 3, 6, 8, 20, 90]))]
        texts.append(" ".join(words * rnd.choice([1, 1, 3, 4, 6])))
    check(spark, texts)


def test_words_of_famous_strings(spark):
    a, b = ["a"], ["a", "b"]
    for _ in range(8):
        a, b = b, b + a
    thue = ["0"]
    for _ in range(8):
        thue += ["1" if t == "0" else "0" for t in thue]
    check(spark, [" ".join(b), " ".join(thue), " ".join(["x"] * 100), " ".join(b * 5)])


def test_null_empty_blank_and_short_texts(spark):
    check(spark, [None, "", " \n\t", "x", "x x x x x", "x x x x x x", "a b a b a b a", "a b a b a b a b"])


def test_runs_of_two_texts_do_not_meet(spark):
    check(spark, ["x x x", "x x x", "x x x x x x", "x x x"])


def test_very_long_text(spark):
    root = " ".join(f"w{i}" for i in range(700))
    found = answers(spark, [f"head {(root + ' ') * 150}tail", "x " * 300_000])
    assert [tuple(r) for r in found[0].runs] == [(1, 105_000, 700)]
    assert found[0].collapsed == f"head {root} tail"
    assert [tuple(r) for r in found[1].runs] == [(0, 300_000, 1)]
    assert found[1].collapsed == "x"


def test_repeated_rows_other_columns_and_a_clashing_one(spark):
    docs = documents(spark, ["y y y y y y y"] * 3, [1, 1, None]).withColumnRenamed("_row", "Periodic")
    found = periodic_runs.detect(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "node", "periodic"]
    assert [tuple(r.periodic.runs[0]) for r in found.collect()] == [(0, 7, 1)] * 3
    assert periodic_runs.detect(docs.where("false")).collect() == []


@pytest.mark.parametrize("sf", [SF])
def test_query_against_brute_force(spark, sf):
    found = {r.doc_id: r for r in entry.queries()["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for doc in docs:
        words = words_of(doc.text)
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        some += len(runs)
        row = found[doc.doc_id]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{l},{q}\n" for s, l, q in runs))
        assert row.collapsed_sha256 == sha(collapsed(words, runs))
    assert some > 10
