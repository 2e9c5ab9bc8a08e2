import re

from helpers import SF, frame

from postloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, k0 string, n_words string"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c d e a b c d e f", "a b c d", "x\nx\n\nx \nx", "é|ü #$", "\n\nq\n \nq\n",
    "a b c d e f a b c d e", "same " * 40, "l1 w\nl2 w\nl1 w\nl1 w\r\n", "\x0b\x0cz", "\x85y \xa0y",
]


def test_counts_equal_brute_force(spark):
    docs = frame(spark, [(i, t, "en", "s", "x", "y") for i, t in enumerate(TEXTS)] * 2, SCHEMA)
    for pieces in (1 << 20, 8):
        rows = quality.measure(docs, ["doc_id"]).collect()
        assert len(rows) == 2 * len(TEXTS)
        for row in rows:
            assert tuple(row)[1:] == counts(TEXTS[row.k0]), TEXTS[row.k0]


def test_sketch_cells_and_quartiles(spark):
    from pyspark.sql import functions as F

    values = spark.range(100_000).select(F.lit("g").alias("g"), (F.col("id") * 3).alias("v"))
    cells = quality.sketch(values, ["g"], {"v": F.col("v")})
    assert cells.count() < 64 + 32 * 20
    row = quality.quartiles(cells, ["g"]).first()
    for got, want in ((row.low, 75_000), (row.high, 225_000)):
        assert want * (1 - 1 / 32) <= got <= want
    # Sketches of parts, merged, are the sketch of the whole.
    parts = [quality.sketch(values.where(f"v % 2 = {i}"), ["g"], {"v": F.col("v")}) for i in (0, 1)]
    merged = quality.merge(parts[0].union(parts[1]), ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, cells.collect()))


MARKS = "".join(f" #{i}|" for i in range(20))


def plain(i):
    return " ".join(f"word{(i * 31 + j * 7) % 997} text{j}" for j in range(20))


def test_outliers_of_a_group_go_and_the_others_stay(spark):
    rows = [(i, plain(i), "en", "a", "", "") for i in range(300)]
    # A source where symbols are the rule, and one with few documents.
    rows += [(1000 + i, plain(i) + MARKS, "en", "b", "", "") for i in range(300)]
    rows += [(2000, plain(1), "en", "c", "", ""), (2001, plain(1) + MARKS, "xx", "c", "", "")]
    rows += [(3000, plain(5) + MARKS, "en", "a", "", ""), (3001, "a b c", "en", "a", "", "")]
    rows += [(3002, "y" * 400 + " " + plain(5).replace(" ", "-") + " a b c d e f g h i", "en", "a", "", "")]
    rows += [(4000 + i, plain(i), None, None, "", "") for i in range(120)] + [(None, None, None, "a", "", "")]
    found = {r.doc_id: r for r in quality.judge(frame(spark, rows, SCHEMA)).collect()}
    assert all(found[i].kept for i in [*range(300), *range(1000, 1300), 2000, *range(4000, 4120)])
    assert not found[3000].kept and not found[3000].base_failed
    assert not found[3002].kept and not found[3002].base_failed
    assert found[3001].base_failed and not found[3001].kept and not found[None].kept
    assert found[2001].kept == found[1000].kept  # too few of its own: judged among all


def test_empty_table(spark):
    assert quality.judge(frame(spark, [], SCHEMA)).count() == 0


def test_clean_documents_of_the_given_table_stay(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1 and rows[r.doc_id].n_words >= 10]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_half_of_a_group_may_be_junk(spark):
    for percent in (10, 26, 30, 40, 50):
        junk = 4 * percent
        rows = [(i, plain(i) + (MARKS if i < junk else ""), "en", "hot", "", "") for i in range(400)]
        found = {r.doc_id: r for r in quality.judge(frame(spark, rows, SCHEMA)).collect()}
        assert sum(found[i].kept for i in range(junk)) <= 0.1 * junk, percent
        assert sum(not found[i].kept for i in range(junk, 400)) <= 0.01 * (400 - junk), percent
        assert not any(r.base_failed for r in found.values())


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + "\nend\nend"
    row = quality.judge(frame(spark, [(1, text, "en", "a", "", "")], SCHEMA)).first()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words, row.base_failed) == (300_002, 1, 0, False)
