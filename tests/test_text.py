from pyspark.sql import functions as F

from postloom.functions import text


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_white_space_is_what_python_strips():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_blank(spark):
    given = [None, "", " ", " \x1c\n", " a b ", "\xa0x\x85"]
    assert values(spark, text.strip(F.col("x")), given) == [
        None if g is None else g.strip() for g in given
    ]
    assert values(spark, text.is_blank(F.col("x")), given) == [
        g is None or not g.strip() for g in given
    ]


def test_words(spark):
    given = ["", " ", " a\x0bb c  d ", None]
    assert values(spark, text.words(F.col("x")), given) == [[], [], ["a", "b", "c", "d"], []]


def test_missing_tokens(spark):
    missing = ["NA", "N/A", "n/a", "#N/A", "<NA>", "null", "NULL", "nan", "NaN", "None", ""]
    kept = ["none", "Na", "-", "na"]
    assert values(spark, text.na_to_null(F.col("x")), missing + kept) == [None] * len(missing) + kept


def test_page_count(spark):
    given = ["Sidan 3 av 41", "Sidan 3 av", "x", None, "Sidan 1 av 99999999999", "a Sidan 2 av 7 b"]
    assert values(spark, text.page_count(F.col("x")), given) == [41, 1, 1, 1, 1, 7]


def test_last_page_url(spark):
    assert values(spark, text.last_page_url(F.col("x"), F.lit(4)), ["http://h/t1"]) == ["http://h/t1p4"]


def test_absolute_url(spark):
    cases = [
        ("/a/b", "http://x.com/c/d.html?q=1", "http://x.com/a/b"),
        ("//h/y", "https://x.com", "https://h/y"),
        ("z", "https://x.com", "https://x.com/z"),
        ("z", "https://x.com/a/b", "https://x.com/a/z"),
        ("#t", "https://x.com/a#u", "https://x.com/a#t"),
        ("http://o/p", "http://x", "http://o/p"),
        ("", "http://x", ""),
        (None, "http://x", None),
    ]
    got = values(
        spark, text.absolute_url(F.col("h"), F.col("b")), [c[:2] for c in cases], "h string, b string"
    )
    assert got == [c[2] for c in cases]


def test_prefixed_url(spark):
    got = values(spark, text.prefixed_url(F.col("x"), "https://h"), ["/t1", "https://o/t2"])
    assert got == ["https://h/t1", "https://o/t2"]


def test_words_are_split_at_every_white_space_character_and_no_other(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    split = rows.where(F.size(text.words(F.col("t"))) == 2).select("c")
    assert sorted(r.c for r in split.collect()) == sorted(map(ord, text.WHITESPACE))
