"""Small word tables for the queries, over words that occur in the given texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.rules import Rules

LANGS = ["de", "en", "es", "fr"]

LEXICON = {
    "that": 1.4, "with": 1.9, "from": -1.7, "und": 2.1, "die": -1.3, "que": 1.1, "de": -0.9,
    "er": 0.4, "his": 2.6, "thatin": 3.1, "hehely": -2.4, "ononst": -3.2, "inoran": 2.8,
    "kind": 2.4, "least": 0.3, "shit": -2.6, "en": -0.6, "are": 1.2, "this": -0.4,
}
GLOSSARY = {
    "le": "the", "la": "the", "de": "of", "et": "and", "der": "the", "die": "the", "und": "and",
    "que": "that", "el": "the", "los": "the", "en": "in", "un": "a", "une": "a", "ist": "is",
    "mit": "with", "von": "from", "avec": "with", "est": "is", "las": "the", "zu": "to",
}
RULES = Rules(
    boosters={"is": 0.293, "of": 0.293, "la": 0.293, "der": -0.293, "le": -0.293, "of the": -0.293},
    negations=frozenset(["and", "les", "den", "for"]),
    idioms={"the the": 2.0, "of that": -1.5, "in the that": 1.25, "und die": -2.0},
    contrast="it",
)

#: Words of the documents and what stands for them where the library's own lists are looked at.
ENGLISH = {
    " the ": " not ", " und ": " very ", " que ": " but ", " le ": " kind of ", " der ": " the shit ",
    " and ": " isn't ", " et ": " least ", " la ": " REALLY ", " of ": " never so ", " el ": " bad ass ",
    " that ": " barely! ", " die ": " hand to mouth ",
}


def english(text):
    """The text with each word of `ENGLISH` replaced, one after the other."""
    for word, other in ENGLISH.items():
        text = F.replace(text, F.lit(word), F.lit(other))
    return text


def values(table: dict, number: bool = False) -> str:
    """The table as rows of a SQL VALUES list."""
    show = (lambda v: f"cast({v} as double)") if number else (lambda v: f"'{v}'")
    return ", ".join(f"('{k}', {show(v)})" for k, v in table.items())


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {values(LEXICON, True)} as t(token, valence)")


def glossary(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {values(GLOSSARY)} as t(token, target)")
