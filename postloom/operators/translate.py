"""Post text to English: by translation memory, by a caller's backend, by token glossary."""

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import is_blank, words
from postloom.operators.joins import (
    ROWS_PER_TASK,
    fingerprint,
    fits,
    hot_keys,
    spread_join,
)
from postloom.operators.tokens import FOUND, token_lookup
from postloom.sources.scratch import stage

TRANSLATED = "translated_post_content"


def unique_memory(memory: DataFrame) -> DataFrame:
    """One target per source text, the least, so that a join adds no rows."""
    memory = memory.where(~is_blank(F.col("source_text")) & F.col("target_text").isNotNull())
    return memory.groupBy("source_text").agg(F.min("target_text").alias("target_text"))


def distinct_texts(posts: DataFrame, text: str) -> DataFrame:
    """(_print, text, rows): each text to be translated, once, by its fingerprint; copies are
    combined before they are shuffled. Two different texts of one print (128 bits) would pass as
    one."""
    keyed = posts.where(~is_blank(F.col(text))).select(fingerprint(F.col(text)).alias("_print"), text)
    return keyed.groupBy("_print").agg(F.first(text).alias(text), F.count("*").alias("rows"))


def _answers(translate, texts: list[str]) -> list[str | None]:
    """The translations; a batch that fails is halved, and a few texts are asked one by one."""
    try:
        return list(translate(texts))
    except Exception:
        if len(texts) == 1:
            return [None]
        size = len(texts) // 2 if len(texts) > 4 else 1
        parts = [texts[at : at + size] for at in range(0, len(texts), size)]
        return [answer for part in parts for answer in _answers(translate, part)]


def backend_udf(make_backend: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 64):
    """Arrow-batched call of a translator, built once per Python worker and asked for at most
    `batch_size` texts at a time. Null in, null out; a text the translator fails on gives null,
    and takes no other text of its batch along."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translate = make_backend()
        for batch in batches:
            asked, start = batch.notna().to_numpy().nonzero()[0], 0
            # Answers go as they come, so that no more than one call's are held.
            for at in range(0, len(asked), batch_size):
                places = asked[at : at + batch_size]
                end = int(places[-1]) + 1
                got = pd.Series(_answers(translate, list(batch.iloc[places])), index=places, dtype=object)
                yield got.reindex(range(start, end))
                start = end
            if start < len(batch):
                yield pd.Series([None] * (len(batch) - start), dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()


#: Rows and bytes of a batch that is sent to a Python worker with whole texts.
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1024,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


@contextmanager
def bounded_batches(spark: SparkSession):
    """While it lasts, jobs send texts to Python in batches of `BATCH_LIMITS` at most, as a worker
    holds a batch several times over. A session's own setting that is lower stays."""
    before = {name: spark.conf.get(name, None) for name in BATCH_LIMITS}
    for name, limit in BATCH_LIMITS.items():
        given = re.fullmatch(r"(\d+)b?", before[name] or "")
        if not given or not 0 < int(given[1]) <= limit:
            spark.conf.set(name, limit)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dictionary(
    posts: DataFrame,
    memory: DataFrame,
    text: str = "post_content",
    make_backend=None,
    small: bool | None = None,
) -> DataFrame:
    """(text, rows, translation, via) for each distinct text: via memory, backend or original.

    Only texts the memory lacks reach the backend. Written out, this is new memory.
    """
    found = _answered(posts, memory, text, make_backend, small is not False and fits(memory))
    return found.select(text, "rows", F.coalesce("translation", text).alias("translation"), "via")


def _by_print(memory: DataFrame) -> DataFrame:
    """(_print, _known): of a print's texts the least, with its least target."""
    known = memory.where(~is_blank(F.col("source_text")) & F.col("target_text").isNotNull())
    return known.groupBy(fingerprint(F.col("source_text")).alias("_print")).agg(
        F.min(F.struct("source_text", "target_text")).alias("_known")
    )


def _known_target(text: str):
    """Where prints are equal the texts are compared."""
    return F.when(F.col("_known.source_text") == F.col(text), F.col("_known.target_text"))


def _answered(posts, memory, text: str, make_backend, small: bool) -> DataFrame:
    """(_print, text, rows, translation, via); the translation of an original is null. Prints are
    the join key."""
    known = _by_print(memory)
    texts = distinct_texts(posts, text)
    found = texts.join(F.broadcast(known) if small else known, "_print", "left")
    found = found.select(*texts.columns, _known_target(text).alias("_target"))
    if make_backend is None:
        found = found.withColumn("_new", F.lit(None).cast("string"))
    else:
        missing = F.when(F.col("_target").isNull(), F.col(text))
        found = found.withColumn("_new", backend_udf(make_backend)(missing))
    return found.select(
        *texts.columns,
        F.coalesce("_target", "_new").alias("translation"),
        F.when(F.col("_target").isNotNull(), "memory")
        .when(F.col("_new").isNotNull(), "backend")
        .otherwise("original")
        .alias("via"),
    )


def translate(
    posts: DataFrame,
    memory: DataFrame,
    text: str = "post_content",
    out: str = TRANSLATED,
    make_backend=None,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds `out` and `via`: "" for blank text, the translation where there is one, else the
    text itself. Every row is kept, copies included.

    With a small memory and no backend this is one broadcast join, no shuffle. With a larger one the
    rows are joined to it by fingerprint. With a backend each distinct text is looked up or
    translated once and joined back by fingerprint. Hot texts are spread over tasks and blank rows
    among them.
    """
    blank = is_blank(F.col(text))
    small = small is not False and fits(memory)
    if make_backend is None and small:
        found = posts.join(
            F.broadcast(unique_memory(memory)), F.col(text) == F.col("source_text"), "left"
        ).withColumns(
            {
                "translation": F.coalesce("target_text", text),
                "via": F.when(F.col("target_text").isNotNull(), "memory").otherwise("original"),
            }
        ).drop("source_text", "target_text")
    elif make_backend is None:
        keyed = posts.withColumn("_print", F.when(~blank, fingerprint(F.col(text))))
        found = spread_join(keyed, _by_print(memory), "_print", rows_per_task=rows_per_task)
        found = found.withColumn("_target", _known_target(text)).withColumns(
            {
                "translation": F.coalesce("_target", text),
                "via": F.when(F.col("_target").isNotNull(), "memory").otherwise("original"),
            }
        ).drop("_print", "_known", "_target")
    else:
        known = _answered(posts, memory, text, make_backend, small)
        # Written out, so that no later use of the posts asks the backend again.
        with bounded_batches(posts.sparkSession):
            known = stage(known.drop(text).withColumnRenamed("_print", "_text"), "dictionary")
        keyed = posts.withColumn("_text", F.when(~blank, fingerprint(F.col(text))))
        hot = hot_keys(known, "_text", "rows", rows_per_task)
        found = spread_join(
            keyed, known, "_text", rows_per_task=rows_per_task, hot=hot, rows="rows"
        ).drop("_text")
        found = found.withColumn("translation", F.coalesce("translation", text))
    return found.withColumns(
        {
            out: F.when(blank, "").otherwise(F.col("translation")),
            "via": F.when(blank, "blank").otherwise(F.col("via")),
        }
    ).drop("translation")


def glossary_translate(
    posts: DataFrame,
    glossary: DataFrame,
    text: str = "post_content",
    out: str = TRANSLATED,
    inline: bool | None = None,
    known: str | None = None,
) -> DataFrame:
    """Adds `out`: each token by its lower-cased glossary entry (token, target), else as it
    stands, joined by single spaces; "" for blank text. With `known`, a column of that name says
    whether any token had an entry."""
    tokens = words(F.col(text))
    lower = F.transform(tokens, F.lower)
    found, values = token_lookup(
        posts, lower, glossary, "token", "target", inline, text=F.col(text)
    )
    # A column each, as both are used more than once: the tokens are made once for all.
    found = found.withColumn("_split", tokens)
    found = found.withColumn("_targets", values(F.transform("_split", F.lower)))
    made = {
        out: F.array_join(
            F.zip_with("_split", "_targets", lambda t, target: F.coalesce(target, t)), " "
        )
    }
    if known:
        made[known] = F.exists("_targets", lambda target: target.isNotNull())
    return found.withColumns(made).drop("_split", "_targets", FOUND)
