"""Translation memory kept on disk in buckets of text fingerprints."""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import is_blank
from postloom.operators.joins import ROWS_PER_TASK, fingerprint, hot_keys, spread_join
from postloom.operators.translate import TRANSLATED, backend_udf, bounded_batches, distinct_texts
from postloom.sources.scratch import Workspace, stage

_SCHEMA = "print string, source_text string, target_text string"


class Memory:
    """A table (print, source_text, target_text) in a folder, bucketed and sorted by print, so
    that texts are looked up without moving it. The folder is all there is: a later session that
    gives the same folder and number of buckets goes on with it.

    One job at a time may append. An append that fails leaves the memory as it was. Of several
    targets of one text the least counts, so a text that was added twice is no harm.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"memory_{hashlib.md5(path.encode()).hexdigest()}_{buckets}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_SCHEMA}) USING parquet "
            f"CLUSTERED BY (print) SORTED BY (print) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, pairs: DataFrame) -> None:
        """Appends (source_text, target_text); blank sources and null targets are passed over."""
        kept = pairs.where(~is_blank(F.col("source_text")) & F.col("target_text").isNotNull())
        keyed = kept.select(fingerprint(F.col("source_text")).alias("print"), "source_text", "target_text")
        # One file per bucket and append.
        keyed = keyed.repartition(self.buckets, "print")
        writer = keyed.write.mode("append").format("parquet").bucketBy(self.buckets, "print")
        writer.sortBy("print").option("path", self.path).saveAsTable(self.name)

    def lookup(self, texts: DataFrame, text: str) -> DataFrame:
        """`texts`, one row per print in the column `print`, with target_text or null. Only the
        texts move; where prints are equal the texts are compared."""
        least = F.min(F.struct("source_text", "target_text")).alias("_known")
        known = self.rows().groupBy("print").agg(least).hint("merge")
        same = F.col("_known.source_text") == F.col(text)
        return texts.join(known, "print", "left").select(
            *texts.columns, F.when(same, F.col("_known.target_text")).alias("target_text")
        )


def one_per_print(posts: DataFrame, text: str) -> DataFrame:
    """(print, text, rows): each text that is not blank once, keyed by its print. Copies are
    combined before they are shuffled, and it is the print that they are sorted by."""
    return distinct_texts(posts, text).withColumnRenamed("_print", "print")


def translate_by_memory(
    posts: DataFrame,
    memory: Memory,
    text: str = "post_content",
    out: str = TRANSLATED,
    make_backend: Callable | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds `out` and `via` as `translate` does, and puts what the backend answered into the
    memory, so that it is asked for a text once in the memory's life.

    Every row is kept. Texts the backend refuses stay as they are and are asked for again next
    time. Two different texts of one print (128 bits) would pass as one within a run.
    """
    blank = is_blank(F.col(text))
    with Workspace(posts.sparkSession) as work:
        texts = work.stage(one_per_print(posts, text), "distinct-texts")
        found = work.stage(memory.lookup(texts, text), "remembered")
        if make_backend is not None:
            asked = found.where("target_text is null").select(
                "print", F.col(text).alias("source_text"), backend_udf(make_backend)(text).alias("answer")
            )
            # Written out, so that the backend is not asked again by a later read.
            with bounded_batches(posts.sparkSession):
                asked = work.stage(asked, "answers")
            answered = asked.where("answer is not null")
            memory.add(answered.select("source_text", F.col("answer").alias("target_text")))
            found = found.join(answered.select("print", "answer"), "print", "left")
        else:
            found = found.withColumn("answer", F.lit(None).cast("string"))
        known = stage(
            found.select(
                F.col("print").alias("_text"),
                "rows",
                F.coalesce("target_text", "answer").alias("translation"),
                F.when(F.col("target_text").isNotNull(), "memory")
                .when(F.col("answer").isNotNull(), "backend")
                .otherwise("original")
                .alias("via"),
            ),
            "dictionary",
        )
    keyed = posts.withColumn("_text", F.when(~blank, fingerprint(F.col(text))))
    hot = hot_keys(known, "_text", "rows", rows_per_task)
    found = spread_join(keyed, known, "_text", rows_per_task=rows_per_task, hot=hot, rows="rows")
    return found.withColumns(
        {
            out: F.when(blank, "").otherwise(F.coalesce("translation", text)),
            "via": F.when(blank, "blank").otherwise(F.col("via")),
        }
    ).drop("_text", "translation")
