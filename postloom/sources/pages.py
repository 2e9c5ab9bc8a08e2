"""Crawled pages as a DataFrame of (url, html), and other parquet inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.encoding import decoded, encoding_of


def dealt(df: DataFrame) -> DataFrame:
    """An input that reads as fewer pieces than there are cores is dealt out to all of them, for
    work that costs more than the move. A corpus of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet corpus of pages."""
    return dealt(spark.read.parquet(path))


def decode_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    """`pages` with `html` and `encoding` in place of their bytes; a page's own html goes."""
    others = [c for c in pages.columns if c.lower() not in (content.lower(), "html", "encoding")]
    named = pages.select(*others, content, encoding_of(F.col(content)).alias("encoding"))
    html = decoded(F.col(content), F.col("encoding"))
    return named.select(*others, html.alias("html"), "encoding")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder tree of saved .html files, one page each, as (url, html, encoding): each file in the
    encoding that it shows; the file's path is its url. A file must fit a task's memory; Spark gives no row for an empty
    one."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html")
        .load(path)
    )
    return decode_pages(files.select(F.col("_metadata.file_path").alias("url"), "content"))
