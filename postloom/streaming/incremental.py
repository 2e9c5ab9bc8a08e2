"""New page files to posts, new posts to scores: each input file is taken once."""

import json
import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from postloom.sources.pages import dealt


def new_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_new(rows: DataFrame, out: str, checkpoint: str):
    """Append a stateless stream (pages to posts is page-local) to a parquet table, take all
    that is there, and stop. The sink's log and the checkpoint make a rerun or a restart after
    a failed batch add each row once."""
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query


class _Totals(StreamingQueryListener):
    """Adds up what the batches of one named stream have observed."""

    def __init__(self, name: str):
        self.name, self.sums, self.ended = name, Counter(), threading.Event()
        self.id = None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.id = event.id

    def onQueryProgress(self, event):
        if event.progress.name == self.name:
            for row in event.progress.observedMetrics.values():
                self.sums.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.id == self.id:
            self.ended.set()


def append_counted(
    rows: DataFrame, out: str, checkpoint: str, counts: dict[str, Column], name: str
) -> dict[str, int]:
    """`append_new`, and the given aggregates (sums or counts) over the rows of this run, taken in
    the pass that writes them. A run that finds nothing new gives zeros; a batch that failed and is
    played again by a later run is counted there, once. `name` must be no other running stream's.
    """
    spark = rows.sparkSession
    totals = _Totals(name)
    spark.streams.addListener(totals)
    try:
        query = (
            rows.observe(name, *[c.alias(k) for k, c in counts.items()])
            .writeStream.format("parquet")
            .queryName(name)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        # Progress is reported beside the stream; its end is reported last.
        totals.ended.wait(60)
    finally:
        spark.streams.removeListener(totals)
    return {k: int(totals.sums.get(k, 0)) for k in counts}


def enrich_new(
    rows: DataFrame, enrich: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
):
    """Enrich only new rows, by any batch operators. A batch is written into the folder of its
    stream and batch, and replaces that folder when it is played again, so each row is there once.
    The stream's id lives in its checkpoint: another checkpoint over the same table adds rows and
    touches none that are there. A batch of few files is dealt out to all cores first: a file read
    whole by one task would be enriched by that task alone."""

    def write(batch: DataFrame, batch_id: int):
        meta = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        (
            enrich(dealt(batch))
            .withColumn("stream_id", F.lit(json.loads(meta)["id"]))
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("stream_id", "batch_id")
            .parquet(out)
        )

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
