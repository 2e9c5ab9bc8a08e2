"""Post tables kept in parquet: appended to by many sources, replaced by later stages."""

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_sources(sources: dict[str, DataFrame], path: str):
    """Append the union of all sources in one job, a `source=` folder each.

    The job's commit takes the place of a lock: rows of a failed job never show.
    """
    labelled = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    rows = reduce(DataFrame.unionByName, labelled)
    rows.write.mode("append").partitionBy("source").parquet(path)


def append_each(sources, path: str) -> dict:
    """As `append_sources`, one job per source, so that a failing source stops no other.

    `sources` maps names to functions that build the frame. Each job writes into its own
    `source=` folder. Returns the error per source, None where rows were written.
    """
    outcome = {}
    for name, build in sources.items():
        try:
            build().write.mode("append").parquet(f"{path}/source={name}")
            outcome[name] = None
        except Exception as e:  # any failure of one source is reported, not raised
            outcome[name] = e
    return outcome


class VersionedTable:
    """A table that a stage may read and replace: each write is a new folder, and one line
    appended to the log of versions makes it current. Readers keep the version they opened.
    One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        return self.spark.read.schema("version bigint, folder string").parquet(
            f"{self.path}/versions"
        )

    def current(self):
        """(version, folder) of the newest version, or None before the first write."""
        try:
            newest = self._log().agg(F.max(F.struct("version", "folder")).alias("v")).first()["v"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return newest and (newest["version"], newest["folder"])

    def read(self) -> DataFrame:
        current = self.current()
        if current is None:
            raise FileNotFoundError(f"no version written yet: {self.path}")
        return self.spark.read.parquet(f"{self.path}/{current[1]}")

    def replace(self, df: DataFrame) -> int:
        """Write `df`, which may be computed from `read()`, as the next version."""
        current = self.current()
        version = 1 if current is None else current[0] + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        line = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(folder).alias("folder")
        )
        line.write.mode("append").parquet(f"{self.path}/versions")
        return version
