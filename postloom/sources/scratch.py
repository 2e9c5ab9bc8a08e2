"""Where staged tables go: the shared folder the cluster names, never a machine-local one."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a session that runs in one local
    process gets a temporary folder, and one on a cluster is told to name a shared one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="postloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/postloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, workspace: "Workspace | None" = None) -> DataFrame:
    """The frame as a written table: computed once, safe against lost executors, and later
    reads of it take only the columns they use."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if workspace is not None:
        workspace.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Workspace:
    """Staged tables that go when the block ends; what the block returns is staged outside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, self)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *failure) -> None:
        for path in self.paths:
            remove(self.spark, path)
