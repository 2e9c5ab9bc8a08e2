"""Where a caller's own Python goes: a function over a column, one row to many, a table function."""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_column(c: Column, fn: Callable[[pd.Series], pd.Series], returns: str) -> Column:
    """A caller's function over Arrow batches of a column, in place of a row-wise apply."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield fn(batch)

    return F.pandas_udf(run, returns)(c)


def rows_to_many(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Each row to any number of rows by a caller's function, in Arrow batches; values are plain
    Python, so integers and nulls stay what they are. Posts of a page need none of this: see
    `read_threads` and `explode_posts`."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row for given in batch.to_pylist() for row in fn(given)]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=kinds)

    return df.mapInArrow(run, schema)


def lateral_rows(
    df: DataFrame, machine: type, schema: str, *arguments: str, outer: bool = False
) -> DataFrame:
    """`df` with a row for each row that a caller's table function makes of the named columns, beside
    the row's own columns; `outer` keeps rows of which it makes none, with nulls.

    `machine` is a class whose `eval(*arguments)` yields tuples of `schema`. It is made once per
    partition, and `terminate`, where it has one, runs at its end. Its columns stand last; one that
    `df` has already must be renamed before.
    """
    made = F.udtf(machine, returnType=schema)
    call = made(*[F.col(f"`{a}`").outer() for a in arguments])
    if outer:
        return df.lateralJoin(call, how="left")
    return df.lateralJoin(call)
