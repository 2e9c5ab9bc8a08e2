"""Batched model inference: text or features to logits, logits to a margin."""

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.margins import margin
from postloom.functions.text import is_blank

LOGITS = T.ArrayType(T.FloatType())


def logits_udf(make_predict: Callable, batch_size: int = 64, input_shapes=None) -> Callable:
    """Column function to logits. `make_predict` loads the model, once per Python worker, and
    returns a function from a batch of inputs to a (batch, classes) array."""
    return predict_batch_udf(
        make_predict,
        return_type=LOGITS,
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )


def model_score(
    posts: DataFrame,
    make_predict: Callable,
    pos: int,
    neg: int,
    text: str = "translated_post_content",
    out: str = "sentiment_score",
    batch_size: int = 64,
) -> DataFrame:
    """Adds `out`: the class margin of the model's logits; null for blank text. The model reads
    "" in place of blank text, as a batch has no nulls."""
    blank = is_blank(F.col(text))
    asked = F.when(blank, "").otherwise(F.col(text))
    scored = posts.withColumn("_logits", logits_udf(make_predict, batch_size)(asked))
    return scored.withColumn(out, F.when(~blank, margin(F.col("_logits"), pos, neg))).drop(
        "_logits"
    )


def margin_2class(logits: Column) -> Column:
    """Positive minus negative of (negative, positive)."""
    return margin(logits, pos=1, neg=0)


def margin_3class(logits: Column) -> Column:
    """Class 2 minus class 0. Which class means what is the model's affair."""
    return margin(logits, pos=2, neg=0)
