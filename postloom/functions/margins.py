"""Class-probability margins over a logits array."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Shifted by the greatest logit, so that no size of logit overflows."""
    shifted = F.transform(
        logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double"))
    )
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def margin(logits: Column, pos: int, neg: int) -> Column:
    """softmax[pos] - softmax[neg], 0-based; null for null logits. Only the sum and the two
    named classes are computed."""
    greatest = F.array_max(logits).cast("double")
    weight = lambda x: F.exp(x.cast("double") - greatest)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + weight(x))
    return (weight(F.get(logits, pos)) - weight(F.get(logits, neg))) / total
