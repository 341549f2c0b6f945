"""Shares, concentration, entropy, and the algebra of label scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or missing."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def entropy_by(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Shannon entropy and concentration of a category's counts per key, by two partial aggregations."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("k"))
    x = F.col("k").cast("double")
    # -sum(p ln p) = ln n - sum(k ln k) / n
    return counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.count("*").alias("kinds"), (F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x)).alias("entropy"), (F.sum(x * x) / (F.sum(x) * F.sum(x))).alias("hhi"))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def mean_of(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda a, b: (a + b) / 2)


def entropy_of(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence of two distributions in units of ln 2."""
    return (entropy_of(mean_of(p, q)) - (entropy_of(p) + entropy_of(q)) / 2) / F.log(F.lit(2.0))


def first_argmax(a: Column) -> Column:
    """Position (from 1) of the largest element; the first of equals."""
    return F.array_position(a, F.array_max(a)).cast("int")


def top_margin(a: Column) -> Column:
    s = F.sort_array(a, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)
