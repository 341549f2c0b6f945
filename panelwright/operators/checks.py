"""Contract checks: counts of violations as rows, by one aggregation of a table and one of its keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): how many rows violate each predicate; a null predicate is no violation. One pass."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    return counts.unpivot([], list(checks), "check", "violations")


def repeated_keys(df: DataFrame, keys: list[str], name: str = "repeated_key") -> DataFrame:
    """(check, violations): how many keys stand in more than one row."""
    return df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations")


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(check, violations): keys that only one side holds, either way."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    sides = [("only_left", a.join(b, keys, "left_anti")), ("only_right", b.join(a, keys, "left_anti"))]
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, d in sides])


def joined_panel(base: DataFrame, features: DataFrame, keys: list[str], flag: str = "matched") -> DataFrame:
    """Every row of `base` with the columns of `features` by key, and whether there was one. Refuses clashing columns."""
    if clash := set(base.columns) & set(features.columns) - set(keys):
        raise ValueError(f"columns stand on both sides: {sorted(clash)}")
    return base.join(features.withColumn(flag, F.lit(1)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def leaky_names(columns: list[str], forbidden: str) -> list[str]:
    """Feature names that repeat, are empty or match a pattern of what isn't known at forecast time."""
    import re

    return sorted({c for c in columns if not c or columns.count(c) > 1 or re.search(forbidden, c)})
