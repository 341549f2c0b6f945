"""Literal phrases are found as by the pattern of the SQL, and texts without the phrase are told without a pattern."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelwright.functions import text as T

TEXTS = ["The", " The", "The\n", "\nThe", "TheThe", "TheThe The", "aThe The", "The9 The", "é The", "éTheé", "the", "", "ThThe", "The.The", "xThe-The", "TheX", None]


def test_as_the_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(df.select("i", T.literal_present(F.col("t"), "The")).collect())
    assert got == {i: None if t is None else bool(re.search(r"(^|[^A-Za-z0-9])The([^A-Za-z0-9]|$)", t)) for i, t in enumerate(TEXTS)}


def test_bytes_first(spark):
    df = spark.range(1).select(T.literal_present(F.col("id").cast("string"), "The").alias("x"))
    assert "Contains(" in df._jdf.queryExecution().optimizedPlan().toString()
