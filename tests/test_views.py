"""Labels of two views are rounded from exact means, whatever the order in which doubles are added."""

from __future__ import annotations

import itertools

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelwright.plans import load_all, registry

load_all()


def short_of_75() -> list[float]:
    """Three prices of 75.00 in all whose doubles add up to less."""
    cents = range(1, 7500, 37)
    return next(v for a, b in itertools.product(cents, cents) if a + b < 7500 and (v := [a / 100, b / 100, (7500 - a - b) / 100]) and v[0] + v[1] + v[2] < 75)


def test_ties_of_means(spark, tmp_path):
    low = short_of_75()
    times = [1_704_067_200_000_000 + 3_600_000_000 * h for h in (1, 2, 3, 13)]
    rows = {"event_id": [0, 1, 2, 3], "ts": pa.array(times, pa.timestamp("us")), "user_id": [1] * 4, "event_type": ["a"] * 4, "value": [*low, 50.0]}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    got = [tuple(r) for r in registry.QUERIES["adjudicate_views"](spark, str(tmp_path)).collect()]
    assert got == [("a", 1, 1, 0, 1.0)]  # 25 rounds to 1 of 50, as 50 does


def test_rounded_mean(spark):
    from panelwright.plans.news import rounded_mean

    rows = [("tie", v) for v in short_of_75()] + [("negative", -v) for v in short_of_75()] + [("fine", 1e-9), ("fine", 60.0), ("large", 1e300), ("null", None)]
    got = dict(spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(rounded_mean(F.col("v"), 50).alias("m")).collect())
    assert got == {"tie": 1.0, "negative": -1.0, "fine": 1.0, "large": 1e300 / 50, "null": None}
