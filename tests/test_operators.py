"""Gaps, ties, nulls and empty inputs of the operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import bars as B
from panelwright.operators import calendar as C
from panelwright.operators import composition as K
from panelwright.operators import metrics as M
from panelwright.operators import models as O
from panelwright.operators import rolling as R
from panelwright.operators.linkage import linked_groups
from panelwright.sources import sinks, tables
from panelwright.streaming import bars as S

D = dt.date


def test_missing_bar_breaks_the_return(spark):
    bars = spark.createDataFrame([("a", D(2024, 1, 1), b, 1.0, float(c)) for b, c in ((0, 2), (1, 4), (3, 8))] + [("a", D(2024, 1, 3), 0, 8.0, 8.0)], "symbol string, day date, bucket int, open double, close double")
    got = {(r.day.day, r.key): r.r for r in B.interval_returns(bars).collect()}
    assert set(got) == {(1, "b0"), (1, "b1"), (3, "b0")}  # no b3 after the gap, no overnight over a missing day
    assert got[1, "b1"] == pytest.approx(math.log(2))


def test_negative_components_are_asymmetric(spark):
    rows = [(s, D(2024, 1, 1), k, r) for k, x, y in (("overnight", -1.0, 1.0), ("b0", -2.0, -3.0), ("b1", 1.0, -1.0), ("b2", 1.0, 1.0)) for s, r in (("x", x), ("y", y))]
    r = B.pair_components(spark.createDataFrame(rows, "symbol string, day date, key string, r double")).first()
    assert (r.nxy, r.nxx, r.nyy, r.n) == (6.0, 5.0, 10.0, 4)


def test_complete_days_need_the_exact_set(spark):
    rows = [("a", D(2024, 1, 1), k, 0.1) for k in ("b0", "b1")] + [("a", D(2024, 1, 2), k, 0.1) for k in ("b0", "other")]
    got = B.complete_days(spark.createDataFrame(rows, "symbol string, day date, key string, r double"), ["b0", "b1"]).collect()
    assert [r.day.day for r in got] == [1]


def test_asof_equality(spark):
    cut = spark.createDataFrame([(dt.datetime(2024, 1, d, 14),) for d in (1, 4)], "cutoff timestamp_ntz")
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 13, 59, 59)), (2, dt.datetime(2024, 1, 1, 14)), (3, dt.datetime(2024, 1, 2, 9)), (4, dt.datetime(2024, 1, 5)), (5, None)], "id int, at timestamp_ntz")
    day = lambda strict: {r.id: r.cutoff and r.cutoff.day for r in C.asof_forward(events, "at", cut, "cutoff", strict).collect()}
    assert day(False) == {1: 1, 2: 1, 3: 4, 4: None, 5: None}
    assert day(True) == {1: 1, 2: 4, 3: 4, 4: None, 5: None}


def test_prior_windows_exclude_the_current_row(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0, 9.0])], "k int, t int, v double")
    w = R.rows(["k"], ["t"], -3, -1)
    got = df.select("t", R.prior_midrank(F.col("v"), w, 3).alias("m"), R.prior_median_delta(F.col("v"), w, 3).alias("d")).orderBy("t").collect()
    assert [r.m for r in got] == [None, None, None, pytest.approx((1 + 1) / 3), 1.0]
    assert got[4].d == 7.0


def test_finite_exponential_skips_missing(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0])], "k int, t int, v double")
    w = R.rows(["k"], ["t"], -2, 0)
    got = [r.e for r in df.select("t", R.finite_exponential(F.col("v"), w, 3, 1.0, 2, 0.5).alias("e")).orderBy("t").collect()]
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx((0.25 * 1 + 3) / 1.25)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 2, 3)], "k int, v int")
    assert sorted(r[0] for r in df.select(R.average_rank_share(["k"], F.col("v"))).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_purged_split(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), D(2000, 1, 5)), (D(2000, 1, 30), D(2000, 2, 2)), (D(2001, 1, 1), None)], "d date, e date")
    assert [r[0] for r in df.select(C.split_of(F.col("d"), F.col("e"), {"train": ("2000-01-01", "2000-01-31")})).collect()] == ["train", None, None]


def test_url_title_and_bounds(spark):
    df = spark.createDataFrame([("https://WWW.Site.com:443/a//b/?utm_source=x&z=1&a=2#f", "It's  A—Title!", "one two three", "one two")], "u string, t string, d string, e string")
    r = df.select(T.normalized_url(F.col("u")), T.normalized_title(F.col("t")), T.bounded(F.col("d"), 9), T.bounded(F.col("e"), 9), T.bounded(F.col("d"), 7)).first()
    assert tuple(r) == ("site.com/a/b?a=2&z=1", "it s a title", "one two", "one two", "one two")


def test_scores(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    got = df.select(K.jensen_shannon(F.col("p"), F.col("q")).alias("j"), K.first_argmax(F.col("p")).alias("a"), K.top_margin(F.col("p")).alias("m")).collect()
    assert [(round(r.j, 9) + 0.0, r.a, r.m) for r in got] == [(0.0, 1, 0.0), (1.0, 1, 1.0)]


def test_label_metrics_skip_classes_without_support(spark):
    r = M.label_metrics(spark.createDataFrame([(1, 1), (1, 1), (0, 1), (1, 2)], "t int, g int"), "t", "g").first()
    assert (r.n, r.accuracy, r.majority) == (4, 0.5, 0.75)
    assert r.macro_f1 == pytest.approx((0.0 + 2 * 2 / (3 + 3)) / 2)


def test_linkage_is_transitive(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (None, "c"), (5, None), (9, "z"), (8, "z")], "id long, key string")
    assert {tuple(r) for r in linked_groups(keys, "id", "key").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (8, 8), (9, 8)}


def test_garch_missing_is_expected(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, None, 2.0])], "k string, t int, r double")
    s = [r.variance for r in O.garch_filter(df, "k", "t", "r", 0.1, 0.2, 0.7).orderBy("t").collect()]
    assert s == pytest.approx([1.0, 0.1 + 0.2 + 0.7, 1.0])


def test_elastic_net_without_penalty_is_least_squares():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, -2.0, 0.5]
    assert np.allclose(O.elastic_net(x, y, 0.0, 0.5), [1.0, -2.0, 0.5], atol=1e-6)
    assert not O.elastic_net(x, y, 100.0, 1.0).any()


def test_sinks_and_sources(spark, tmp_path):
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), D(2024, 1, 1), "09:30:00", 1.0, 1.0, 1.0, 2.0, 5.0), ("a", dt.datetime(2024, 1, 1), D(2024, 1, 1), "09:45:00", 0.0, 1.0, 1.0, 2.0, 5.0)], tables.BAR_SCHEMA)
    path = f"{tmp_path}/bars.csv.gz"
    sinks.write_table(bars.where("open > 0"), path)
    read = tables.read_bars(spark, path)
    assert read.count() == 1
    sinks.write_with_sidecar(read, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t.manifest").first()["rows"] == 1
    with pytest.raises(Exception, match="repeated bar"):
        tables.unique_bars(bars).collect()
    (tmp_path / "p.json").write_text('{"results": [{"id": "1", "tickers": ["A"]}, {"id": "2"}]}')
    assert [r.id for r in tables.read_pages(spark, f"{tmp_path}/p.json").orderBy("id").collect()] == ["1", "2"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 24, 5), i % 3, "view" if i % 2 else "buy", float(i)) for i in range(48)]
    schema = "event_id long, ts timestamp, user_id int, event_type string, value double"
    events = spark.createDataFrame(rows, schema)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.windowed_bars(S.event_stream(spark, f"{tmp_path}/in", schema))
    S.exactly_once(stream.select(F.col("window.start").alias("start"), "event_type", "open", "close", "volume"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.start, r.event_type): (r.open, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    at = F.struct("ts", "event_id")
    want = {(r.w.start, r.event_type): (r.o, r.c, r.n) for r in events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.min_by("value", at).alias("o"), F.max_by("value", at).alias("c"), F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    unique = S.first_of_each(S.event_stream(spark, f"{tmp_path}/in", schema), ["event_type"])
    S.exactly_once(unique, f"{tmp_path}/u", f"{tmp_path}/cu").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2
