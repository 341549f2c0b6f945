"""Calendar queries: as-of assignment, neighbours, dense grids, purged splits, context series, prior-only windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import rolling as R
from ..sources.tables import table
from .registry import query

# The blocks of the chronological split.
BLOCKS = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}

CUTS = "cuts AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR AS cutoff FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of the event stream, each with a cutoff at 14:00."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct().where("weekday(d) < 5")
    return days.select((F.col("d").cast("timestamp_ntz") + F.expr("interval 14 hours")).alias("cutoff"))


def _asof(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))
    out = C.asof_forward(events, "at", _cuts(spark, sf_dir), "cutoff", strict)
    return out.select("event_id", F.to_date("cutoff").alias("session"), ((F.unix_timestamp(F.col("cutoff").cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 3600).alias("hours"))


def _asof_sql(op: str) -> str:
    return f"""WITH {CUTS}, e AS (SELECT event_id, date_trunc('hour', ts) AS t0 FROM events)
 SELECT event_id, CAST(cutoff AS DATE) AS session, epoch(cutoff - t0) / 3600.0 AS hours FROM (SELECT event_id, t0, (SELECT min(cutoff) FROM cuts WHERE cutoff {op} t0) AS cutoff FROM e)"""


@query(_asof_sql(">="))
def asof_nonstrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, strict=False)


@query(_asof_sql(">"))
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, strict=True)


@query(f"WITH {CUTS} SELECT CAST(cutoff AS DATE) AS session, row_number() OVER (ORDER BY cutoff) AS seq, CAST(lag(cutoff) OVER (ORDER BY cutoff) AS DATE) AS prior, CAST(lead(cutoff) OVER (ORDER BY cutoff) AS DATE) AS next FROM cuts")
def neighbour_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = C.sequenced(_cuts(spark, sf_dir).select(F.to_date("cutoff").alias("session")), "session")
    w = Window.orderBy("session")
    return days.select("session", F.col("seq").cast("long"), F.lag("session").over(w).alias("prior"), F.lead("session").over(w).alias("next"))


GRID = """obs AS (SELECT c_nationkey AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 grid AS (SELECT m.month, k.nation, total, coalesce(n, 0) AS n FROM (SELECT DISTINCT month FROM obs) m CROSS JOIN (SELECT n_nationkey AS nation FROM nation) k LEFT JOIN obs o ON o.month = m.month AND o.nation = k.nation)"""


def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by nation and month on the dense grid of all nations and observed months."""
    orders, customers = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    obs = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    months = orders.select(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return C.dense(months, nations, obs, ["month", "nation"]).withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"WITH {GRID} SELECT month, nation, round(total, 2) AS total, n, CAST(total IS NULL AS INTEGER) AS missing, round(ln(1 + total), 6) AS log_total FROM grid")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with missingness indicators and log1p of what is present."""
    return month_grid(spark, sf_dir).select("month", "nation", F.round("total", 2).alias("total"), "n", F.col("total").isNull().cast("int").alias("missing"), F.round(F.log1p("total"), 6).alias("log_total"))


@query(f"""WITH {GRID}, e AS (SELECT month, nation, lead(month, 2) OVER (PARTITION BY nation ORDER BY month) AS ends FROM grid)
 SELECT month, nation, ends, CASE {" ".join(f"WHEN month >= DATE '{a}' AND month <= DATE '{b}' AND ends <= DATE '{b}' THEN '{k}'" for k, (a, b) in BLOCKS.items())} END AS split FROM e""")
def fold_split_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological blocks; rows whose label ends after their block belong to none."""
    g = month_grid(spark, sf_dir).withColumn("ends", F.lead("month", 2).over(Window.partitionBy("nation").orderBy("month")))
    return g.select("month", "nation", "ends", C.split_of(F.col("month"), F.col("ends"), BLOCKS).alias("split"))


@query(f"""WITH {GRID}, folds AS (SELECT *, year(month) AS fold FROM grid) SELECT a.fold AS predicts, b.fold AS learns, count(*) AS rows FROM (SELECT DISTINCT fold FROM folds) a JOIN folds b ON b.fold < a.fold GROUP BY 1, 2""")
def prequential_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of earlier folds that each fold may learn from (folds are years; rows are counted before the join)."""
    per = month_grid(spark, sf_dir).groupBy(F.year("month").cast("long").alias("learns")).agg(F.count("*").alias("rows"))
    return per.select(F.col("learns").alias("predicts")).join(per, F.col("learns") < F.col("predicts"))


_FFILL = f"""WITH {GRID}, s AS (SELECT month, nation, CASE WHEN n >= 8 THEN total END AS v FROM grid), f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM s)
 SELECT month, nation, round(carried, 2) AS carried, round(lag(carried) OVER w, 2) AS lag1, round(lag(carried) OVER w - lag(carried, 2) OVER w, 2) + 0.0 AS diff1 FROM f WINDOW w AS (PARTITION BY nation ORDER BY month)"""


@query(_FFILL)
def market_context_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse series carried forward on the calendar, with its lag and the lag's change."""
    s = month_grid(spark, sf_dir).withColumn("v", F.when(F.col("n") >= 8, F.col("total")))
    f = s.withColumn("carried", R.carried(F.col("v"), ["nation"], ["month"]))
    w = Window.partitionBy("nation").orderBy("month")
    return f.select("month", "nation", F.round("carried", 2).alias("carried"), F.round(F.lag("carried").over(w), 2).alias("lag1"), (F.round(F.lag("carried").over(w) - F.lag("carried", 2).over(w), 2) + F.lit(0.0)).alias("diff1"))


@query(f"""WITH {GRID}, f AS (SELECT month, nation, sum(n) AS c, max(CASE WHEN n > 20 THEN 1 ELSE 0 END) AS busy FROM grid WHERE n > 5 GROUP BY 1, 2) SELECT g.month, g.nation, CAST(coalesce(c, 0) AS BIGINT) AS releases, coalesce(busy, 0) AS busy FROM grid g LEFT JOIN f USING (month, nation)""")
def macro_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = month_grid(spark, sf_dir)
    flags = g.where("n > 5").groupBy("month", "nation").agg(F.sum("n").alias("releases"), F.max((F.col("n") > 20).cast("int")).alias("busy"))
    return g.select("month", "nation").join(flags, ["month", "nation"], "left").fillna(0, ["releases", "busy"])


_N = 24



PRIOR = f"""WITH {GRID}, h AS (SELECT month, nation, total AS v, list_filter(list(total) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN {_N} PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS h FROM grid)"""


def _prior(spark: SparkSession, sf_dir: str):
    return month_grid(spark, sf_dir), R.rows(["nation"], ["month"], -_N, -1)


@query(f"{PRIOR} SELECT month, nation, CASE WHEN len(h) = {_N} AND v IS NOT NULL THEN round((len(list_filter(h, lambda x: x < v)) + 0.5 * len(list_filter(h, lambda x: x = v))) / {_N}, 6) END AS midrank FROM h")
def prior_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = _prior(spark, sf_dir)
    return g.select("month", "nation", F.round(R.prior_midrank(F.col("total"), w, _N), 6).alias("midrank"))


@query(f"{PRIOR} SELECT month, nation, CASE WHEN len(h) = {_N} THEN round(v - list_median(h), 4) + 0.0 END AS delta FROM h")
def prior_median_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = _prior(spark, sf_dir)
    return g.select("month", "nation", (F.round(R.prior_median_delta(F.col("total"), w, _N), 4) + F.lit(0.0)).alias("delta"))


_BURST = f"""WITH {GRID}, h AS (SELECT month, nation, ln(1 + n) AS v, list(ln(1 + n)) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN {_N} PRECEDING AND 1 PRECEDING) AS h FROM grid),
 m AS (SELECT *, list_median(h) AS med FROM h), d AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - med))) AS mad FROM m)
 SELECT month, nation, CASE WHEN len(h) = {_N} AND mad > 0 THEN round((v - med) / (1.4826 * mad), 6) + 0.0 END AS burst FROM d"""


@query(_BURST)
def mad_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = _prior(spark, sf_dir)
    h = g.select("month", "nation", F.log1p("n").alias("v")).withColumn("h", F.collect_list("v").over(w))
    return h.select("month", "nation", (F.round(R.robust_burst(F.col("v"), F.col("h"), _N), 6) + F.lit(0.0)).alias("burst"))


_HL = 8
_EWMA = f"""CASE WHEN len(h) = {_N} THEN list_sum(list_transform(h, lambda x, i: x * pow(0.5, ({_N} - i) / {_HL}.0))) / {sum(0.5 ** ((_N - 1 - k) / _HL) for k in range(_N))} END"""


@query(f"{PRIOR} SELECT month, nation, round({_EWMA}, 2) AS ewma, round(v - {_EWMA}, 2) + 0.0 AS innovation FROM h")
def prior_ewma_innovation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, w = _prior(spark, sf_dir)
    e = g.withColumn("e", R.prior_ewma(F.col("total"), w, _N, _HL))
    return e.select("month", "nation", F.round("e", 2).alias("ewma"), (F.round(F.col("total") - F.col("e"), 2) + F.lit(0.0)).alias("innovation"))


@query(f"""WITH {GRID}, s AS (SELECT *, row_number() OVER w AS k, lag(n, 20) OVER w AS stale, lag(month, 20) OVER w AS donor FROM grid WINDOW w AS (PARTITION BY nation ORDER BY month)) SELECT month, nation, stale, donor, CAST(k > 20 AS INTEGER) AS available FROM s""")
def stale20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control: the value of 20 sessions before, its donor session, and whether there is one."""
    w = Window.partitionBy("nation").orderBy("month")
    return month_grid(spark, sf_dir).select("month", "nation", F.lag("n", 20).over(w).alias("stale"), F.lag("month", 20).over(w).alias("donor"), (F.row_number().over(w) > 20).cast("int").alias("available"))


_WRONG = f"""WITH {GRID}, names AS (SELECT n_nationkey AS nation, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER w) AS donor FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)), d AS (SELECT month, nation, n FROM grid)
 SELECT g.month, g.nation, m.donor, g.n AS own, d.n AS donated FROM grid g JOIN names m USING (nation) JOIN d ON d.month = g.month AND d.nation = m.donor"""


@query(_WRONG)
def wrong_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control: each entity gets the value of the next one of its group by name, the last that of the first."""
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    donors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)).alias("donor"))
    g = month_grid(spark, sf_dir).select("month", "nation", "n")
    other = g.select("month", F.col("nation").alias("donor"), F.col("n").alias("donated"))
    return g.join(F.broadcast(donors), "nation").join(other, ["month", "donor"]).select("month", "nation", "donor", F.col("n").alias("own"), "donated")
