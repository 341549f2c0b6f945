"""Bars to co-movement: interval returns, pair components, rolling and exponential correlations, targets, betas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import rolling as R
from ..sources.tables import table
from .registry import query

# Half the horizons' names are windows in sessions.
HORIZONS = (1, 5, 21)

BARS = """bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, CAST(floor(hour(ts) / 6.0) AS INTEGER) AS bucket,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume, sum(value * value) AS sq
 FROM events GROUP BY 1, 2, 3)"""
RETURNS = f"""{BARS}, prev AS (SELECT *, lag(close) OVER w AS pc, lag(bucket) OVER w AS pb, lag(day) OVER w AS pd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day, bucket)),
 returns AS (SELECT symbol, day, 'overnight' AS key, ln(open / pc) AS r FROM prev WHERE bucket = 0 AND pb = 3 AND day - pd = 1
 UNION ALL SELECT symbol, day, 'b0', ln(close / open) FROM prev WHERE bucket = 0
 UNION ALL SELECT symbol, day, 'b' || bucket, ln(close / pc) FROM prev WHERE bucket > 0 AND pd = day AND pb = bucket - 1)"""
PAIRS = f"""{RETURNS}, raw AS (SELECT a.symbol AS x, b.symbol AS y, a.day AS day, sum(a.r * b.r) AS xy, sum(a.r * a.r) AS xx, sum(b.r * b.r) AS yy,
 sum(CASE WHEN a.r < 0 AND b.r < 0 THEN a.r * b.r ELSE 0 END) AS nxy, sum(CASE WHEN a.r < 0 THEN a.r * a.r ELSE 0 END) AS nxx, sum(CASE WHEN b.r < 0 THEN b.r * b.r ELSE 0 END) AS nyy,
 count(*) AS n, max(CASE WHEN a.key = 'overnight' THEN 1 ELSE 0 END) AS night
 FROM returns a JOIN returns b ON a.day = b.day AND a.key = b.key AND a.symbol < b.symbol GROUP BY 1, 2, 3),
 comp AS (SELECT x, y, day, n, {", ".join(f"CASE WHEN n >= 4 AND night = 1 THEN {c} END AS {c}" for c in ("xy", "xx", "yy", "nxy", "nxx", "nyy"))} FROM raw)"""


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ohlc(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


@query(f"WITH {BARS} SELECT symbol, day, bucket, open, high, low, close, volume FROM bars")
def ohlc_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir).drop("sq")


@query(f"WITH {RETURNS} SELECT symbol, day, key, round(r, 6) + 0.0 AS r FROM returns")
def interval_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.interval_returns(bars_of(spark, sf_dir)), "r")


_SIX = ("xy", "xx", "yy", "nxy", "nxx", "nyy")


@query(f"WITH {PAIRS} SELECT x, y, day, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SIX)} FROM comp")
def pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.pair_components(B.interval_returns(bars_of(spark, sf_dir))), *_SIX)


def _corr_sql(xy: str, xx: str, yy: str) -> str:
    return f"CASE WHEN {xx} * {yy} > 0 THEN round(greatest(-1.0, least(1.0, {xy} / sqrt({xx} * {yy}))), 6) + 0.0 END"


def _har_sql() -> str:
    frames = ", ".join(f"CASE WHEN count({c}) OVER w{h} = {h} THEN sum({c}) OVER w{h} END AS {c}{h}" for h in HORIZONS for c in _SIX)
    windows = ", ".join(f"w{h} AS (PARTITION BY x, y ORDER BY day ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)" for h in HORIZONS)
    out = ", ".join(f"{_corr_sql(f'xy{h}', f'xx{h}', f'yy{h}')} AS har_{h}, {_corr_sql(f'nxy{h}', f'nxx{h}', f'nyy{h}')} AS neg_har_{h}" for h in HORIZONS)
    return f"WITH {PAIRS}, sums AS (SELECT x, y, day, {frames} FROM comp WINDOW {windows}) SELECT x, y, day, {out} FROM sums"


@query(_har_sql())
def har_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components summed over 1, 5 and 21 sessions, then normalised; null unless every session of the frame is whole."""
    comp = B.pair_components(B.interval_returns(bars_of(spark, sf_dir)))
    out = comp
    for h in HORIZONS:
        w = R.rows(["x", "y"], ["day"], -(h - 1), 0)
        out = out.withColumns({f"{c}{h}": R.guarded(F.sum, F.col(c), w, h) for c in _SIX})
    keep = {f"{p}har_{h}": F.round(B.correlation(f"{s}xy{h}", f"{s}xx{h}", f"{s}yy{h}"), 6) + F.lit(0.0) for h in HORIZONS for p, s in (("", ""), ("neg_", "n"))}
    return out.select("x", "y", "day", *[c.alias(k) for k, c in keep.items()])


_W, _C, _LEAST = 10, 3.0, 8
_Q = _C / (_C + 1)


def _exp_sql() -> str:
    def avg(c: str) -> str:
        return f"CASE WHEN len(h) = {_W} AND {c} IS NOT NULL AND len(list_filter(h, lambda t: t.{c} IS NOT NULL)) >= {_LEAST} AND list_sum(list_transform(h, lambda t, i: CASE WHEN t.{c} IS NULL THEN 0 ELSE pow({_Q}, len(h) - i) END)) >= 0.9 * {sum(_Q**k for k in range(_W))} - 1e-12 THEN list_sum(list_transform(h, lambda t, i: CASE WHEN t.{c} IS NULL THEN 0 ELSE pow({_Q}, len(h) - i) * t.{c} END)) / list_sum(list_transform(h, lambda t, i: CASE WHEN t.{c} IS NULL THEN 0 ELSE pow({_Q}, len(h) - i) END)) END"

    return f"""WITH {PAIRS}, frames AS (SELECT x, y, day, xy, xx, yy, list({{'xy': xy, 'xx': xx, 'yy': yy}}) OVER (PARTITION BY x, y ORDER BY day ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW) AS h FROM comp),
 e AS (SELECT x, y, day, {avg("xy")} AS exy, {avg("xx")} AS exx, {avg("yy")} AS eyy FROM frames) SELECT x, y, day, {_corr_sql("exy", "exx", "eyy")} AS exp_corr FROM e"""


@query(_exp_sql())
def exp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite exponential means of components (missing values skipped, weights renormalised), as a correlation."""
    comp = B.pair_components(B.interval_returns(bars_of(spark, sf_dir)))
    w = R.rows(["x", "y"], ["day"], -(_W - 1), 0)
    e = comp.select("x", "y", "day", *[R.finite_exponential(F.col(c), w, _W, _C, _LEAST, 0.9).alias(f"e{c}") for c in ("xy", "xx", "yy")])
    return e.select("x", "y", "day", (F.round(B.correlation("exy", "exx", "eyy"), 6) + F.lit(0.0)).alias("exp_corr"))


@query(f"""WITH {PAIRS}, c AS (SELECT x, y, day, CASE WHEN xx * yy > 0 THEN greatest(-1.0, least(1.0, xy / sqrt(xx * yy))) END AS r FROM comp)
 SELECT day, count(r) AS pairs, CASE WHEN count(r) >= 8 THEN round(avg(r), 6) + 0.0 END AS state FROM c GROUP BY day""")
def sector_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation of all pairs of a day, null under eight tenths of them."""
    comp = B.pair_components(B.interval_returns(bars_of(spark, sf_dir))).withColumn("r", B.correlation("xy", "xx", "yy"))
    return comp.groupBy("day").agg(F.count("r").alias("pairs"), F.avg("r").alias("m")).select("day", "pairs", F.when(F.col("pairs") >= 8, F.round("m", 6) + F.lit(0.0)).alias("state"))


LOO = f"""{RETURNS}, loo AS (SELECT a.symbol, a.day, a.key, first(a.r) AS own, ln(1 + avg(exp(b.r) - 1)) AS basket, count(*) AS n
 FROM returns a JOIN returns b ON a.day = b.day AND a.key = b.key AND a.symbol <> b.symbol GROUP BY 1, 2, 3 HAVING count(*) = 4)"""


@query(f"WITH {LOO} SELECT symbol, day, key, round(own, 6) + 0.0 AS own, round(basket, 6) + 0.0 AS basket FROM loo")
def loo_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.equal_weight_others(B.interval_returns(bars_of(spark, sf_dir)), members=5), "own", "basket")


LOO_DAY = f"""{LOO}, daily AS (SELECT symbol, day, sum(own * basket) AS xy, sum(own * own) AS xx, sum(basket * basket) AS yy FROM loo GROUP BY 1, 2 HAVING count(*) = 5)"""


def _loo_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    loo = B.equal_weight_others(B.interval_returns(bars_of(spark, sf_dir)), members=5)
    return loo.groupBy("symbol", "day").agg(F.sum(F.col("own") * F.col("basket")).alias("xy"), F.sum(F.col("own") ** 2).alias("xx"), F.sum(F.col("basket") ** 2).alias("yy"), F.count("*").alias("n")).where("n = 5").drop("n")


def _target_sql() -> str:
    sums = ", ".join(f"CASE WHEN count({c}) OVER f = 5 THEN sum({c}) OVER f END AS f{c}, CASE WHEN count({c}) OVER l5 = 5 THEN sum({c}) OVER l5 END AS l{c}" for c in ("xy", "xx", "yy"))
    z = lambda p: f"CASE WHEN {p}xx * {p}yy > 0 THEN round(atanh(greatest(-0.995, least(0.995, {p}xy / sqrt({p}xx * {p}yy)))), 6) + 0.0 END"
    return f"""WITH {LOO_DAY}, grid AS (SELECT d.day, s.symbol FROM (SELECT DISTINCT day FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s),
 full_grid AS (SELECT g.symbol, g.day, xy, xx, yy FROM grid g LEFT JOIN daily USING (symbol, day)),
 sums AS (SELECT symbol, day, xy, xx, yy, {sums}, lead(day, 4) OVER (PARTITION BY symbol ORDER BY day) AS target_end FROM full_grid
 WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), l5 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT symbol, day, target_end, {z("")} AS t1, {z("f")} AS t2, {z("l")} AS lag5 FROM sums"""


@query(_target_sql())
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One- and five-session forward correlations as Fisher z, with the label's end and trailing lags, on the session grid."""
    daily, bars = _loo_days(spark, sf_dir), bars_of(spark, sf_dir)
    grid = bars.select("day").distinct().crossJoin(bars.select("symbol").distinct()).join(daily, ["symbol", "day"], "left")
    f, back = R.rows(["symbol"], ["day"], 0, 4), R.rows(["symbol"], ["day"], -5, -1)
    sums = grid.select("*", F.lead("day", 4).over(Window.partitionBy("symbol").orderBy("day")).alias("target_end"), *[R.guarded(F.sum, F.col(c), w, 5).alias(p + c) for p, w in (("f", f), ("l", back)) for c in ("xy", "xx", "yy")])

    def z(p: str):
        r = B.correlation(f"{p}xy", f"{p}xx", f"{p}yy")
        return F.round(F.atanh(F.greatest(F.lit(-0.995), F.least(F.lit(0.995), r))), 6) + F.lit(0.0)

    return sums.select("symbol", "day", "target_end", *[F.when(F.col(f"{p}xx") * F.col(f"{p}yy") > 0, z(p)).alias(k) for k, p in (("t1", ""), ("t2", "f"), ("lag5", "l"))])


@query(f"WITH {RETURNS} SELECT symbol, day, round(sum(r), 6) + 0.0 AS log_return, round(exp(sum(r)) - 1, 4) + 0.0 AS simple_return FROM returns GROUP BY 1, 2 HAVING list_sort(list(key)) = ['b0', 'b1', 'b2', 'b3', 'overnight']")
def complete_day_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.complete_days(B.interval_returns(bars_of(spark, sf_dir)), ["b0", "b1", "b2", "b3", "overnight"])
    return rounded(rounded(days, "log_return"), "simple_return", digits=4)


DAILY = f"""{BARS}, d AS (SELECT symbol, day, first(open ORDER BY bucket) AS open, last(close ORDER BY bucket) AS close, sum(volume) AS volume, sum(sq) AS rv, count(*) AS n FROM bars GROUP BY 1, 2)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir).groupBy("symbol", "day").agg(F.min_by("open", "bucket").alias("open"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume"), F.sum("sq").alias("rv"), F.count("*").alias("n"))


@query(f"WITH {DAILY} SELECT symbol, day, open, close, CASE WHEN n = 4 THEN CAST(volume AS BIGINT) END AS volume, CASE WHEN n = 4 THEN round(rv, 4) END AS rv FROM d")
def regular_bar_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("n") == 4
    return _daily(spark, sf_dir).select("symbol", "day", "open", "close", F.when(whole, F.col("volume")).alias("volume"), F.when(whole, F.round("rv", 4)).alias("rv"))


@query(f"""WITH {DAILY} SELECT symbol, day, CAST(lag(volume) OVER p AS BIGINT) AS lag_volume, CASE WHEN count(volume) OVER w >= 5 THEN round(lag(volume) OVER p / avg(volume) OVER w, 6) END AS rel_volume FROM d
 WINDOW p AS (PARTITION BY symbol ORDER BY day), w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING)""")
def rel_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's volume over the mean of the ten sessions before it, once five of them are there."""
    w, lag = R.rows(["symbol"], ["day"], -11, -2), F.lag("volume").over(Window.partitionBy("symbol").orderBy("day"))
    return _daily(spark, sf_dir).select("symbol", "day", lag.alias("lag_volume"), F.round(lag / R.guarded(F.avg, F.col("volume"), w, 5), 6).alias("rel_volume"))


@query(f"""WITH {DAILY}, x AS (SELECT day, CASE WHEN count(*) = 5 THEN stddev_samp(ln(close / open)) END AS s FROM d GROUP BY day) SELECT day, round(s, 6) AS dispersion, round(lag(s) OVER (ORDER BY day), 6) AS lag_dispersion FROM x""")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _daily(spark, sf_dir).groupBy("day").agg(F.when(F.count("*") == 5, F.stddev_samp(F.log(F.col("close") / F.col("open")))).alias("s"))
    return days.select("day", F.round("s", 6).alias("dispersion"), F.round(F.lag("s").over(Window.orderBy("day")), 6).alias("lag_dispersion"))


_BETA = f"""WITH {LOO}, d AS (SELECT symbol, day, sum(own) AS s, sum(basket) AS b FROM loo GROUP BY 1, 2 HAVING count(*) = 5),
 f AS (SELECT *, CASE WHEN count(*) OVER w >= 8 THEN covar_samp(s, b) OVER w / nullif(var_samp(b) OVER w, 0) END AS beta, CASE WHEN count(*) OVER v = 5 THEN sum(s) OVER v END AS s5, CASE WHEN count(*) OVER v = 5 THEN sum(b) OVER v END AS b5 FROM d
 WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT symbol, day, round(greatest(0.0, least(3.0, beta)), 6) AS beta, round(greatest(0.0, least(3.0, beta)) * b5 - s5, 6) + 0.0 AS divergence FROM f"""


@query(_BETA.replace("greatest(0.0, least(3.0, beta))", "CASE WHEN beta IS NULL THEN NULL ELSE greatest(0.0, least(3.0, beta)) END"))
def rolling_beta_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing beta to the basket (prior sessions only, within 0 and 3) and the five-session gap beta * basket - own."""
    loo = B.equal_weight_others(B.interval_returns(bars_of(spark, sf_dir)), members=5)
    d = loo.groupBy("symbol", "day").agg(F.sum("own").alias("s"), F.sum("basket").alias("b"), F.count("*").alias("n")).where("n = 5")
    w, v = R.rows(["symbol"], ["day"], -15, -1), R.rows(["symbol"], ["day"], -4, 0)
    raw = F.when(F.count("s").over(w) >= 8, F.covar_samp("s", "b").over(w) / F.nullif(F.var_samp("b").over(w), F.lit(0.0)))
    f = d.select("symbol", "day", raw.alias("raw"), R.guarded(F.sum, F.col("s"), v, 5).alias("s5"), R.guarded(F.sum, F.col("b"), v, 5).alias("b5"))
    beta = F.when(F.col("raw").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("raw"))))
    return f.select("symbol", "day", F.round(beta, 6).alias("beta"), (F.round(beta * F.col("b5") - F.col("s5"), 6) + F.lit(0.0)).alias("divergence"))
