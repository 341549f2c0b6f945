"""Bars, interval returns, and co-movement components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ohlc(events: DataFrame) -> DataFrame:
    """Quarter-day bars of each event type: open and close by time (event_id breaks ties), volume is the count."""
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("int").alias("bucket")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"), F.sum(F.col("value") ** 2).alias("sq")
    )


def interval_returns(bars: DataFrame) -> DataFrame:
    """Log returns: overnight (last close of the day before to open), first bar open to close, then close to close.

    A return exists only if the bar or day right before it was observed.
    """
    w = Window.partitionBy("symbol").orderBy("day", "bucket")
    prev = bars.select("*", F.lag("close").over(w).alias("pc"), F.lag("bucket").over(w).alias("pb"), F.lag("day").over(w).alias("pd"))
    night = prev.where("bucket = 0 and pb = 3 and datediff(day, pd) = 1").select("symbol", "day", F.lit("overnight").alias("key"), F.log(F.col("open") / F.col("pc")).alias("r"))
    first = prev.where("bucket = 0").select("symbol", "day", F.lit("b0").alias("key"), F.log(F.col("close") / F.col("open")).alias("r"))
    rest = prev.where("bucket > 0 and pd = day and pb = bucket - 1").select("symbol", "day", F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("key"), F.log(F.col("close") / F.col("pc")).alias("r"))
    return night.unionByName(first).unionByName(rest)


def pair_components(returns: DataFrame, least: int = 4) -> DataFrame:
    """Daily sums of products and squares of unordered pairs on shared intervals, and of their negative parts.

    The negative covariance takes intervals where both legs are below zero, a negative variance those of its own leg.
    All sums are null unless at least `least` intervals are shared, the overnight one among them.
    """
    a, b = returns.alias("a"), returns.alias("b")
    both = a.join(b, (F.col("a.day") == F.col("b.day")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.symbol") < F.col("b.symbol")))
    x, y = F.col("a.r"), F.col("b.r")
    zero = F.lit(0.0)
    sums = both.groupBy(F.col("a.symbol").alias("x"), F.col("b.symbol").alias("y"), F.col("a.day").alias("day")).agg(
        F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"),
        F.sum(F.when((x < 0) & (y < 0), x * y).otherwise(zero)).alias("nxy"), F.sum(F.when(x < 0, x * x).otherwise(zero)).alias("nxx"), F.sum(F.when(y < 0, y * y).otherwise(zero)).alias("nyy"),
        F.count("*").alias("n"), F.max((F.col("a.key") == "overnight").cast("int")).alias("night"),
    )
    good = (F.col("n") >= least) & (F.col("night") == 1)
    return sums.select("x", "y", "day", *[F.when(good, F.col(c)).alias(c) for c in ("xy", "xx", "yy", "nxy", "nxx", "nyy")], "n")


def correlation(xy, xx, yy):
    """xy / sqrt(xx * yy) within [-1, 1]; null where that isn't defined."""
    base = F.col(xx) * F.col(yy) if isinstance(xx, str) else xx * yy
    top = F.col(xy) if isinstance(xy, str) else xy
    return F.when(base > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), top / F.sqrt(base))))


def complete_days(returns: DataFrame, expected: list[str]) -> DataFrame:
    """Daily log and simple returns of days whose set of intervals is exactly the expected one."""
    keys = F.array(*[F.lit(k) for k in sorted(expected)])
    days = returns.groupBy("symbol", "day").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.count("*").alias("n"), F.sum("r").alias("log_return"))
    return days.where((F.col("keys") == keys) & (F.col("n") == len(expected))).select("symbol", "day", "log_return", F.expm1("log_return").alias("simple_return"))


def equal_weight_others(returns: DataFrame, members: int) -> DataFrame:
    """For each symbol, the log return of the equally weighted basket of all others, where all of them are observed."""
    w = Window.partitionBy("day", "key")
    simple = F.expm1("r")
    basket = returns.select("symbol", "day", "key", F.col("r").alias("own"), F.count("*").over(w).alias("n"), ((F.sum(simple).over(w) - simple) / (members - 1)).alias("m"))
    return basket.where(F.col("n") == members).select("symbol", "day", "key", "own", F.log1p("m").alias("basket"))
