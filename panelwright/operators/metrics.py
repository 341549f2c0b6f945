"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_metrics(actual: Column, predicted: Column, baseline: Column) -> list[Column]:
    e2, b2 = (actual - predicted) ** 2, (actual - baseline) ** 2
    return [F.count("*").alias("n"), F.sqrt(F.avg(e2)).alias("rmse"), F.avg(F.abs(actual - predicted)).alias("mae"), F.try_divide(F.sum(b2) - F.sum(e2), F.sum(b2)).alias("oos_r2")]


def label_metrics(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, majority baseline, Cohen's kappa and macro-F1 over classes with support, from the confusion counts."""
    counts = pairs.groupBy(truth, guess).agg(F.count("*").alias("k"))
    t = counts.groupBy(F.col(truth).alias("c")).agg(F.sum("k").alias("t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("k")).otherwise(0)).alias("hit"))
    g = counts.groupBy(F.col(guess).alias("c")).agg(F.sum("k").alias("g"))
    both = t.join(g, "c", "full").fillna(0, ["t", "hit", "g"])
    f1 = F.when(F.col("t") > 0, F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("t") + F.col("g"))).otherwise(0.0))
    n = F.sum("t").cast("double")
    agreed, chance = F.sum("hit") / n, F.sum(F.col("t") * F.col("g")) / (n * n)
    return both.agg(F.sum("t").alias("n"), agreed.alias("accuracy"), (F.max("t") / n).alias("majority"), F.try_divide(agreed - chance, 1 - chance).alias("kappa"), F.avg(f1).alias("macro_f1"))


def newey_west(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """Mean and its Bartlett t-statistic per key."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("m", F.avg(value).over(w)).withColumn("u", F.col(value) - F.col("m"))
    d = d.withColumns({f"u{k}": F.col("u") * F.lag("u", k).over(w.orderBy(order)) for k in range(1, lags + 1)})
    n = F.count(value)
    long_run = F.sum(F.col("u") ** 2) / n
    for k in range(1, lags + 1):
        long_run = long_run + F.lit(2.0 * (1 - k / (lags + 1))) * F.coalesce(F.sum(f"u{k}"), F.lit(0.0)) / n
    return d.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(long_run > 0, F.avg(value) / F.sqrt(long_run / n)).alias("t_stat"))


def exact_binomial_p(x, y):
    """Two-sided probability of x against y successes under even odds; terms by a running ratio, from the centre's scale."""
    n, k = x + y, F.least(x, y)
    step = lambda acc, i: F.struct((acc["log"] + F.log((n - i + 1) / i)).alias("log"), (acc["tail"] + F.exp(acc["log"] + F.log((n - i + 1) / i))).alias("tail"))
    log0 = -n * F.log(F.lit(2.0))
    start = F.struct(log0.alias("log"), F.exp(log0).alias("tail"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step)["tail"]))
