"""Model queries: recursive filters, rolling factor regressions, walk-forward elastic nets. Their rows have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import models as O
from .co_movement import bars_of
from .registry import query
from .sessions import GRID, month_grid


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.interval_returns(bars_of(spark, sf_dir)).groupBy("symbol", "day").agg(F.sum("r").alias("r"))
    return O.garch_filter(days, "symbol", "day", "r", omega=0.2, alpha=0.1, beta=0.8)


@query()
def garch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residuals(spark, sf_dir)


@query()
def dcc_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic correlation of every pair from their filtered residuals."""
    return O.dcc_filter(_pairs(spark, sf_dir), ["left", "right"], "day", a=0.05, b=0.9)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _residuals(spark, sf_dir)
    a, b = e.select(F.col("symbol").alias("left"), "day", F.col("residual").alias("x")), e.select(F.col("symbol").alias("right"), "day", F.col("residual").alias("y"))
    return a.join(b, "day").where("left < right").select("left", "right", "day", "x", "y")


@query()
def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility parameters of each symbol by maximum likelihood."""
    days = B.interval_returns(bars_of(spark, sf_dir)).groupBy("symbol", "day").agg(F.sum("r").alias("r"))
    return O.fitted_garch(days, "symbol", "day", "r")


@query()
def dcc_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation parameters of each pair of filtered residuals by maximum likelihood."""
    return O.fitted_dcc(_pairs(spark, sf_dir), ["left", "right"], "day")


_W = "OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"
_DET = "(v1 * v2 - c12 * c12)"


@query(f"""WITH {GRID}, t AS (SELECT month, ln(1 + sum(n)) AS market, CAST(row_number() OVER (ORDER BY month) AS DOUBLE) AS trend FROM grid GROUP BY 1), x AS (SELECT g.nation, g.month, ln(1 + g.n) AS y, market, trend FROM grid g JOIN t USING (month)),
 s AS (SELECT nation, month, count(*) {_W} AS n, var_pop(market) {_W} AS v1, var_pop(trend) {_W} AS v2, var_pop(y) {_W} AS vy, covar_pop(market, trend) {_W} AS c12, covar_pop(market, y) {_W} AS c1, covar_pop(trend, y) {_W} AS c2 FROM x)
 SELECT nation, month, CASE WHEN n >= 18 THEN round((c1 * v2 - c2 * c12) / {_DET}, 4) + 0.0 END AS beta_market, CASE WHEN n >= 18 THEN round((c2 * v1 - c1 * c12) / {_DET}, 4) + 0.0 END AS beta_trend, CASE WHEN n >= 18 AND vy > 0 THEN round((c1 * (c1 * v2 - c2 * c12) + c2 * (c2 * v1 - c1 * c12)) / {_DET} / vy, 4) + 0.0 END AS r2 FROM s""")
def factor_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing regressions of a nation's orders on the total and on a trend, by windowed covariances."""
    g = month_grid(spark, sf_dir).select("month", "nation", "n")
    total = g.groupBy("month").agg(F.log1p(F.sum("n")).alias("market")).withColumn("trend", F.row_number().over(Window.orderBy("month")).cast("double"))
    x = g.join(F.broadcast(total), "month")
    out = O.rolling_two_factors(F.log1p("n"), F.col("market"), F.col("trend"), Window.partitionBy("nation").orderBy("month").rowsBetween(-35, 0), least=18)
    digits = lambda c: F.round(c, 4) + F.lit(0.0)
    return x.select("nation", "month", digits(out["beta_1"]).alias("beta_market"), digits(out["beta_2"]).alias("beta_trend"), digits(out["r2"]).alias("r2"))


# Lags of the ladder's panel, and the rungs' grids of penalty and share of the absolute one.
LAGS = (1, 2, 3, 6, 12)
BLOCKS = {"short": ["lag1", "lag2", "lag3"], "long": ["lag1", "lag2", "lag3", "lag6", "lag12", "mean12"]}
RUNGS = {"ols": [(0.0, 1.0)], "lasso": [(a, 1.0) for a in (0.001, 0.01, 0.1)], "elastic_net": [(a, r) for a in (0.001, 0.01, 0.1) for r in (0.2, 0.5, 0.8)]}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a nation and month with lagged features, and the trailing mean."""
    w, x = Window.partitionBy("nation").orderBy("month"), F.log1p("n")
    return month_grid(spark, sf_dir).select("month", "nation", F.year("month").cast("long").alias("fold"), x.alias("y"), *[F.lag(x, k).over(w).alias(f"lag{k}") for k in LAGS], F.avg(x).over(w.rowsBetween(-12, -1)).alias("mean12"))


@query()
def walk_forward_elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each year from models of earlier years."""
    p = panel(spark, sf_dir)
    models = O.fold_models(p, "fold", "y", BLOCKS["long"], {"elastic_net": RUNGS["elastic_net"]})
    return O.fold_predictions(p, models, "fold", "y", ["month", "nation"], BLOCKS["long"])


@query()
def linear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen penalties and standardised coefficients of every rung, block of features and fold."""
    p = panel(spark, sf_dir)
    out = None
    for block, features in BLOCKS.items():
        models = O.fold_models(p, "fold", "y", features, RUNGS)
        named = F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("standardised").alias("value")))
        one = models.select("test_fold", F.lit(block).alias("block"), "rung", "alpha", "ratio", named.alias("c")).select("test_fold", "block", "rung", "alpha", "ratio", F.col("c")["feature"].alias("feature"), F.col("c")["value"].alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def model_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of persistence and of every rung by fold, on the same rows."""
    p = panel(spark, sf_dir)
    features = BLOCKS["long"]
    linear = O.fold_predictions(p, O.fold_models(p, "fold", "y", features, RUNGS), "fold", "y", ["month", "nation"], features)
    held = p.dropna(subset=features).select("month", "nation", F.col("fold").alias("test_fold"), F.lit("persistence").alias("rung"), F.col("y").alias("actual"), F.col("lag1").alias("prediction"))
    rows = linear.unionByName(held.join(linear.select("test_fold").distinct(), "test_fold", "left_semi").select(linear.columns))
    e = F.col("actual") - F.col("prediction")
    return rows.groupBy("test_fold", "rung").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


@query()
def residual_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base prediction corrected by a share of a model of its residuals; the share with the least error on the fold before.

    The base is the trailing mean; the residual model sees the short lags less that mean.
    """
    p = panel(spark, sf_dir).dropna(subset=BLOCKS["long"])
    gaps = {f"gap{k}": F.col(f"lag{k}") - F.col("mean12") for k in (1, 2, 3)}
    q = p.withColumn("e", F.col("y") - F.col("mean12")).withColumns(gaps)
    z = O.fold_predictions(q, O.fold_models(q, "fold", "e", list(gaps), {"e": RUNGS["elastic_net"]}), "fold", "e", ["month", "nation", "mean12", "y"], list(gaps))
    shares = F.explode(F.array(*[F.lit(s) for s in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("share")
    loss = z.select("test_fold", "actual", "prediction", shares).groupBy("test_fold", "share").agg(F.avg((F.col("actual") - F.col("share") * F.col("prediction")) ** 2).alias("mse"))
    best = loss.groupBy((F.col("test_fold") + 1).alias("test_fold")).agg(F.min_by("share", F.struct("mse", "share")).alias("share"))
    return z.join(F.broadcast(best), "test_fold").select("month", "nation", "test_fold", "share", F.col("y").alias("actual"), F.col("mean12").alias("base"), (F.col("mean12") + F.col("share") * F.col("prediction")).alias("prediction"))


@query()
def boosted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with early stopping on the fold before, blended with the elastic net; weight and trees by that fold.

    The trees are the library's distributed ones; the loop runs over the study's few folds. The weight in [0, 1] of least
    squared error on the validation fold is kept only if it lies strictly inside; else the linear model stands alone.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    features = BLOCKS["long"]
    p = panel(spark, sf_dir)
    linear = O.fold_predictions(p, O.fold_models(p, "fold", "y", features, {"elastic_net": RUNGS["elastic_net"]}), "fold", "y", ["month", "nation"], features)
    ready = VectorAssembler(inputCols=features, outputCol="x").transform(p.dropna(subset=[*features, "y"])).select("month", "nation", "fold", "y", "x").cache()
    folds = sorted(r.fold for r in ready.select("fold").distinct().collect())
    parts = []
    for fold in folds[2:]:
        rows = ready.where(F.col("fold") < fold).withColumn("valid", F.col("fold") == fold - 1)
        trees = GBTRegressor(featuresCol="x", labelCol="y", predictionCol="tree", maxIter=8, maxDepth=3, stepSize=0.2, seed=1729, validationIndicatorCol="valid", cacheNodeIds=False).fit(rows)
        parts.append(trees.transform(ready.where(F.col("fold").isin(fold - 1, fold))).select("month", "nation", "tree", "fold", F.lit(fold).alias("test_fold")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    j = both.join(linear.select("month", "nation", "actual", F.col("prediction").alias("line")), ["month", "nation"])
    gap, miss = F.col("tree") - F.col("line"), F.col("actual") - F.col("line")
    weight = j.where("fold = test_fold - 1").groupBy("test_fold").agg(F.try_divide(F.sum(gap * miss), F.sum(gap * gap)).alias("w"))
    inside = F.when((F.col("w") > 0) & (F.col("w") < 1), F.col("w")).otherwise(0.0)
    return j.where("fold = test_fold").join(F.broadcast(weight), "test_fold", "left").select("month", "nation", "test_fold", "actual", "line", "tree", inside.alias("weight"), (F.col("line") + inside * gap).alias("prediction"))
