"""Recursive and regression models per group, in Arrow batches: no expression carries their state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def garch_filter(df: DataFrame, key: str, order: str, value: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """Conditional variances s2[t] = omega + alpha * r[t-1]^2 + beta * s2[t-1]; a missing r is replaced by its expectation.

    One ordered group a task: the recursion runs along a key's own sessions, so a group is as long as the calendar.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        r = rows[value].to_numpy(float)
        s2, out = omega / (1 - alpha - beta), np.empty(len(r))
        for t, x in enumerate(r):
            out[t] = s2
            s2 = omega + alpha * (s2 if np.isnan(x) else x * x) + beta * s2
        return pd.DataFrame({key: rows[key], order: rows[order], value: r, "variance": out, "residual": r / np.sqrt(out)})

    kinds = dict(df.dtypes)
    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, variance double, residual double")


def dcc_filter(df: DataFrame, key: list[str], order: str, a: float, b: float) -> DataFrame:
    """Dynamic correlation of residual columns x and y: Q[t+1] = (1-a-b) Qbar + a e e' + b Q, missing e as expected."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        e = rows[["x", "y"]].to_numpy(float)
        whole = e[~np.isnan(e).any(1)]
        bar = whole.T @ whole / max(1, len(whole)) if len(whole) else np.eye(2)
        q, out = bar.copy(), np.empty(len(e))
        for t, x in enumerate(e):
            out[t] = np.clip(q[0, 1] / np.sqrt(max(q[0, 0] * q[1, 1], 1e-300)), -1, 1)
            q = (1 - a - b) * bar + a * (q if np.isnan(x).any() else np.outer(x, x)) + b * q
        return rows[[*key, order]].assign(rho=out)

    kinds = dict(df.dtypes)
    return df.groupBy(*key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*key, order]) + ", rho double")


def simplex(f, start: np.ndarray, steps: int = 400, size: float = 0.5) -> np.ndarray:
    """A minimum of f by the downhill simplex method: reflect, expand, contract, shrink."""
    points = [np.asarray(start, float)] + [start + size * e for e in np.eye(len(start))]
    values = [f(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], 0)
        put = lambda t: centre + t * (points[-1] - centre)  # noqa: B023, E731
        x = put(-1.0)
        y = f(x)
        if y < values[0]:
            far = put(-2.0)
            z = f(far)
            x, y = (far, z) if z < y else (x, y)
        elif y >= values[-2]:
            x = put(0.5 if y >= values[-1] else -0.5)
            y = f(x)
            if y >= min(values[-1], f(put(-1.0))):
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = x, y
    return points[int(np.argmin(values))]


def _logistic(u: float) -> float:
    return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def garch_loss(r: np.ndarray, omega: float, alpha: float, beta: float) -> float:
    """Mean Gaussian negative log likelihood, less a constant; a missing r adds nothing and is replaced by its expectation."""
    s2, total, n = omega / (1 - alpha - beta), 0.0, 0
    for x in r:
        if x == x:
            total, n = total + np.log(s2) + x * x / s2, n + 1
        s2 = omega + alpha * (s2 if x != x else x * x) + beta * s2
    return 0.5 * total / max(1, n)


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """omega, alpha, beta of the largest likelihood with positive terms and alpha + beta < 1, and the mean loss."""
    var = float(np.nanmean(np.square(r))) if np.isfinite(r).any() else 1.0

    def parts(u: np.ndarray) -> tuple[float, float, float]:
        whole, share = 0.9999 * _logistic(u[1]), _logistic(u[2])
        return var * np.exp(np.clip(u[0], -20, 5)), whole * share, whole * (1 - share)

    if var <= 0:
        return 0.0, 0.0, 0.0, 0.0
    starts = [np.array([np.log(1 - w), np.log(w / (1 - w)), np.log(a / (1 - a))]) for w, a in ((0.95, 0.1), (0.5, 0.5), (0.1, 0.5))]
    best = min((simplex(lambda u: garch_loss(r, *parts(u)), u0) for u0 in starts), key=lambda u: garch_loss(r, *parts(u)))
    return (*parts(best), garch_loss(r, *parts(best)))


def dcc_loss(e: np.ndarray, a: float, b: float) -> float:
    """Mean negative log likelihood of the correlation part, over complete rows of two residuals."""
    good = ~np.isnan(e).any(1)
    bar = e[good].T @ e[good] / max(1, good.sum())
    q, total = bar.copy(), 0.0
    for x, ok in zip(e, good, strict=True):
        if ok:
            rho = np.clip(q[0, 1] / np.sqrt(max(q[0, 0] * q[1, 1], 1e-300)), -0.9999, 0.9999)
            total += np.log(1 - rho * rho) + (x[0] ** 2 - 2 * rho * x[0] * x[1] + x[1] ** 2) / (1 - rho * rho) - x[0] ** 2 - x[1] ** 2
        q = (1 - a - b) * bar + a * (np.outer(x, x) if ok else q) + b * q
    return 0.5 * total / max(1, good.sum())


def fit_dcc(e: np.ndarray) -> tuple[float, float, float]:
    """a, b of the largest likelihood with a, b >= 0 and a + b < 1, and the mean loss."""

    def parts(u: np.ndarray) -> tuple[float, float]:
        whole, share = 0.9999 * _logistic(u[0]), _logistic(u[1])
        return whole * share, whole * (1 - share)

    best = min((simplex(lambda u: dcc_loss(e, *parts(u)), np.array(u0), 150) for u0 in ([2.0, -2.0], [-2.0, 0.0])), key=lambda u: dcc_loss(e, *parts(u)))
    return (*parts(best), dcc_loss(e, *parts(best)))


def fitted_garch(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, omega, alpha, beta, loss by maximum likelihood; one ordered group a task, as long as the calendar."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([(rows[key].iat[0], *fit_garch(r))], columns=[key, "omega", "alpha", "beta", "loss"])

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, omega double, alpha double, beta double, loss double")


def fitted_dcc(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, a, b, loss of pairs' residual columns x and y by maximum likelihood."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        e = rows.sort_values(order)[["x", "y"]].to_numpy(float)
        return pd.DataFrame([(*rows[key].iloc[0], *fit_dcc(e))], columns=[*key, "a", "b", "loss"])

    kinds = dict(df.dtypes)
    return df.groupBy(*key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", a double, b double, loss double")


def rolling_two_factors(y: Column, x1: Column, x2: Column, w, least: int) -> dict[str, Column]:
    """Trailing regression on two factors by windowed covariances: intercept, slopes and R2; null on too few or collinear rows."""
    n = F.count(y + x1 + x2).over(w)
    v1, v2, vy = (F.var_pop(c).over(w) for c in (x1, x2, y))
    c12, c1, c2 = F.covar_pop(x1, x2).over(w), F.covar_pop(x1, y).over(w), F.covar_pop(x2, y).over(w)
    det = v1 * v2 - c12 * c12
    good = lambda c: F.when((n >= least) & (det > 1e-12 * v1 * v2), c)
    b1, b2 = (c1 * v2 - c2 * c12) / det, (c2 * v1 - c1 * c12) / det
    a = F.avg(y).over(w) - b1 * F.avg(x1).over(w) - b2 * F.avg(x2).over(w)
    return {"intercept": good(a), "beta_1": good(b1), "beta_2": good(b2), "r2": good(F.when(vy > 0, (b1 * c1 + b2 * c2) / vy))}


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, ratio: float, steps: int = 500) -> np.ndarray:
    """Coordinate descent for 1/(2n)|y - xw|^2 + alpha (ratio |w|_1 + (1 - ratio)/2 |w|^2) on standardised columns."""
    n, w, r = len(y), np.zeros(x.shape[1]), y.astype(float).copy()
    scale = (x**2).sum(0) / n
    for _ in range(steps):
        most = 0.0
        for j in range(x.shape[1]):
            if scale[j] == 0:
                continue
            rho = x[:, j] @ r / n + scale[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (scale[j] + alpha * (1 - ratio))
            if new != w[j]:
                r += x[:, j] * (w[j] - new)
                most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-10:
            break
    return w


def elastic_net_of(c: np.ndarray, g: np.ndarray, alpha: float, ratio: float, steps: int = 1000) -> np.ndarray:
    """elastic_net() from the correlations of standardised columns `c` and their covariances with the target `g`."""
    w = np.zeros(len(g))
    for _ in range(steps):
        most = 0.0
        for j in range(len(g)):
            if c[j, j] == 0:
                continue
            rho = g[j] - c[j] @ w + c[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (c[j, j] + alpha * (1 - ratio))
            most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-10:
            break
    return w


def linear_of(gram: np.ndarray, alpha: float, ratio: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, slopes and standardised slopes from sums of products of (1, features, target)."""
    n = gram[0, 0]
    mean, my = gram[0, 1:-1] / n, gram[0, -1] / n
    cov = gram[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = sd <= 1e-12 * (1 + np.abs(mean))
    sd = np.where(flat, 1.0, sd)
    c = cov / np.outer(sd, sd)
    c[flat], c[:, flat] = 0, 0
    w = elastic_net_of(c, np.where(flat, 0, (gram[1:-1, -1] / n - mean * my) / sd), alpha, ratio)
    return float(my - (w / sd) @ mean), w / sd, w


def squared_error(gram: np.ndarray, intercept: float, slopes: np.ndarray) -> float:
    """Mean squared error of a linear model, from sums of products."""
    v = np.concatenate([[intercept], slopes, [-1.0]])
    return float(v @ gram @ v / gram[0, 0])


def fold_models(df: DataFrame, fold: str, target: str, features: list[str], rungs: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(test_fold, rung, alpha, ratio, valid_error, intercept, slopes, standardised) of linear models per fold and rung.

    A rung is a grid of (alpha, ratio): the pair with the least error on the last fold before the test fold, of models
    fitted on the folds before that, is fitted again on both. Missing features get the median of the rows fitted on.
    Tasks add up products by fold; what a fit sees is one matrix of sums a fold, whatever the number of rows.
    """
    folds = df.select(F.col(fold).alias("test_fold")).distinct()
    before = folds.withColumn("last", F.lag("test_fold").over(Window.orderBy("test_fold"))).where("last is not null")
    past = df.where(F.col(target).isNotNull()).select(F.col(fold).alias("own"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).join(F.broadcast(before), F.col("own") < F.col("test_fold"))
    valid = F.col("own") == F.col("last")
    # fitted on: the folds before the last one, to choose; all of them, to predict
    stages = F.array(F.struct(F.lit("choose").alias("stage"), F.when(valid, "valid").otherwise("fit").alias("part")), F.struct(F.lit("predict").alias("stage"), F.lit("fit").alias("part")))
    rows = past.withColumn("s", F.explode(stages)).select("*", "s.stage", "s.part").drop("s")
    medians = rows.where("part = 'fit'").groupBy("test_fold", "stage").agg(*[F.percentile(f, 0.5).alias(f"m_{f}") for f in features])
    filled = rows.join(F.broadcast(medians), ["test_fold", "stage"]).select("test_fold", "stage", "part", F.lit(1.0).alias("one"), *[F.coalesce(f, f"m_{f}", F.lit(0.0)).alias(f) for f in features], "y")
    names = ["one", *features, "y"]
    sums = F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]])
    grams = filled.groupBy("test_fold", "stage", "part").agg(sums.alias("g"))
    of = lambda stage, part: F.max(F.when((F.col("stage") == stage) & (F.col("part") == part), F.col("g")))
    wide = grams.groupBy("test_fold").agg(of("choose", "fit").alias("fit"), of("choose", "valid").alias("valid"), of("predict", "fit").alias("both")).where("fit is not null and valid is not null")

    def run(batches):
        upper = np.triu_indices(len(names))
        for batch in batches:
            out = []
            for row in batch.itertuples():
                whole = {}
                for name in ("fit", "valid", "both"):
                    m = np.zeros((len(names),) * 2)
                    m[upper] = getattr(row, name)
                    whole[name] = m + np.triu(m, 1).T
                for rung, grid in rungs.items():
                    errors = [squared_error(whole["valid"], *linear_of(whole["fit"], *g)[:2]) for g in grid]
                    best = int(np.argmin(errors))
                    intercept, slopes, standardised = linear_of(whole["both"], *grid[best])
                    out.append((row.test_fold, rung, *grid[best], errors[best], intercept, slopes, standardised))
            yield pd.DataFrame(out, columns=["test_fold", "rung", "alpha", "ratio", "valid_error", "intercept", "slopes", "standardised"])

    return wide.mapInPandas(run, "test_fold long, rung string, alpha double, ratio double, valid_error double, intercept double, slopes array<double>, standardised array<double>")


def fold_predictions(df: DataFrame, models: DataFrame, fold: str, target: str, keys: list[str], features: list[str]) -> DataFrame:
    """keys, test_fold, rung, actual, prediction: each row by its fold's models; missing features count as 0 in standard units."""
    known = df.select(F.col(fold).alias("test_fold"), *keys, F.col(target).alias("actual"), *features).dropna(subset=features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    z = F.col("intercept") + F.aggregate(F.zip_with("slopes", x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return known.join(F.broadcast(models), "test_fold").select(*keys, "test_fold", "rung", "actual", z.alias("prediction"))
