"""Fitted models against plain re-computation: penalised regressions by fold, volatility and correlation likelihoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import models as O


def panel(rng) -> pd.DataFrame:
    x = rng.normal(size=(600, 3))
    x[rng.random((600, 3)) < 0.05] = np.nan
    y = np.nan_to_num(x) @ [1.0, 0.0, -0.5] + rng.normal(size=600)
    return pd.DataFrame({"fold": np.arange(600) // 100, "y": y, "a": x[:, 0], "b": x[:, 1] * 5 + 2, "c": x[:, 2]})


@pytest.mark.parametrize("grid", [[(0.0, 1.0)], [(0.01, 1.0), (0.3, 1.0)], [(0.05, 0.5), (0.5, 0.2)]])
def test_fold_models_equal_row_fits(spark, grid):
    df, features = panel(np.random.default_rng(2)), ["a", "b", "c"]
    rows = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.astype(object).itertuples(index=False)], "fold long, y double, a double, b double, c double").repartition(5)
    got = {r.test_fold: r for r in O.fold_models(rows, "fold", "y", features, {"r": grid}).collect()}
    assert sorted(got) == [2, 3, 4, 5]

    def ready(train):
        median = train[features].median()
        x = train[features].fillna(median).to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        return (x - mean) / sd, lambda f: (f[features].fillna(median).to_numpy(float) - mean) / sd

    for k, r in got.items():
        train, valid, past = df[df.fold < k - 1], df[df.fold == k - 1], df[df.fold < k]
        x, put = ready(train)
        y = train.y.to_numpy()
        errors = [((put(valid) @ O.elastic_net(x, y - y.mean(), a, q) + y.mean() - valid.y) ** 2).mean() for a, q in grid]
        best = int(np.argmin(errors))
        assert (r.alpha, r.ratio) == grid[best] and abs(r.valid_error - errors[best]) < 1e-6
        x, _ = ready(past)
        y = past.y.to_numpy()
        assert np.allclose(r.standardised, O.elastic_net(x, y - y.mean(), *grid[best]), atol=1e-5)


def test_garch_fit_finds_the_likelihood_s_maximum():
    rng = np.random.default_rng(19)
    s2, r = 1.0, []
    for _ in range(800):
        r.append(np.sqrt(s2) * rng.normal())
        s2 = 0.1 + 0.15 * r[-1] ** 2 + 0.75 * s2
    r = np.array(r)
    r[40:45] = np.nan
    omega, alpha, beta, loss = O.fit_garch(r)
    assert omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 1
    assert loss == O.garch_loss(r, omega, alpha, beta)
    grid = [O.garch_loss(r, w, a, b) for w in (0.05, 0.1, 0.2, 0.4) for a in (0.05, 0.1, 0.15, 0.2, 0.3) for b in (0.5, 0.6, 0.7, 0.75, 0.8) if a + b < 1]
    assert loss <= min(grid) + 1e-6 and abs(alpha - 0.15) < 0.1 and abs(beta - 0.75) < 0.2


def test_dcc_fit_beats_a_grid():
    rng = np.random.default_rng(20)
    rho = 0.7 * np.sin(np.arange(400) / 40)
    x = rng.normal(size=400)
    e = np.column_stack([x, rho * x + np.sqrt(1 - rho**2) * rng.normal(size=400)])
    e[7, 1] = np.nan
    a, b, loss = O.fit_dcc(e)
    assert a >= 0 and b >= 0 and a + b < 1
    assert loss <= min(O.dcc_loss(e, p, q) for p in (0.01, 0.05, 0.1, 0.2) for q in (0.0, 0.5, 0.7, 0.85) if p + q < 1) + 1e-6


def test_filters_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    x[5, 0] = np.nan
    df = spark.createDataFrame([("a", "b", i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "l string, r string, day long, x double, y double")
    got = [r.rho for r in O.dcc_filter(df, ["l", "r"], "day", 0.1, 0.8).orderBy("day").collect()]
    good = x[~np.isnan(x).any(1)]
    bar = good.T @ good / len(good)
    q, want = bar, []
    for v in x:
        want.append(q[0, 1] / np.sqrt(q[0, 0] * q[1, 1]))
        q = 0.1 * bar + 0.1 * (q if np.isnan(v).any() else np.outer(v, v)) + 0.8 * q
    assert np.allclose(got, want)


def test_simplex():
    assert np.allclose(O.simplex(lambda u: (u[0] - 3) ** 2 + 10 * (u[1] + 1) ** 2, np.zeros(2)), [3, -1], atol=1e-3)
