"""Guarded trailing, forward and prior-only windows; order statistics and weighted averages over them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def rows(keys: list[str], order: list[str], first: int, last: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)


def guarded(f, column: Column, w: WindowSpec, least: int) -> Column:
    """An aggregate over a frame, null unless `least` values are present."""
    return F.when(F.count(column).over(w) >= least, f(column).over(w))


def prior_midrank(v: Column, w: WindowSpec, n: int) -> Column:
    """Share of the n values before that are smaller, ties by half; null until there are n."""
    h = F.collect_list(v).over(w)
    return F.when((F.size(h) == n) & v.isNotNull(), (F.size(F.filter(h, lambda x: x < v)) + F.size(F.filter(h, lambda x: x == v)) * 0.5) / n)


def median_of(h: Column) -> Column:
    s, n = F.array_sort(h), F.size(h)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def prior_median_delta(v: Column, w: WindowSpec, n: int) -> Column:
    h = F.collect_list(v).over(w)
    return F.when(F.size(h) == n, v - median_of(h))


def robust_burst(v: Column, h: Column, n: int) -> Column:
    """(v - median) / (1.4826 * MAD) against n prior values; null if there are fewer or the deviation is 0."""
    m = median_of(h)
    mad = median_of(F.transform(h, lambda x: F.abs(x - m)))
    return F.when((F.size(h) == n) & (mad > 0), (v - m) / (1.4826 * mad))


def prior_ewma(v: Column, w: WindowSpec, n: int, half_life: float) -> Column:
    """Weighted mean of the n prior values, the last weighing 1; all of them must be present."""
    h = F.collect_list(v).over(w)
    weights = [0.5 ** ((n - 1 - k) / half_life) for k in range(n)]
    products = F.zip_with(h, F.array(*[F.lit(x) for x in weights]), lambda x, q: x * q)
    return F.when(F.size(h) == n, F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / F.lit(sum(weights)))


def finite_exponential(v: Column, w: WindowSpec, window: int, centre: float, least: int, fraction: float) -> Column:
    """Mean with weights q^age, q = c / (c + 1), over the values present; the current one must be, with enough weight."""
    q = centre / (centre + 1)
    h = F.collect_list(F.struct(v.alias("v"))).over(w)
    n = F.size(h)
    total = F.aggregate(F.transform(h, lambda x, i: F.when(x["v"].isNotNull(), F.pow(F.lit(q), n - 1 - i) * x["v"]).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    held = F.aggregate(F.transform(h, lambda x, i: F.when(x["v"].isNotNull(), F.pow(F.lit(q), n - 1 - i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    whole = sum(q**k for k in range(window))
    present = F.size(F.filter(h, lambda x: x["v"].isNotNull()))
    return F.when((n == window) & v.isNotNull() & (present >= least) & (held >= fraction * whole - 1e-12), total / held)


def average_rank_share(partition: list[str], v: Column) -> Column:
    """Rank with ties averaged, as a share of the partition's rows."""
    w = Window.partitionBy(*partition)
    ties = Window.partitionBy(*partition, v)
    return (F.rank().over(w.orderBy(v)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(w)


def carried(v: Column, keys: list[str], order: list[str]) -> Column:
    """The last present value up to this row."""
    return F.last(v, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
