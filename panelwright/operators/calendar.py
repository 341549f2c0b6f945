"""Session calendars: sequence axis, dense grids, as-of assignment, neighbours, and purged folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequenced(sessions: DataFrame, column: str) -> DataFrame:
    """Distinct sessions with seq from 1. A calendar is small by nature: one row a session."""
    return sessions.select(column).where(F.col(column).isNotNull()).distinct().withColumn("seq", F.row_number().over(Window.orderBy(column)))


def dense(sessions: DataFrame, entities: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Every entity in every session, with what was observed there: the axis that lags must run on."""
    return sessions.crossJoin(entities).join(observed, on, "left")


def asof_forward(events: DataFrame, at: str, sessions: DataFrame, cutoff: str, strict: bool) -> DataFrame:
    """The first session whose cutoff is at or after (strictly after) each event's time, without a range join.

    Events and cutoffs are bucketed by day; a cutoff stands for every day since the cutoff before it, so that the join
    is an equality on the day and the answer the earliest fitting cutoff. Events before the first cutoff's day get that
    cutoff, however early; events after the last one get null.
    """
    w = Window.orderBy(cutoff)
    before = F.lag(F.to_date(cutoff)).over(w)
    bounds = sessions.select(cutoff).distinct().select(F.col(cutoff), F.to_date(cutoff).alias("d"), F.coalesce(before, F.to_date(cutoff)).alias("from"))
    spread = bounds.select(cutoff, F.explode(F.sequence("from", "d")).alias("d")).groupBy("d").agg(F.sort_array(F.collect_list(cutoff)).alias("cuts"))
    fits = (lambda c: c > F.col(at)) if strict else (lambda c: c >= F.col(at))
    first = sessions.agg(F.min(cutoff).alias("first_cut"))
    joined = events.withColumn("d", F.to_date(at)).join(spread, "d", "left").crossJoin(F.broadcast(first))
    early = F.when(fits(F.col("first_cut")), F.col("first_cut"))
    return joined.withColumn(cutoff, F.coalesce(F.get(F.filter("cuts", fits), F.lit(0)), early)).drop("cuts", "d", "first_cut")


def split_of(date: Column, end: Column, blocks: dict[str, tuple[str, str]]) -> Column:
    """Name of the block that holds a row's date, null if its label ends after the block (purged)."""
    out = F.lit(None).cast("string")
    for name, (first, last) in blocks.items():
        out = F.when((date >= F.lit(first).cast("date")) & (date <= F.lit(last).cast("date")) & (end <= F.lit(last).cast("date")), F.lit(name)).otherwise(out)
    return out
