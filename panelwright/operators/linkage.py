"""Record linkage: groups of records that share any key, directly or through others."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names; an own folder only where it names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="panelwright-"))
    return df.checkpoint()


def linked_groups(keys: DataFrame, record: str, key: str) -> DataFrame:
    """(record, group): the least record reachable through shared keys. Minima go from records to keys and back, and
    from records to their group's own group, until nothing changes; a key's rows are only ever aggregated."""
    keys = checkpointed(keys.select(F.col(record).alias("r"), F.col(key).alias("k")).where("r is not null and k is not null").distinct())
    labels = keys.select("r").distinct().withColumn("g", F.col("r"))
    before = None
    while True:
        least = keys.join(labels, "r").groupBy("k").agg(F.min("g").alias("m"))
        found = keys.join(least, "k").groupBy("r").agg(F.min("m").alias("g"))
        up = found.select(F.col("r").alias("g"), F.col("g").alias("above"))
        labels = checkpointed(found.join(up, "g", "left").select("r", F.least("g", F.coalesce("above", "g")).alias("g")))
        state = labels.agg(F.sum(F.col("g").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels.select(F.col("r").alias(record), F.col("g").alias("group"))
        before = state
