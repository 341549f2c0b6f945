"""Bounded samples of labelled documents."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that a model is fitted on, at most: of a longer text, that many from a place given by its doc_id.
LONGEST = 50_000


def excerpt(text: Column, doc_id: Column, most: int) -> Column:
    """`most` characters of a text from a place that a hash of its doc_id gives; all of a text that is no longer."""
    spare = F.greatest(F.length(text) - most, F.lit(0)) + 1
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, (F.pmod(F.xxhash64(doc_id), spare) + 1).cast("int"), F.lit(most)))


def sample(docs: DataFrame, labels: DataFrame, by: str, most: dict[int, int], columns: list[str]) -> pd.DataFrame:
    """At most `most[v]` labelled texts of each value v of label `by`, the first by a hash of doc_id.

    Rows with a null doc_id, text or label `by` are passed over; other labels may be null. Of repeated doc_ids one label
    row counts, the least by its labels, and one text, the least; of equal texts one counts, so no fold holds another's.
    The identifiers are at most sum(most.values()), which bounds both the broadcast and what the driver receives.
    """
    others = [c for c in columns if c != by]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(F.struct(by, *others)).alias("l")).select("doc_id", *(F.col(f"l.{c}").alias(c) for c in columns))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = reduce(DataFrame.union, [known.where(F.col(by) == v).orderBy(*order).limit(k) for v, k in most.items()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    texts = rows.select("doc_id", excerpt(F.col("text"), F.col("doc_id"), LONGEST).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("doc_id")).toPandas()
    return found.sort_values(["order", "doc_id"]).drop_duplicates("text").reset_index(drop=True)
