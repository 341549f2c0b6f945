"""Quota matching: every key gets as many items of its own as a quota allows, each item going to one key at most."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidate rows that the one task which matches may hold.
LARGEST = 10_000_000


def fill_quotas(candidates: dict, quota: int) -> dict:
    """item -> key of a largest matching, keys taking turns; a key that finds no free item makes others move along the
    shortest chain of keys."""
    owner: dict = {}
    for _ in range(quota):
        for start in candidates:
            came, queue, end = {start: None}, deque([start]), None
            while queue and end is None:
                key = queue.popleft()
                for item in candidates[key]:
                    holder = owner.get(item)
                    if holder is None:
                        end = key, item
                        break
                    if holder not in came:
                        came[holder] = key, item
                        queue.append(holder)
            while end:
                owner[end[1]] = end[0]
                end = came[end[0]]
    return owner


def quota_matching(edges: DataFrame, keys: DataFrame, quota: int, seed: str = "match") -> DataFrame:
    """key, slot, item: `quota` slots for every key of `keys` (key), filled from `edges` (key, item) as far as can be.

    An item fills one slot at most, and no assignment fills more slots. Candidates are taken in the order of a hash.
    Slots that nothing can fill have a null item; edges with a null, or a key that `keys` lacks, count for nothing;
    repeated rows count once. Items are of a type that a string gives back (numbers, strings, dates).

    Plan: of a key, only as many candidates matter as there are slots in all, as others can't take more than the rest; a
    ranking cut at that number before the shuffle leaves keys x slots rows whatever the edges, which one task matches.
    """
    keys = keys.select(F.col("key").cast("string")).where("key IS NOT NULL").distinct()
    n = keys.count()
    if quota * n * n > LARGEST:
        raise ValueError(f"{n} keys with a quota of {quota} may need {quota * n * n} candidate rows, more than {LARGEST}")
    own = edges.select(F.col("key").cast("string").alias("key"), "item").where("item IS NOT NULL").distinct().join(keys, "key", "left_semi")
    order = Window.partitionBy("key").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "key", F.col("item").cast("string")), 256), "item")
    few = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota * n).withColumn("item", F.col("item").cast("string"))
    kind = edges.schema["item"].dataType.simpleString()

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "place"])
        candidates = {key: [i for i in own["item"] if isinstance(i, str)] for key, own in rows.groupby("key", sort=True)}
        owner, out = fill_quotas(candidates, quota), []
        for key, items in candidates.items():
            got = [i for i in items if owner.get(i) == key]
            out += [(key, slot, got[slot] if slot < len(got) else None) for slot in range(quota)]
        return pd.DataFrame({"key": [r[0] for r in out], "slot": [r[1] for r in out], "item": pd.Series([r[2] for r in out], dtype=object)})

    return keys.join(few, "key", "left").groupBy().applyInPandas(match, "key string, slot long, item string").withColumn("item", F.col("item").cast(kind))
