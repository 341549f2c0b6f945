"""Quota matching fills as many slots as any assignment can, whatever candidates were cut away."""

from __future__ import annotations

import random

import pytest

from panelwright.operators.matching import quota_matching


def most_filled(edges, keys, quota) -> int:
    """Slots that can be filled, slot by slot over all edges."""
    holder = {}

    def place(slot, tried) -> bool:
        for key, item in edges:
            if key == slot[0] and item not in tried:
                tried.add(item)
                if item not in holder or place(holder[item], tried):
                    holder[item] = slot
                    return True
        return False

    return sum(place((k, i), set()) for k in keys for i in range(quota))


@pytest.mark.parametrize("items,degree,quota", [(12, 3, 2), (9, 2, 2), (200, 40, 3), (6, 6, 2)])
def test_fills_what_can_be_filled(spark, items, degree, quota):
    rng = random.Random(items)
    far = 1 << 60  # beyond what a double holds
    keys = [f"k{i}" for i in range(5)]
    edges = sorted({(k, far + rng.randrange(items)) for k in keys[:4] for _ in range(degree)})
    noise = [("other", 1), (None, 2), ("k0", None), *edges[:3]]
    got = quota_matching(spark.createDataFrame(edges + noise, "key string, item long"), spark.createDataFrame([(k,) for k in [*keys, None, "k1"]], "key string"), quota).collect()
    assert sorted((r.key, r.slot) for r in got) == sorted((k, s) for k in keys for s in range(quota))
    filled = [(r.key, r.item) for r in got if r.item is not None]
    assert set(filled) <= set(edges) and len({i for _, i in filled}) == len(filled)
    assert len(filled) == most_filled(edges, keys, quota)


def test_too_many_keys_are_refused(spark):
    edges = spark.createDataFrame([], "key string, item long")
    with pytest.raises(ValueError):
        quota_matching(edges, spark.range(3000).selectExpr("cast(id as string) AS key"), 2)
    assert not quota_matching(edges, spark.createDataFrame([], "key string"), 2).collect()
