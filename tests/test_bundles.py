"""Bundles: a hash over configuration, tables and parents, refused when anything changed or stands there already."""

from __future__ import annotations

import pytest

from panelwright.sources.sinks import verify_bundle, write_bundle, write_table


def test_bundle_chain(spark, tmp_path):
    base, later = f"{tmp_path}/base", f"{tmp_path}/later"
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id long, name string, x double")
    first = write_bundle({"predictions": rows, "fits": rows.limit(0)}, base, {"alpha": 0.1})
    second = write_bundle({"predictions": rows}, later, {"alpha": 0.1}, (base,))
    assert verify_bundle(spark, base) == first and verify_bundle(spark, later) == second != first
    with pytest.raises(Exception, match="(?i)exists"):
        write_bundle({"predictions": rows}, base, {})
    write_table(rows.where("id = 1"), f"{base}/predictions", "overwrite")
    with pytest.raises(ValueError, match="predictions has changed"):
        verify_bundle(spark, base)
    with pytest.raises(ValueError, match="predictions has changed"):
        verify_bundle(spark, later)
    with pytest.raises(ValueError):
        write_bundle({}, f"{tmp_path}/none", {})
