"""Runs last: what a whole session of jobs leaves in the JVM."""

from conftest import held


def test_nothing_is_left_behind(spark):
    spark.catalog.clearCache()
    now = held(spark)
    assert now["persisted"] == 0 and now["heap_mb"] < 700, now
