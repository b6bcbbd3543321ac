"""Plan-shape checks: the properties the scale design relies on."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import SF001, SF01
from propwise import fixtures as fx
from propwise.session import bounded_broadcast
from propwise.sources.sinks import with_dense_id


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_bounded_broadcast_falls_back_above_the_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # isolate the explicit hint
    try:
        big = spark.range(0, 10000).withColumnRenamed("id", "k")
        small = spark.range(0, 100).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
        assert "BroadcastHashJoin" in plan(big.join(bounded_broadcast(small, 1000), "k"))
        assert "BroadcastHashJoin" not in plan(big.join(bounded_broadcast(small, 10), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_rank_across_range_partitions(spark):
    ev = fx.table(spark, SF001, "events").select("event_id", "ts").repartition(7)
    ranked = with_dense_id(ev.orderBy("ts", "event_id"), "rank").toPandas()
    want = ranked.sort_values(["ts", "event_id"]).reset_index(drop=True)
    assert list(want["rank"]) == list(range(1, len(want) + 1))


def test_literal_bounds_reach_the_scan(spark):
    from propwise.plans import jobs
    p = plan(jobs.clean_regression(spark, SF01))
    assert "GreaterThan(luas_bangunan,10.0)" in p and "GreaterThanOrEqual(harga,2.0E8)" in p


def test_top_k_window_is_limited_before_the_shuffle(spark):
    from propwise.operators.analytics import last_n_per_key
    p = plan(last_n_per_key(fx.table(spark, SF001, "events"), "user_id", "ts", 50, "event_id"))
    assert "WindowGroupLimit" in p and "Partial" in p
