import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from propwise.operators import cleaning as C
from propwise.operators import quantiles as Q
from propwise.plans import jobs


def test_refine_equals_percentile_on_prices(spark):
    raw = C.drop_incomplete(jobs.raw_property_table(spark, SF01))
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    for col in ["harga", "luas_tanah", "kamar_tidur"]:
        a = Q.quantiles(raw, F.col(col), probs, "percentile")
        b = Q.refine_quantiles(raw, F.col(col), probs, buckets=16, max_collect=50)
        assert a == b, col


def test_refine_with_hot_value_and_ties(spark):
    vals = [7.0] * 5000 + list(np.random.default_rng(3).normal(0, 1, 2000))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.1, 0.3, 0.5, 0.9, 0.999]
    a = Q.quantiles(df, F.col("x"), probs, "percentile")
    b = Q.refine_quantiles(df, F.col("x"), probs, buckets=8, max_collect=20)
    assert a == b


def test_cleaning_same_rows_with_refinement(spark):
    raw = jobs.raw_property_table(spark, SF01)
    a = C.clean_regression(raw).select("listing_id")
    old = C.QUANTILE_METHOD
    try:
        C.QUANTILE_METHOD = "refine"
        b = C.clean_regression(raw).select("listing_id")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        C.QUANTILE_METHOD = old


def test_group_refine_equals_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.integers(0, 3000, 20000)] + [("hot", 42.0)] * 7000
    rows += [(f"a{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 5, 3000))]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.05, 0.5, 0.95]
    a = {r["k"]: (r["n"], list(r["q"])) for r in Q.group_quantiles(df, "k", F.col("x"), probs, "percentile").collect()}
    b = {r["k"]: (r["n"], list(r["q"])) for r in Q.group_quantiles(df, "k", F.col("x"), probs, "auto",
                                                                   max_distinct=500, buckets=16, max_collect=100).collect()}
    assert a == b


def test_staged_cleaning_same_rows(spark):
    raw = jobs.raw_property_table(spark, SF01)
    a = C.clean_regression(raw).select("listing_id")
    b = C.clean_regression(raw, stage_rows=0).select("listing_id")      # force the staged write
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c1 = C.clean_clustering(raw).select("listing_id")
    c2 = C.clean_clustering(raw, stage_rows=0).select("listing_id")
    assert c1.exceptAll(c2).count() == 0 and c2.exceptAll(c1).count() == 0


def test_approximate_path_close_to_exact(spark):
    raw = jobs.raw_property_table(spark, SF01)
    exact = C.clean_regression(raw).count()
    approx = C.clean_regression(raw, exact=False).count()
    assert abs(exact - approx) <= 0.02 * exact


def test_percentile_counts_equal_values_first(spark):
    """No task merges one buffer of distinct values for each task: values are counted over all of them first."""
    import re

    df = spark.range(4_000, numPartitions=8).selectExpr("id % 2 as k", "if(id % 50 = 0, null, cast(id % 30 as double)) as x")
    per = Q.group_quantiles(df, "k", F.col("x"), [0.5, 0.9], "percentile")
    assert re.search(r"hashpartitioning\(k#\d+L?, x#\d+", per._jdf.queryExecution().executedPlan().toString())
    rows = df.toPandas().dropna()
    for r in per.collect():
        x = rows[rows.k == r["k"]].x
        assert r["n"] == len(x) and np.allclose(r["q"], np.percentile(x, [50, 90]))
    assert np.allclose(Q.quantiles(df, F.col("x"), [0.25, 0.5]), np.percentile(rows.x, [25, 50]))
    assert Q.quantiles(df.where("x is null"), F.col("x"), [0.5]) is None
