from pyspark.sql import functions as F

from propwise.operators import pricing as P


def test_blend_edges(spark):
    t = 1.2e9
    rows = [(1, t * 0.95 - 1, 1.0), (2, t * 0.95, 2e9), (3, t, 2e9), (4, t * 1.05, 2e9), (5, t * 1.05 + 1, 3e9)]
    df = spark.createDataFrame(rows, "id int, harga_low double, harga_high double")
    out = {r["id"]: r for r in P.route_and_blend(df, t, 10.0, 20.0).collect()}
    assert out[1]["model_digunakan"] == "model_low" and out[1]["harga_final"] == t * 0.95 - 1
    assert out[2]["model_digunakan"] == "blended" and out[2]["harga_final"] == t * 0.95
    assert out[3]["model_digunakan"] == "blended" and abs(out[3]["mape_persen"] - 15.0) < 1e-9
    assert out[4]["model_digunakan"] == "blended" and out[4]["harga_final"] == 2e9
    assert out[5]["model_digunakan"] == "model_high" and out[5]["harga_final"] == 3e9


def test_split_is_deterministic_and_near_80(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = P.train_test_split(df, "k")
    share = a.filter("is_train").count() / 20000
    assert 0.78 < share < 0.82
    assert a.exceptAll(P.train_test_split(df, "k")).count() == 0


def test_extreme_weights(spark):
    df = spark.createDataFrame([(1e8, "low"), (7e8, "low"), (3e9, "high"), (2e9, "high")], "harga double, side string")
    w = [r["weight"] for r in P.extreme_weights(df, 1.2e9).collect()]
    assert w == [2.0, 1.0, 2.0, 1.0]


def test_classes_are_split_exactly(spark):
    rows = [(i, (0 if i % 3 else 1) if i < 5000 else 2) for i in range(5003)] + [(9000, None), (9001, 7)]
    df = spark.createDataFrame(rows, "k long, c int")
    out = P.stratified_split(df, "k", "c").persist()
    n = {(r["c"], r["is_train"]): r["count"] for r in out.groupBy("c", "is_train").count().collect()}
    size = {c: sum(1 for _, x in rows if x == c) for c in {x for _, x in rows}}
    for c, k in size.items():
        assert n.get((c, True), 0) == int(k * 0.8 + 0.5) and n.get((c, False), 0) == k - int(k * 0.8 + 0.5)
    # the same rows however they lie, and no class funnels into one task
    again = P.stratified_split(df.repartition(7), "k", "c")
    assert out.exceptAll(again).count() == 0 and out.count() == len(rows)
    assert P.stratified_split(df.limit(0), "k", "c").count() == 0
    out.unpersist()
