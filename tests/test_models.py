import pytest
from pyspark.sql import functions as F

from conftest import SF01
from propwise.operators import models as MD
from propwise.plans import jobs


@pytest.fixture(scope="module")
def tables(spark):
    return (jobs.clean_regression_table(spark, SF01), jobs.clean_classification_table(spark, SF01),
            jobs.clean_clustering_table(spark, SF01))


def test_price_models_beat_median_baseline(spark, tables):
    reg, _, _ = tables
    pm, pred = MD.train_price_models(reg, max_iter=15, max_depth=4)
    med = reg.agg(F.median("harga")).first()[0]
    mape = pred.agg(F.avg(F.abs(F.col("y") - F.col("p")) / F.col("y"))).first()[0]
    base = pred.agg(F.avg(F.abs(F.col("y") - F.lit(med)) / F.col("y"))).first()[0]
    assert mape < base
    scored = MD.score_prices(reg.limit(200), pm)
    assert scored.filter(F.col("harga_estimasi") <= 0).count() == 0


def test_segment_probabilities_sum_to_one(spark, tables):
    _, cls, _ = tables
    sm, hold = MD.train_segment_model(cls, max_iter=6, max_depth=4, step_size=0.3)
    out = MD.score_segments(cls.limit(300), sm)
    sums = out.select(F.aggregate(F.map_values("probabilitas"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 2e-4).count() == 0
    assert hold.count() > 0


def test_cluster_medians_ascending(spark, tables):
    _, _, clu = tables
    cm = MD.train_market_clusters(clu, k=4, restarts=2, max_iter=20)
    s = cm.summary.orderBy("cluster_id").toPandas()
    assert list(s.cluster_id) == list(range(4))
    assert list(s.harga_median) == sorted(s.harga_median)
    assert set(s.cluster_label) == {"Budget", "Affordable", "Mid-Market", "Premium"}


def test_reduced_space_is_the_landmark_map(spark, tables):
    import numpy as np

    _, _, clu = tables
    cm = MD.train_market_clusters(clu, k=3, restarts=1, max_iter=10)
    marks, project = np.array(cm.reducer.landmarks), np.array(cm.reducer.projection)
    assert marks.shape == (MD.LANDMARKS, 8) and project.shape == (MD.LANDMARKS, MD.REDUCED)
    # on the landmarks themselves the map's dot products are the best rank-10 form of their similarities
    k = np.exp(-cm.reducer.gamma * ((marks[:, None] - marks[None]) ** 2).sum(axis=2))
    e, v = np.linalg.eigh(k)
    phi = k @ project
    assert np.allclose(phi @ phi.T, (v[:, -10:] * e[-10:]) @ v[:, -10:].T, atol=1e-8)
    # the rows are mapped by the same formula
    cols = [f"{c}_z" for c in MD.X.CLUSTERING_FEATURES]
    z = MD.E.standardize(clu, cm.stats).limit(50)
    got = np.array([r[1].toArray() for r in MD._vectors(z, cm.reducer).select(F.array(*cols), "features").collect()])
    x = np.array([r[0] for r in MD._vectors(z, cm.reducer).select(F.array(*cols), "features").collect()], float)
    want = np.exp(-cm.reducer.gamma * ((x[:, None] - marks[None]) ** 2).sum(axis=2)) @ project
    assert got.shape == (50, 10) and np.allclose(got, want, atol=1e-9)
    out = MD.score_clusters(clu.limit(200).drop("cluster_id"), cm)
    assert out.filter(F.col("cluster_id").isNull()).count() == 0 and out.count() == 200
    assert -1 <= cm.silhouette_plain <= 1 and MD.train_market_clusters(clu, k=3, restarts=1, max_iter=3, dims=None).reducer is None


def test_the_best_round_is_kept(spark, tables):
    from pyspark.ml.regression import GBTRegressor

    reg, _, _ = tables
    enc = MD.E.fit_target_encoder(reg)
    # few noisy rows, deep trees, long steps: the loss on others falls and then rises
    frame = MD.regression_frame(reg.limit(160), enc, 1e9).withColumn("label", F.log1p("harga")).withColumn(
        "is_val", MD.validation_rows("listing_id") | (F.col("listing_id") % 3 == 0)).persist()
    train, valid = frame.filter("not is_val"), frame.filter("is_val")
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxDepth=5, stepSize=0.8, seed=1)
    losses = []
    model = MD.fit_boosted(gbt, train, valid, 40, 6, losses)
    best = min(range(len(losses)), key=losses.__getitem__) + 1
    assert model.getNumTrees == best < len(losses)
    # it is that round's model: its error on the validation rows is the least one
    mse = model.transform(valid).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert abs(mse - min(losses)) < 1e-9
    frame.unpersist()


def test_validation_and_holdout_are_apart(spark, tables):
    reg, _, _ = tables
    df = MD.P.train_test_split(reg, "listing_id").withColumn("v", MD.validation_rows("listing_id"))
    n = {(r["is_train"], r["v"]): r["count"] for r in df.groupBy("is_train", "v").count().collect()}
    assert 0.08 < n[True, True] / (n[True, True] + n[True, False]) < 0.12


def test_boosted_classes_beat_the_forest(spark, tables):
    from pyspark.ml.classification import RandomForestClassifier

    _, cls, _ = tables
    sm, hold = MD.train_segment_model(cls, max_iter=16, max_depth=4, step_size=0.3, patience=4)
    right = hold.agg(F.avg((F.col("y") == F.col("p")).cast("int"))).first()[0]
    df = MD.segment_numbers(MD.P.stratified_split(cls, "listing_id", "kelas_harga"))
    frame = sm.encoder.transform(df).withColumn("label", F.col("kelas_harga").cast("double"))
    rf = RandomForestClassifier(numTrees=30, maxDepth=8, seed=42).fit(frame.filter("is_train"))
    forest = rf.transform(frame.filter("not is_train")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert len(sm.models) == 4 and right > forest and right > 0.9


def test_silhouette_in_range(spark, tables):
    _, _, clu = tables
    cm = MD.train_market_clusters(clu, k=3, restarts=1, max_iter=10)
    assert -1.0 <= cm.silhouette <= 1.0


def test_stored_models_serve_the_same_scores(spark, tables, scratch):
    """Train, store, reload in a new session: price; segment and cluster with the price estimated."""
    from propwise.sources import model_store as MS
    reg, cls, clu = tables
    pm, _ = MD.train_price_models(reg, max_iter=5, max_depth=3, step_size=0.1)
    sm, _ = MD.train_segment_model(cls, max_iter=3, max_depth=3, step_size=0.3)
    cm = MD.train_market_clusters(clu, k=3, restarts=1, max_iter=5)
    for name, m in (("price", pm), ("segment", sm), ("cluster", cm)):
        assert MS.publish(spark, scratch, name, m, {"x": 1.0}, {"y": 2}) == 1
    from propwise.operators import brief as BR
    assert BR.model_errors(spark, scratch) == (pm.threshold, round(pm.mape_low, 4), round(pm.mape_high, 4))
    rows = reg.limit(100).select("listing_id", *MD.REQUIRED, "garasi", F.lit(None).cast("double").alias("harga")).toPandas()
    other = spark.newSession()
    loaded = [MS.load_current(other, scratch, n) for n in ("price", "segment", "cluster")]
    out = []
    for s, (a, b, c) in ((spark, (pm, sm, cm)), (other, loaded)):
        df = s.createDataFrame(rows, "listing_id long, kamar_tidur int, kamar_mandi int, luas_tanah double, "
                                     "luas_bangunan double, lokasi string, garasi int, harga double")
        out.append(sorted(map(str, MD.batch_score(df, a, b, c, "listing_id").collect())))
    assert out[0] == out[1] and len(out[0]) == 100
    MS._write_json(spark, {"features": ["a"], "classes": 4}, MS.version_path(scratch, "segment", 1) + "/values")
    with pytest.raises(MS.ContractError):
        MS.load_current(other, scratch, "segment")


def test_batch_score_keeps_every_row(spark, tables):
    reg, cls, clu = tables
    pm, _ = MD.train_price_models(reg, max_iter=3, max_depth=3, step_size=0.1)
    sm, _ = MD.train_segment_model(cls, max_iter=2, max_depth=3, step_size=0.3)
    cm = MD.train_market_clusters(clu, k=3, restarts=1, max_iter=3)
    raw = jobs.raw_property_table(spark, SF01)
    df = raw.select(F.col("listing_id").alias("row_index"), *MD.REQUIRED, "garasi", F.lit(None).cast("double").alias("harga"))
    got = MD.batch_score(df, pm, sm, cm).toPandas()
    lacking = raw.filter(" or ".join(f"{c} is null" for c in MD.REQUIRED)).count()
    assert len(got) == raw.count() and got.row_index.is_unique and 0 < lacking == got.reason.notna().sum()
    assert got[got.reason.notna()].harga_estimasi.isna().all() and got[got.reason.isna()].kelas_id.notna().all()
    plan = MD.batch_score(df, pm, sm, cm)._jdf.queryExecution().executedPlan().toString()
    assert "Join [row_index" not in plan  # one pass over the rows: only lookups per area and cluster join


def test_areas_that_differ_in_marks_stay_apart(spark, tables):
    _, cls, _ = tables
    names = ["Pancoran Mas", "Pancoran-Mas", "pancoran mas"]
    df = cls.withColumn("lokasi", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("listing_id") % 3 + 1).cast("int")))
    sm, _ = MD.train_segment_model(df, max_iter=1, max_depth=2)
    assert [f for f in sm.features if f.startswith("lokasi_")] == [f"lokasi_{n}" for n in sorted(names)]
    unknown = sm.encoder.transform(MD.segment_numbers(cls.limit(1).withColumn("lokasi", F.lit("elsewhere")))).first()["features"]
    assert unknown.size == len(sm.features) and not any(unknown.toArray()[-3:])


def test_a_step_of_rounds_is_not_fitted_again(spark, tables):
    """Two steps of rounds take one fit, and the model is that of a fit of just those rounds."""
    from pyspark.ml.regression import GBTRegressor

    reg, _, _ = tables
    # without noise, so every round gains
    frame = MD.regression_frame(reg.limit(400), MD.E.fit_target_encoder(reg), 1e9).withColumn(
        "label", F.log1p("luas_tanah") + F.col("kamar_tidur")).withColumn("is_val", F.col("listing_id") % 3 == 0).persist()
    train, valid = frame.filter("not is_val"), frame.filter("is_val")
    fits = []

    class Counted(GBTRegressor):
        def fit(self, *args):
            fits.append(self.getMaxIter())
            return super().fit(*args)

    gbt = Counted(featuresCol="features", labelCol="label", maxDepth=2, stepSize=0.1, seed=1)
    model = MD.fit_boosted(gbt, train, valid, 32, 8)
    plain = GBTRegressor(featuresCol="features", labelCol="label", maxDepth=2, stepSize=0.1, seed=1, maxIter=model.getNumTrees).fit(train)
    assert fits == [32] and model.getNumTrees > 16
    both = plain.setPredictionCol("q").transform(model.transform(valid))
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("q")))).first()[0] < 1e-9
    frame.unpersist()


def test_training_frames_have_a_fixed_number_of_partitions(spark):
    from propwise.session import dealt

    one = spark.range(1000)
    many = one
    for _ in range(9):
        many = many.unionByName(one.repartition(20))
    cores = spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() > 4 * cores
    assert dealt(many, ["id"]).rdd.getNumPartitions() <= 4 * cores and dealt(many, ["id"]).count() == 10_000
    # a large table (by its estimated size) keeps what is read, a small one all
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    wide = many.withColumn("other", F.lit(1))
    assert dealt(wide, ["id"]).columns == ["id", "other"]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert dealt(wide, ["id"]).columns == ["id"] and dealt(wide, ["id"]).rdd.getNumPartitions() == 4 * cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
