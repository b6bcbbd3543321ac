import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from propwise.operators import boosting as BO
from propwise.operators import models as MD
from propwise.plans import jobs
from propwise.plans import q_models as Q


@pytest.fixture(scope="module")
def rows(spark):
    """Listings whose class hangs on size, rooms and area, not quite."""
    rng = np.random.default_rng(5)
    n, out = 900, []
    for i in range(n):
        land, built, rooms, area = float(rng.integers(40, 400)), float(rng.integers(30, 300)), int(rng.integers(1, 6)), int(rng.integers(0, 7))
        price = (land * (4 + area) + built * 5) * 1e6 * float(rng.uniform(0.9, 1.1))
        out.append((i, f"area {area}", rooms, 1 + rooms // 2, rooms % 3, land, built, price, int(np.searchsorted([1e9, 2e9, 3e9], price))))
    return spark.createDataFrame(out, "listing_id long, lokasi string, kamar_tidur int, kamar_mandi int, garasi int, luas_tanah double, "
                                      "luas_bangunan double, harga double, kelas_harga int")


def test_the_query_trains_at_the_settings_of_the_original(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def trainer(*args, **settings):
        call = inspect.signature(real).bind(*args, **settings)
        call.apply_defaults()
        seen.update(call.arguments)
        raise Stop

    real = MD.train_segment_model
    monkeypatch.setattr(jobs, "clean_classification_table", lambda *a: None)
    monkeypatch.setattr(jobs, "_once", lambda s, sf, name, build: build())
    monkeypatch.setattr(MD, "train_segment_model", trainer)
    with pytest.raises(Stop):
        Q.segment_model_report(spark, "")
    assert (seen["max_iter"], seen["max_depth"], seen["step_size"], seen["patience"]) == (1500, 8, 0.05, 100)


def test_trees_are_those_of_mllib(spark, rows):
    from pyspark.ml.classification import GBTClassifier

    sm, _ = MD.train_segment_model(rows, max_iter=3, max_depth=3, step_size=0.3, patience=20)
    df = MD.segment_numbers(MD.P.stratified_split(rows, "listing_id", "kelas_harga"))
    frame = sm.encoder.transform(df).where("is_train").withColumn("v", MD.validation_rows("listing_id")).persist()
    for c, mine in enumerate(sm.models):
        labelled = frame.withColumn("label", (F.col("kelas_harga") == c).cast("double"))
        gbt = GBTClassifier(maxDepth=3, stepSize=0.3, seed=42, maxIter=len(mine.trees)).fit(labelled.where("not v"))
        p = gbt.transform(labelled).select("probability", *MD.SEGMENT_NUMBERS, "_area").toPandas()
        want = np.array([v[1] for v in p.probability])
        codes = sm.borders.codes([p[x].to_numpy(float) for x in MD.SEGMENT_NUMBERS], p["_area"].to_numpy())
        got = 1 / (1 + np.exp(-2 * mine.margin(codes)))
        # equal gains may fall to another feature by the noise of a sum
        assert np.mean(np.abs(got - want) < 1e-6) > 0.9 and np.mean((got > 0.5) == (want > 0.5)) > 0.98
    frame.unpersist()


def test_blocks_over_the_cores_grow_the_same_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(BO, "BLOCK_ROWS", 50)
    monkeypatch.setattr(BO, "SCORED_ANEW", 2)
    settings = dict(max_iter=4, max_depth=3, step_size=0.3, patience=4)
    one, hold = MD.train_segment_model(rows, **settings)
    monkeypatch.setattr(BO, "TASK_ROWS", 0)
    many, hold2 = MD.train_segment_model(rows, **settings)
    df = MD.segment_numbers(MD.P.stratified_split(rows, "listing_id", "kelas_harga"))
    p = one.encoder.transform(df).where("is_train").where(~MD.validation_rows("listing_id")).select(*MD.SEGMENT_NUMBERS, "_area").toPandas()
    codes = one.borders.codes([p[x].to_numpy(float) for x in MD.SEGMENT_NUMBERS], p["_area"].to_numpy())
    for a, b in zip(one.models, many.models):
        # splits that part the rows of training alike gain the same, whichever of them is taken
        k = min(len(a.trees), len(b.trees))
        a, b = (BO.Boosted(m.trees[:k], m.depth).margin(codes) for m in (a, b))
        assert np.mean(np.abs(a - b) < 1e-9) > 0.9
    assert abs(hold.where("y = p").count() - hold2.where("y = p").count()) <= 9


def test_borders_of_a_number():
    assert BO.borders_of(np.array([1.0, 2.0, 2.0, 5.0, np.nan])) == [1.5, 3.5]
    many = BO.borders_of(np.arange(1000.0))
    assert len(many) == 31 and np.diff(many).max() < 34
    assert BO.borders_of(np.array([np.nan])) == []
    b = BO.Borders([[1.5, 3.5]], 3)
    assert b.codes([np.array([1.0, 1.5, 2.0, 9.0, np.nan])], np.array([0, 1, 2, 3, 3])).tolist() == [[0, 0, 1, 2, 2], [0, 1, 2, 3, 3]]
