import numpy as np
from pyspark.sql import functions as F

from propwise.operators import cleaning as C

COLS = "harga double, kamar_tidur int, kamar_mandi int, garasi int, luas_tanah double, luas_bangunan double, lokasi string"


def test_group_quantile_min_group_size(spark):
    # area A has 9 rows (passes whole), area B has 10 rows (filtered to [p5, p95])
    rows = [(float(i), 1, 1, 0, 100.0, 50.0, "A") for i in range(9)]
    rows += [(float(i), 1, 1, 0, 100.0, 50.0, "B") for i in range(10)]
    df = spark.createDataFrame(rows, COLS)
    out = C.group_quantile_filter(df, "lokasi", "harga", 0.05, 0.95, 10)
    got = {r["lokasi"]: r["c"] for r in out.groupBy("lokasi").agg(F.count("*").alias("c")).collect()}
    b = np.arange(10.0)
    lo, hi = np.quantile(b, [0.05, 0.95])
    assert got == {"A": 9, "B": int(((b >= lo) & (b <= hi)).sum())}


def test_iqr_clip_independent_and_drop_sequential(spark):
    rng = np.random.default_rng(1)
    h = rng.normal(1e9, 1e8, 200)
    h[:3] = [5e9, 6e9, 7e9]
    lt = rng.normal(100, 10, 200)
    lt[3:6] = [900, 950, 1000]
    rows = [(float(a), 2, 1, 1, float(b), 50.0, "A") for a, b in zip(h, lt)]
    df = spark.createDataFrame(rows, COLS)
    clipped = C.iqr_clip(df, ["harga", "luas_tanah"]).toPandas()
    q1, q3 = np.quantile(h, [0.25, 0.75])
    assert np.isclose(clipped["harga"].max(), q3 + 1.5 * (q3 - q1))
    assert len(clipped) == 200
    dropped = C.iqr_drop(df, ["harga", "luas_tanah"]).toPandas()
    keep = (h >= q1 - 1.5 * (q3 - q1)) & (h <= q3 + 1.5 * (q3 - q1))
    lt2 = lt[keep]
    a, b = np.quantile(lt2, [0.25, 0.75])
    keep2 = (lt2 >= a - 1.5 * (b - a)) & (lt2 <= b + 1.5 * (b - a))
    assert len(dropped) == int(keep2.sum())


def test_validation_reasons(spark):
    rows = [(3, 2, 1, 90.0, 70.0, "Cinere", 5e8, 6e8), (0, 2, 1, 90.0, 70.0, "X", 5e6, 6e8)]
    df = spark.createDataFrame(rows, "kamar_tidur int, kamar_mandi int, garasi int, luas_tanah double, "
                                     "luas_bangunan double, lokasi string, harga_prediksi double, harga_asli double")
    out = C.validate_feedback(df).orderBy("kamar_tidur").collect()
    assert out[0]["reasons"] == ["kamar_tidur", "lokasi", "harga_prediksi"] and not out[0]["is_valid"]
    assert out[1]["is_valid"]


def test_empty_input(spark):
    df = spark.createDataFrame([], COLS)
    assert C.clean_regression(df).count() == 0
    assert C.clean_classification(df).count() == 0
