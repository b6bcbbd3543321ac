import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from propwise import fixtures as fx
from propwise.operators.contract import align_columns, select_feature_contract
from propwise.sources import listings as S
from propwise.sources import sinks as K
from propwise.operators import corpus as T


def test_csv_roundtrip_with_aliases(spark, scratch):
    raw = fx.listings_raw(spark, SF001).withColumnsRenamed(
        {"kecamatan": "Kecamatan", "harga": "Harga", "kamar_tidur": "Kamar Tidur", "kamar_mandi": "kamarMandi",
         "luas_tanah": "Luas Tanah", "luas_bangunan": "luasBangunan", "garasi": "Garasi", "page": "Page"})
    path = os.path.join(scratch, "csv")
    raw.drop("created_at").coalesce(1).write.option("header", True).csv(path)
    df = S.normalize_columns(S.read_listings_csv(spark, path))
    assert "page" not in [c.lower() for c in df.columns]
    typed = S.ingest_raw(df)
    ref = S.ingest_raw(S.normalize_columns(fx.listings_raw(spark, SF001))).drop("created_at", "page")
    cols = ["listing_id", "harga", "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi"]
    assert typed.select(F.col("listing_id").cast("long"), *cols[1:]).exceptAll(ref.select(*cols)).count() == 0


def test_missing_columns_reported(spark):
    df = spark.createDataFrame([("1", "2")], "Harga string, Lokasi string")
    with pytest.raises(S.MissingColumnsError) as e:
        S.normalize_columns(df)
    assert "kamar_tidur" in str(e.value)


def test_fallback_and_sinks(spark, scratch):
    empty = spark.createDataFrame([], "listing_id long, harga double, cluster_id int, cluster_label string")
    second = spark.createDataFrame([(1, 5e8)], "listing_id long, harga double")
    out = S.read_with_fallback(empty, second)
    assert out.count() == 1 and "cluster_id" in out.columns and out.first()["cluster_id"] is None
    K.overwrite_table(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v"), os.path.join(scratch, "t"))
    ids = sorted(r["id"] for r in spark.read.parquet(os.path.join(scratch, "t")).collect())
    assert ids == list(range(1, 1001))
    K.write_report_json(second, os.path.join(scratch, "j"))
    K.write_clustered_csv(second, os.path.join(scratch, "c"))
    K.chunked_write(spark.range(1200), os.path.join(scratch, "chunks"), rows_per_file=500, partitions=1)
    files = [f for f in os.listdir(os.path.join(scratch, "chunks")) if f.endswith(".parquet")]
    assert len(files) == 3
    ev = second.withColumn("value", K.event_payload("predict_price", ["listing_id"], ["harga"]))
    K.publish_events(ev, "property.prediction.regression", path=os.path.join(scratch, "topic"))
    back = spark.read.json(os.path.join(scratch, "topic"))
    assert back.first()["value"] == '{"tool":"predict_price","input":{"listing_id":1},"output":{"harga":5.0E8}}'


def test_read_knowledge_tree(spark, scratch):
    root = os.path.join(scratch, "knowledge")
    for folder, name, body in [("area_profiles", "beji_area.md", "# Beji\ntext"), ("faqs", "how_it_works.md", "Q?")]:
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, folder, name), "w") as f:
            f.write(body)
    got = {r["title"]: r["doc_type"] for r in T.read_knowledge(spark, root).collect()}
    assert got == {"Beji Area": "area_profile", "How It Works": "faq"}


def test_feature_contract(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, z double")
    sel, rep = select_feature_contract(df, ["b", "a", "c"])
    assert sel.columns == ["b", "a"] and rep == {"missing": ["c"], "extra": ["z"]}
    assert align_columns(["a", "c"], df).first().asDict() == {"a": 1.0, "c": 0.0}


def test_csv_files_with_other_column_order_and_quoted_headers(spark, scratch):
    import pathlib
    pathlib.Path(scratch, "a.csv").write_text('Harga,"Luas Tanah",Lokasi\n1,2,A\n3,4,B\n')
    pathlib.Path(scratch, "b.csv").write_text('"Lokasi","Extra, quoted","Luas Tanah",Harga\n"C, c",x,6,5\n')
    df = S.read_listings_csv(spark, scratch)
    rows = sorted((r["Harga"], r["Luas Tanah"], r["Lokasi"], r["Extra, quoted"]) for r in df.collect())
    assert rows == [("1", "2", "A", None), ("3", "4", "B", None), ("5", "6", "C, c", "x")]


def test_columns_that_mean_the_same_are_one(spark):
    df = spark.createDataFrame([(None, "K", "1", "p"), ("L", "M", "2", "q")], "Kecamatan string, lokasi string, Harga string, page string")
    got = S.normalize_columns(df, required=["harga", "lokasi"])
    assert got.columns == ["lokasi", "harga"] and [tuple(r) for r in got.collect()] == [("K", "1"), ("M", "2")]


def test_bad_cells_become_null(spark):
    cells = ["99999999999", "NaN", "inf", "n/a", "3", "3.0", None]
    df = spark.createDataFrame([("1", c, c, c, "1", "1", "A") for c in cells],
                               "harga string, kamar_tidur string, kamar_mandi string, garasi string, luas_tanah string, "
                               "luas_bangunan string, lokasi string")
    got = S.ingest_raw(df).collect()
    assert [r["kamar_tidur"] for r in got] == [None, None, None, None, 3, 3, None]
    assert [r["garasi"] for r in got] == [0, 0, 0, 0, 3, 3, 0]


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from propwise import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
