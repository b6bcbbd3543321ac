from pyspark.sql import functions as F

from propwise.functions import columns as X


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_parse_price_variants(spark):
    rows = [("Rp 1,25 Miliar",), ("750 Juta",), ("850000000",), ("Nego",), (None,), ("Rp 1.250.000.000",),
            ("2 MILIAR",), ("",)]
    got = one(spark, X.parse_price("h"), rows, "h string")
    assert got == [1.25e9, 750e6, 850e6, None, None, None, 2e9, None]


def test_parse_area_and_numeric(spark):
    assert one(spark, X.parse_area("a"), [("120 m2",), ("90",), ("n/a",), (None,)], "a string") == [120.0, 90.0, None, None]
    assert one(spark, X.coerce_numeric("a"), [("3",), ("n/a",), (" 4 ",)], "a string") == [3.0, None, 4.0]
    assert one(spark, X.fill_garage("g"), [(None,), (2,)], "g int") == [0, 2]


def test_segment_boundaries_right_closed(spark):
    rows = [(745e6,), (745e6 + 1,), (1.3e9,), (1.3e9 + 1,), (2.645e9,), (2.645e9 + 1,), (1.0,)]
    assert one(spark, X.price_segment("p"), rows, "p double") == [0, 1, 1, 2, 2, 3, 0]


def test_labels_and_defaults(spark):
    assert one(spark, X.segment_name("s"), [(0,), (3,), (9,)], "s int") == ["Murah", "Mewah", "Menengah"]
    assert one(spark, X.cluster_name("c"), [(0,), (5,), (11,)], "c int") == ["Budget", "Ultra-Luxury", "Cluster-11"]
    assert one(spark, X.cluster_name("c", on_write=True), [(11,)], "c int") == ["Tier-12"]


def test_deviation_and_texts(spark):
    df = spark.createDataFrame([(110.0, 100.0)], "a double, p double")
    assert df.select(X.deviation_pct("a", "p")).first()[0] == 10.0
    got = one(spark, X.format_rupiah("v"), [(1_254_000_000.0,), (750_500_000.0,), (12345.9,)], "v double")
    assert got == ["Rp 1.25 Miliar", "Rp 750.5 Juta", "Rp 12,345"]
    assert one(spark, X.trend_text("t"), [(12.345,), (0.0,), (-1.0,)], "t double") == ["±12.3%", "N/A", "N/A"]


def test_market_gate_top_class_title(spark):
    assert one(spark, X.is_market_query("q"), [("Berapa HARGA rumah?",), ("hello",)], "q string") == [True, False]
    df = spark.createDataFrame([({"a": 0.2, "b": 0.7, "c": 0.1},)], "m map<string,double>")
    assert df.select(X.top_class("m")).first()[0] == "b"
    assert one(spark, X.title_from_source("s"), [("/k/area_profiles/how_price_is_calculated.md",)], "s string") == \
        ["How Price Is Calculated"]


def test_features_no_division_error(spark):
    df = spark.createDataFrame([(1e9, 0.0, 0.0)], "harga double, luas_tanah double, luas_bangunan double")
    r = df.select(*[v.alias(k) for k, v in X.clustering_features().items()]).first()
    assert r["harga_per_m2"] is None and r["rasio_lb_lt"] is None


def test_parse_price_property(spark):
    from hypothesis import given, settings, strategies as st

    cases = []

    @settings(max_examples=60, deadline=None)
    @given(st.integers(1, 999), st.integers(0, 99), st.sampled_from(["Miliar", "miliar", "Juta", "JUTA", ""]))
    def gen(whole, frac, unit):
        cases.append((f"Rp {whole},{frac:02d} {unit}".strip(), whole, frac, unit.lower()))

    gen()
    df = spark.createDataFrame([(c[0],) for c in cases], "h string")
    got = [r[0] for r in df.select(X.parse_price("h")).collect()]
    for (text, whole, frac, unit), g in zip(cases, got):
        base = float(f"{whole}.{frac:02d}")
        want = base * 1e9 if unit == "miliar" else base * 1e6 if unit == "juta" else base
        assert g == want, text
