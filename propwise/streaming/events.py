"""Event payloads.

``from_json`` with an explicit schema (no inference), defaults by ``coalesce``.
The same functions serve batch tables and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPICS = {
    "regression": "property.prediction.regression",
    "classification": "property.prediction.classification",
    "clustering": "property.prediction.clustering",
    "feedback": "property.feedback",
}

# Input fields are read as text: the JSON parser hands back a number's own spelling
# ("40", not "40.0"), which params and cache keys keep; typed columns are casts of it.
INPUT_TYPES = {"lokasi": "string", "luas_tanah": "double", "luas_bangunan": "double", "kamar_tidur": "int",
               "kamar_mandi": "int", "garasi": "int", "harga": "double", "top_k": "int"}
INPUT = T.StructType([T.StructField(n, T.StringType()) for n in INPUT_TYPES])
OUTPUT = T.StructType([
    T.StructField("harga_estimasi", T.DoubleType()),
    T.StructField("harga_estimasi_format", T.StringType()),
    T.StructField("model_digunakan", T.StringType()),
    T.StructField("mape_persen", T.DoubleType()),
    T.StructField("kelas_id", T.StringType()),
    T.StructField("kelas_label", T.StringType()),
    T.StructField("probabilitas", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cluster_id", T.StringType()),
    T.StructField("cluster_label", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
])
PREDICTION_EVENT = T.StructType([
    T.StructField("tool", T.StringType()),
    T.StructField("input", INPUT),
    T.StructField("output", OUTPUT),
])

FEEDBACK_EVENT = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("kamar_tidur", T.IntegerType()),
    T.StructField("kamar_mandi", T.IntegerType()),
    T.StructField("garasi", T.IntegerType()),
    T.StructField("luas_tanah", T.DoubleType()),
    T.StructField("luas_bangunan", T.DoubleType()),
    T.StructField("lokasi", T.StringType()),
    T.StructField("harga_prediksi", T.DoubleType()),
    T.StructField("harga_asli", T.DoubleType()),
    T.StructField("sumber", T.StringType()),
    T.StructField("selisih_persen", T.DoubleType()),
])

# Raw-text input fields used in cache keys (JSON numbers keep their own spelling).
KEY_FIELDS = {
    "regression": ["lokasi", "luas_tanah", "luas_bangunan", "kamar_tidur", "kamar_mandi", "garasi"],
    "classification": ["lokasi", "luas_tanah", "luas_bangunan", "kamar_tidur", "harga"],
    "clustering": ["lokasi", "luas_tanah", "luas_bangunan", "kamar_tidur", "harga"],
}


def whole_number(c: str) -> Column:
    """Text of a JSON number -> int: ``3`` and ``3.0`` alike, a fraction cut; null if it is none or too large."""
    return F.coalesce(F.col(c).try_cast("int"), F.col(c).try_cast("double").try_cast("int"))


def parse_prediction_event(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON -> typed columns; missing keys take defaults (0, 'unknown', -1)."""
    e = F.from_json(F.col(payload), PREDICTION_EVENT)
    typed = [(whole_number(f"_e.input.{n}") if t == "int" else F.col(f"_e.input.{n}").try_cast(t)).alias(n)
             for n, t in INPUT_TYPES.items() if n not in ("lokasi", "top_k")]
    return df.withColumn("_e", e).select(
        *[c for c in df.columns if c != payload],
        F.col("_e.tool").alias("tool"),
        F.coalesce(F.col("_e.input.lokasi"), F.lit("unknown")).alias("lokasi"),
        *typed,
        whole_number("_e.input.top_k").alias("top_k"),
        F.coalesce(F.col("_e.output.harga_estimasi"), F.lit(0.0)).alias("harga_estimasi"),
        F.coalesce(F.col("_e.output.latency_ms"), F.lit(0.0)).alias("latency_ms"),
        F.coalesce(F.col("_e.output.model_digunakan"), F.lit("unknown")).alias("model_digunakan"),
        F.coalesce(whole_number("_e.output.kelas_id"), F.lit(-1)).alias("kelas_id"),
        F.coalesce(F.col("_e.output.kelas_label"), F.lit("unknown")).alias("kelas_label"),
        F.coalesce(whole_number("_e.output.cluster_id"), F.lit(-1)).alias("cluster_id"),
        F.coalesce(F.col("_e.output.cluster_label"), F.lit("unknown")).alias("cluster_label"),
        F.col("_e.input").alias("input_raw"),
        F.col("_e.output").alias("output"),
    )


def cache_key(kind: str, raw: str = "input_raw") -> Column:
    """'<kind>:' + colon-joined raw input fields (missing -> empty)."""
    parts = [F.coalesce(F.col(f"{raw}.{f}"), F.lit("")) for f in KEY_FIELDS[kind]]
    return F.concat_ws(":", F.lit(kind), *parts)


def audit_rows(parsed: DataFrame) -> DataFrame:
    """One audit row per event: params (all inputs as text), numeric
    metrics as double, tags as text — chosen per topic."""
    topic = F.col("topic")
    is_reg = topic == TOPICS["regression"]
    is_cls = topic == TOPICS["classification"]
    is_clu = topic == TOPICS["clustering"]
    pairs = []
    for n in INPUT_TYPES:
        pairs += [F.lit(n), F.col(f"input_raw.{n}")]
    params = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    metrics = (F.when(is_reg, F.create_map(F.lit("harga_estimasi"), F.col("harga_estimasi"),
                                           F.lit("latency_ms"), F.col("latency_ms")))
               .when(is_cls, F.create_map(F.lit("latency_ms"), F.col("latency_ms")))
               .otherwise(F.create_map(F.lit("cluster_id"), F.col("cluster_id").cast("double"),
                                       F.lit("latency_ms"), F.col("latency_ms"))))
    tags = (F.when(is_reg, F.create_map(F.lit("model_digunakan"), F.col("model_digunakan"),
                                        F.lit("lokasi"), F.col("lokasi")))
            .when(is_cls, F.create_map(F.lit("kelas_label"), F.col("kelas_label"),
                                       F.lit("kelas_id"), F.col("kelas_id").cast("string"),
                                       F.lit("lokasi"), F.col("lokasi")))
            .otherwise(F.create_map(F.lit("cluster_label"), F.col("cluster_label"), F.lit("lokasi"), F.col("lokasi"))))
    key = (F.when(is_reg, cache_key("regression")).when(is_cls, cache_key("classification"))
           .when(is_clu, cache_key("clustering")))
    return parsed.select("event_id", "ts", "topic", "tool", params.alias("params"), metrics.alias("metrics"),
                         tags.alias("tags"), key.alias("cache_key"), F.col("output"))


def parse_feedback_event(df: DataFrame, payload: str = "value") -> DataFrame:
    """Feedback JSON -> typed columns; source defaults to user_feedback."""
    whole = [f.name for f in FEEDBACK_EVENT if f.dataType == T.IntegerType()]
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in FEEDBACK_EVENT])
    e = F.from_json(F.col(payload), read)
    out = df.withColumn("_e", e).select(
        *[c for c in df.columns if c != payload],
        *[(whole_number(f"_e.{f.name}") if f.name in whole else F.col(f"_e.{f.name}")).alias(f.name) for f in FEEDBACK_EVENT])
    return out.withColumn("sumber", F.coalesce(F.col("sumber"), F.lit("user_feedback")))
