"""Composed table jobs over the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  Library
operators take canonical columns; only this module and ``fixtures`` know how the
driver tables map onto listings, feedback and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as X
from ..operators import cleaning as C
from ..operators import corpus as T
from ..operators import encoding as E
from ..operators import similarity as V
from ..session import materialize
from ..sources import listings as S
from ..sources import log


def raw_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + F1-F4: scraped text -> RawProperty (typed, nulls kept)."""
    raw = S.normalize_columns(fx.listings_raw(spark, sf_dir))
    return S.ingest_raw(raw)


_STORED: dict = {}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files: a rewritten input is another one."""
    fs, p = log.hadoop(spark, sf_dir)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table the application stores (RawProperty, the clean tables, Feedback):
    written once per session under the shared checkpoint folder, then read by
    every query that needs it — as the original keeps them in its database."""
    return _once(spark, sf_dir, name, lambda: materialize(build(), name))


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    inputs = _inputs(spark, sf_dir)
    if _STORED.get(key, (None,))[0] != inputs:
        _STORED[key] = (inputs, build())
    return _STORED[key][1]


def raw_property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RawProperty as a stored table."""
    return _stored(spark, sf_dir, "raw_property", lambda: raw_property(spark, sf_dir))


def clean_classification_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "clean_classification", lambda: clean_classification(spark, sf_dir))


def clean_regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "clean_regression", lambda: clean_regression(spark, sf_dir))


def clean_clustering_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "clean_clustering", lambda: clean_clustering(spark, sf_dir))


def feedback_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "feedback", lambda: feedback_table(spark, sf_dir))


def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over ``documents``: the language stands in for the kind of knowledge document."""
    def build() -> DataFrame:
        docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("doc_type"), "text")
        return T.chunk_documents(docs).withColumn("chunk_id", T.chunk_key())
    return _stored(spark, sf_dir, "knowledge_chunks", build)


def knowledge_index(spark: SparkSession, sf_dir: str) -> T.TextCells:
    """The text index, built when documents are ingested and searched by T4 and T5."""
    return _once(spark, sf_dir, "knowledge_index", lambda: T.build_text_cells(knowledge_chunks(spark, sf_dir)))


def listing_index(spark: SparkSession, sf_dir: str) -> tuple[dict, V.VectorCells]:
    """Standardizer and vector index of the clustering-clean listings, searched by T3 and T5."""
    def build() -> tuple[dict, V.VectorCells]:
        clu = clean_clustering_table(spark, sf_dir)
        stats = E.fit_standardizer(clu, V.COMPARABLE_FEATURES)
        return stats, V.build_cells(V.listing_vectors(clu, stats).select("cid", "cvec"))
    return _once(spark, sf_dir, "listing_index", build)


def clean_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_classification(raw_property_table(spark, sf_dir))


def clean_regression(spark: SparkSession, sf_dir: str, report: C.StepCounts | None = None) -> DataFrame:
    return C.clean_regression(raw_property_table(spark, sf_dir), report=report)


def clean_clustering(spark: SparkSession, sf_dir: str, report: C.StepCounts | None = None) -> DataFrame:
    return C.clean_clustering(raw_property_table(spark, sf_dir), report=report)


def feedback_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored corrections: C14-valid events with F15 deviation."""
    fb = C.validate_feedback(fx.feedback(spark, sf_dir))
    valid, _ = C.split_valid(fb)
    return valid.withColumn("selisih_persen", X.deviation_pct("harga_asli", "harga_prediksi"))


def clustered_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering-clean rows with a fixed assignment (price segment -> cluster id).

    Stands in for the KMeans output wherever a query must compare exactly.
    """
    df = clean_clustering_table(spark, sf_dir)
    return df.withColumns({"cluster_id": X.price_segment("harga")}).withColumn(
        "cluster_label", X.cluster_name("cluster_id"))


def prediction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20 over the three prediction topics."""
    from ..streaming.events import parse_prediction_event
    return parse_prediction_event(fx.prediction_events(spark, sf_dir))
