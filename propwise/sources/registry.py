"""Model registry and metadata ledger.

Append-only tables on shared storage: every change is a new row, the current
state is the latest row per key (``max_by``).  No in-place update is needed.  A version number
belongs to whoever creates its marker first, so two writers never share one.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log

EVENTS_SCHEMA = "model string, version long, stage string, metrics string, at timestamp"
META_SCHEMA = "model string, version long, metadata string, at timestamp"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not log.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _append(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """One folder for each write: writers at once would share, and remove, each other's drafts in one folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(path, f"write={uuid.uuid4().hex}"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Latest stage of every (model, version)."""
    ev = _read(spark, os.path.join(root, "model_events"), EVENTS_SCHEMA)
    latest = F.max_by(F.struct("stage", "metrics"), "at")
    return ev.groupBy("model", "version").agg(latest.alias("l"), F.max("at").alias("at")).select(
        "model", "version", "l.stage", "l.metrics", "at")


def register_version(spark: SparkSession, root: str, model: str, metrics: dict) -> int:
    """Next version number of ``model`` with stage None; of writers at once each gets its own."""
    claims = os.path.join(root, "versions", model)
    events = os.path.join(root, "model_events")
    taken = [int(n) for n in log.names(spark, claims) if n.isdigit()]
    if not taken:  # a ledger older than its markers
        taken = [r["v"] or 0 for r in versions(spark, root).filter(F.col("model") == model).agg(F.max("version").alias("v")).collect()]
    v = max(taken, default=0) + 1
    while not log.write_once(spark, os.path.join(claims, str(v)), ""):
        v += 1
    _append(spark, events, [(model, v, "None", json.dumps(metrics, sort_keys=True), _now())], EVENTS_SCHEMA)
    return v


def promote(spark: SparkSession, root: str, model: str, version: int, stage: str = "Production") -> None:
    """Move ``version`` to ``stage``; the version previously in that stage is archived."""
    prev = (versions(spark, root).filter((F.col("model") == model) & (F.col("stage") == stage)
                                         & (F.col("version") != version)).select("version").collect())
    at = _now()
    rows = [(model, int(r["version"]), "Archived", None, at) for r in prev] + [(model, int(version), stage, None, at)]
    _append(spark, os.path.join(root, "model_events"), rows, EVENTS_SCHEMA)


def current_version(spark: SparkSession, root: str, model: str, stage: str = "Production") -> int | None:
    """Highest version currently in ``stage``."""
    r = (versions(spark, root).filter((F.col("model") == model) & (F.col("stage") == stage))
         .agg(F.max("version").alias("v")).collect())
    return r[0]["v"] if r else None


def write_model_metadata(spark: SparkSession, root: str, model: str, version: int, metadata: dict) -> None:
    """Persist thresholds, feature list, metrics, cluster summary (JSON text column)."""
    row = (model, int(version), json.dumps(metadata, sort_keys=True, default=float), _now())
    _append(spark, os.path.join(root, "model_metadata"), [row], META_SCHEMA)


def model_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``(model, version, metadata)``, the last written for each version."""
    df = _read(spark, os.path.join(root, "model_metadata"), META_SCHEMA)
    return df.groupBy("model", "version").agg(F.max_by("metadata", "at").alias("metadata"))


def read_model_metadata(spark: SparkSession, root: str, model: str) -> dict | None:
    """Metadata of the latest version (``max_by`` over the ledger)."""
    df = _read(spark, os.path.join(root, "model_metadata"), META_SCHEMA).filter(F.col("model") == model)
    r = df.agg(F.max_by("metadata", F.struct("version", "at")).alias("m")).collect()
    return json.loads(r[0]["m"]) if r and r[0]["m"] else None
