"""Registered forms of the streaming operators (R1-R4, R6-R8): batch forms, and handlers run over micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import constants as K
from ..session import materialize, scratch_path
from ..streaming import events as EV
from ..streaming import jobs as SJ
from . import jobs
from .catalog import register
from .oracle import sql

_REG, _CLS, _CLU = (EV.TOPICS[k] for k in ("regression", "classification", "clustering"))


def _epoch_us(c: str):
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no time-zone conversion)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def _key_sql(kind: str) -> str:
    parts = ", ".join(f"coalesce(json_extract_string(payload, '$.input.{f}'), '')" for f in EV.KEY_FIELDS[kind])
    return f"concat_ws(':', '{kind}', {parts})"


_AUDIT_SQL = f"""
select event_id, ts, topic, tool,
  case when topic = '{_REG}' then harga_estimasi end as metric_harga_estimasi,
  latency_ms as metric_latency_ms,
  case when topic = '{_CLU}' then cast(cluster_id as double) end as metric_cluster_id,
  lokasi as tag_lokasi,
  case when topic = '{_REG}' then model_digunakan end as tag_model_digunakan,
  case when topic = '{_CLS}' then kelas_label end as tag_kelas_label,
  case when topic = '{_CLS}' then cast(kelas_id as varchar) end as tag_kelas_id,
  case when topic = '{_CLU}' then cluster_label end as tag_cluster_label,
  case when topic = '{_REG}' then {_key_sql('regression')} when topic = '{_CLS}' then {_key_sql('classification')}
       when topic = '{_CLU}' then {_key_sql('clustering')} end as cache_key
from ev"""


def _audit(spark, sf):
    a = EV.audit_rows(jobs.prediction_events(spark, sf))

    def m(col, k):
        return F.try_element_at(F.col(col), F.lit(k))

    return a.select("event_id", "ts", "topic", "tool",
                    m("metrics", "harga_estimasi").alias("metric_harga_estimasi"),
                    m("metrics", "latency_ms").alias("metric_latency_ms"),
                    m("metrics", "cluster_id").alias("metric_cluster_id"),
                    m("tags", "lokasi").alias("tag_lokasi"),
                    m("tags", "model_digunakan").alias("tag_model_digunakan"),
                    m("tags", "kelas_label").alias("tag_kelas_label"),
                    m("tags", "kelas_id").alias("tag_kelas_id"),
                    m("tags", "cluster_label").alias("tag_cluster_label"),
                    "cache_key")


@register("audit_rows", ids="R1 F20 F21 F22 S10", sql=sql(
    "select * exclude (ts) from (" + _AUDIT_SQL + ")", "ev"))
def audit_rows(spark, sf):
    return _audit(spark, sf).drop("ts")


@register("latest_prediction_cache", ids="R2", sql=sql(f"""
, a as ({_AUDIT_SQL})
, c as (select max(ts) - interval 3600 second as cutoff from a)
select cache_key, epoch_us(max(ts)) as ts_us, arg_max(event_id, (ts, event_id)) as event_id
from a, c where ts > cutoff and cache_key is not null group by cache_key""", "ev"))
def latest_prediction_cache(spark, sf):
    # cache keys exist for the three prediction topics; filtering on the topic (not on the
    # key expression) keeps the JSON parse out of the pushed-down predicate
    # event times stay TIMESTAMP_NTZ end to end, so the result does not depend on the
    # session time zone
    a = _audit(spark, sf).filter(F.col("topic").isin(_REG, _CLS, _CLU))
    # reference time = newest event (one column scan of the event table)
    now = fx.table(spark, sf, "events").agg(F.max("ts").alias("m")).collect()[0]["m"]
    log = a.select("cache_key", "ts", "event_id", F.lit("").alias("output_json"))
    out = SJ.latest_per_key(log, now=F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))  # no zone shift
    return out.select("cache_key", _epoch_us("ts").alias("ts_us"), "event_id")


@register("folded_prediction_cache", ids="R2", sql=sql(f"""
, a as ({_AUDIT_SQL})
, c as (select max(ts) - interval 3600 second as cutoff from a)
select cache_key, epoch_us(max(ts)) as ts_us, arg_max(event_id, (ts, event_id)) as event_id
from a, c where ts > cutoff and cache_key is not null group by cache_key""", "ev"))
def folded_prediction_cache(spark, sf):
    """R2 as the stream does it: micro-batches in an order unlike that of time, one of them twice."""
    rows = _audit(spark, sf).select("cache_key", F.timestamp_micros(_epoch_us("ts")).alias("ts"),
                                    F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), F.lit("").alias("output_json"))
    rows = materialize(rows, "cache-events")
    root = scratch_path(spark, f"cache-{uuid.uuid4().hex[:12]}")
    for b in range(4):
        for _ in range(2 if b == 1 else 1):
            SJ.fold_cache(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == b), b, root, "s0")
    now = rows.agg(F.max("ts").alias("m"))
    cached = SJ.cached(spark, root, F.lit(now.collect()[0]["m"]))
    return cached.select("cache_key", F.unix_micros("ts").alias("ts_us"), F.col("event_id").cast("bigint").alias("event_id"))


# Feedback cut into fixed micro-batches of uneven size: batch b holds the events whose id modulo
# 100 lies below the b-th bound (and not below an earlier one).
_CUTS = (2, 6, 25, 26, 100)
_BATCH_SQL = "case " + " ".join(f"when feedback_id % 100 < {c} then {b}" for b, c in enumerate(_CUTS)) + " end"

# The handler's rule: after each batch, if the pending rows reach the threshold, a run takes all of them.
_RUNS_SQL = f"""
, n as (select {_BATCH_SQL} as b, count(*) as c from fb_valid group by 1)
, bn as (select u.b, coalesce(n.c, 0) as c from (select unnest(range({len(_CUTS)})) as b) u left join n on n.b = u.b)
, r as (
  select -1 as b, cast(0 as bigint) as pending, cast(0 as bigint) as fired
  union all
  select r.b + 1, case when r.pending + bn.c >= {K.RETRAIN_THRESHOLD} then 0 else r.pending + bn.c end,
    case when r.pending + bn.c >= {K.RETRAIN_THRESHOLD} then r.pending + bn.c else 0 end
  from r join bn on bn.b = r.b + 1)"""


def _handled(spark, sf) -> str:
    """Runs the handler of R3/R4 over the micro-batches; returns its folder."""
    fb = fx.feedback(spark, sf)
    value = F.to_json(F.struct("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi",
                               "harga_prediksi", "harga_asli", "sumber"))
    rows = fb.select(F.col("feedback_id").cast("string").alias("event_id"), F.col("created_at").cast("timestamp").alias("created_at"),
                     value.alias("value"), F.expr(_BATCH_SQL).alias("b"))
    root = scratch_path(spark, f"feedback-{uuid.uuid4().hex[:12]}")
    handle = SJ.feedback_batch_handler(root)
    for b in range(len(_CUTS)):
        handle(rows.filter(F.col("b") == b).drop("b"), b)
    return root


@register("retrain_runs", ids="R3 R4 R7 A9", sql=sql(_RUNS_SQL + """
select cast(b as bigint) as batch_id, fired as feedback_count, 'success' as status from r where fired > 0""", "fb_valid",
    recursive=True))
def retrain_runs(spark, sf):
    runs = SJ.run_status(spark.read.parquet(f"{_handled(spark, sf)}/ledger"))
    return runs.select("batch_id", "feedback_count", "status")


@register("processed_after_runs", ids="R6 C15", sql=sql(_RUNS_SQL + f"""
select feedback_id, {_BATCH_SQL} <= (select max(b) from r where fired > 0) as processed from fb_valid""", "fb_valid",
    recursive=True))
def processed_after_runs(spark, sf):
    root = _handled(spark, sf)
    done = SJ.processed_ids(spark, root).select("feedback_id", F.lit(True).alias("_p"))
    return SJ.stored_feedback(spark, root).join(done, "feedback_id", "left").select(
        F.col("feedback_id").cast("bigint").alias("feedback_id"), F.coalesce("_p", F.lit(False)).alias("processed"))


@register("audit_redelivered", ids="R1 S10", sql=sql(f"""
select case when event_id % 5 < 2 then concat(topic, '-', cast(event_id % 4 as varchar), '-', cast(event_id // 4 as varchar))
            else concat(topic, '/', cast(event_id // 3 as varchar)) end as event_key, topic, tool,
  case when topic = '{_REG}' then {_key_sql('regression')} when topic = '{_CLS}' then {_key_sql('classification')}
       when topic = '{_CLU}' then {_key_sql('clustering')} end as cache_key
from ev""", "ev"))
def audit_redelivered(spark, sf):
    """R1 over Kafka records: offsets repeat in every partition, producers of different topics give the same
    ids, some give an empty one or none, and one event in seven comes twice: at another offset if
    its id tells, else the very same record."""
    e = fx.prediction_events(spark, sf)
    eid = F.col("event_id")
    own = F.when(eid % 5 == 0, F.lit("{")).when(eid % 5 == 1, F.lit('{"event_id":"",')).otherwise(
        F.concat(F.lit('{"event_id":"'), F.expr("event_id div 3").cast("string"), F.lit('",')))
    value = F.concat(own, F.expr("substring(payload, 2)"))
    records = e.select(value.cast("binary").alias("value"), F.col("ts").alias("timestamp"), "topic",
                       (eid % 4).cast("int").alias("partition"), F.expr("event_id div 4").alias("offset"), (eid % 5 > 1).alias("named"),
                       F.explode(F.sequence(F.lit(0), (eid % 7 == 0).cast("int"))).alias("delivery"))
    records = records.withColumn("offset", F.col("offset") + F.when(F.col("named"), F.col("delivery") * 10 ** 9).otherwise(0))
    rows = EV.audit_rows(EV.parse_prediction_event(SJ.kafka_events(records)))
    return SJ.audit_log(rows).select(F.col("event_id").alias("event_key"), "topic", "tool", "cache_key")


@register("live_area_stats", ids="R8", sql=sql("""
select lokasi, count(*) as jumlah_data, min(harga) as min_harga, max(harga) as max_harga, round(avg(harga), 2) as avg_harga
from clu group by lokasi""", "clu"))
def live_area_stats(spark, sf):
    s = SJ.live_area_stats(jobs.clean_clustering_table(spark, sf))
    return s.withColumn("avg_harga", F.round("avg_harga", 2))
