"""Registered queries of single functions: feature sets, contracts, keys, payloads, fallbacks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as X
from ..functions import constants as K
from ..operators import brief as BR
from ..operators import contract as CT
from ..operators import similarity as V
from ..session import materialize, scratch_path
from ..sources import listings as S
from ..sources import registry as REG
from ..sources import sinks as SK
from ..streaming import jobs as SJ
from . import jobs
from .catalog import register
from .oracle import sql

# ---- F9, F10, F11 ----------------------------------------------------------------------

_TOTAL, _LUX = "(kamar_tidur + kamar_mandi)", "(kamar_tidur * kamar_mandi * (garasi + 1))"
_F9_SQL = {
    "total_kamar": _TOTAL, "kamar_ratio": "kamar_tidur / (kamar_mandi + 1)", "garasi_kamar": f"garasi * {_TOTAL}",
    "luxury_score": _LUX, "rasio_bang_tanah": "luas_bangunan / (luas_tanah + 1)",
    "luas_per_kamar": f"luas_bangunan / ({_TOTAL} + 1)", "luas_total": "luas_tanah + luas_bangunan",
    "log_luas_tanah": "ln(1 + luas_tanah)", "log_luas_bangunan": "ln(1 + luas_bangunan)", "log_lokasi": "ln(1 + e)",
    "lokasi_x_kamar": f"e * {_TOTAL}", "lokasi_x_garasi": "e * garasi", "lokasi_x_luxury": f"ln(1 + e) * {_LUX}",
    "lokasi_x_luas_bang": "ln(1 + e) * ln(1 + luas_bangunan)", "lokasi_per_kamar": f"e / ({_TOTAL} + 1)",
}
_F10_SQL = {
    "rasio_bangunan_tanah": "luas_bangunan / (luas_tanah + 1)", "total_kamar": _TOTAL,
    "harga_per_m2_tanah": "harga / (luas_tanah + 1)", "harga_per_m2_bangunan": "harga / (luas_bangunan + 1)",
    "luas_total": "luas_tanah + luas_bangunan", "kamar_per_luas": f"{_TOTAL} / (luas_bangunan + 1)",
    "garasi_flag": "case when garasi > 0 then 1 else 0 end", "log_luas_tanah": "ln(1 + luas_tanah)",
    "log_luas_bangunan": "ln(1 + luas_bangunan)",
}


def _cols_sql(cols: dict[str, str]) -> str:
    return ", ".join(f"round(cast({e} as double), 7) as {n}" for n, e in cols.items())


def _rounded(cols):
    return [F.round(c.cast("double"), 7).alias(n) for n, c in cols.items()]


@register("regression_features", ids="F9", sql=sql(f"""
, a as (select lokasi as l, cast(count(*) as double) as e from reg group by lokasi)
select listing_id, {_cols_sql(_F9_SQL)} from reg join a on reg.lokasi = a.l""", "reg"))
def regression_features(spark, sf):
    """All 15 columns; the number of listings in the area stands in for the fitted area encoding."""
    reg = jobs.clean_regression_table(spark, sf)
    area = reg.groupBy("lokasi").agg(F.count(F.lit(1)).cast("double").alias("lokasi_target"))
    return reg.join(area, "lokasi").select("listing_id", *_rounded(X.regression_features("lokasi_target")))


@register("classification_features", ids="F10", sql=sql(f"""
select listing_id, {_cols_sql(_F10_SQL)} from cls""", "cls"))
def classification_features(spark, sf):
    return jobs.clean_classification_table(spark, sf).select("listing_id", *_rounded(X.classification_features()))


_AREAS = ["FRANCE", "KENYA", "NOWHERE"]


@register("area_indicators", ids="F11", sql=sql(
    "select listing_id, " + ", ".join(f"cast(lokasi = '{a}' as int) as \"lokasi_{a}\"" for a in _AREAS) + " from cls", "cls"))
def area_indicators(spark, sf):
    return jobs.clean_classification_table(spark, sf).select(
        "listing_id", *[c.alias(n) for n, c in X.one_hot_area(_AREAS).items()])


# ---- F13, F14 --------------------------------------------------------------------------

_STORED = ["luas_total", "garasi_flag", "lokasi_FRANCE", "not_built", "total_kamar"]


@register("feature_contract", ids="F13 F14", sql=sql(f"""
select listing_id, {_F10_SQL["luas_total"]} as luas_total, cast({_F10_SQL["garasi_flag"]} as double) as garasi_flag,
  cast(lokasi = 'FRANCE' as int) as "lokasi_FRANCE", cast(0 as double) as not_built, {_TOTAL} as total_kamar,
  'not_built' as missing, 8 as n_extra
from cls""", "cls"))
def feature_contract(spark, sf):
    """A stored feature list picks and orders the built columns; what it misses is reported, then filled."""
    cls = jobs.clean_classification_table(spark, sf)
    built = cls.select("listing_id", *[c.alias(n) for n, c in {**X.classification_features(), **X.one_hot_area(_AREAS)}.items()])
    picked, report = CT.select_feature_contract(built, ["listing_id", *_STORED])
    aligned = CT.align_columns(["listing_id", *_STORED], picked)
    return aligned.withColumn("garasi_flag", F.col("garasi_flag").cast("double")).withColumns(
        {"missing": F.lit(",".join(report["missing"])), "n_extra": F.lit(len(report["extra"]))})


# ---- F23, F19, S5, S11 --------------------------------------------------------------------

_PRED_SQL = """concat('{"kelas_id": ', cast(kelas_id as varchar), ', "lokasi": "', lokasi, '", "tool": "', tool, '", "top": null}')"""


@register("context_keys", ids="F23", sql=sql(f"""
select event_id, concat('rag:', md5(concat(concat('harga rumah di ', lokasi), ':', md5({_PRED_SQL})))) as context_key
from ev""", "ev"))
def context_keys(spark, sf):
    ev = jobs.prediction_events(spark, sf)
    pred = X.sorted_json({"tool": F.col("tool"), "lokasi": F.col("lokasi"), "kelas_id": F.col("kelas_id"),
                          "top": F.lit(None).cast("string")})
    return ev.select("event_id", X.context_key(F.concat(F.lit("harga rumah di "), F.col("lokasi")), pred).alias("context_key"))


@register("cached_contexts", ids="R2 F23 T5", sql=sql(f"""
, k as (select event_id, ts, concat('rag:', md5(concat(concat('harga rumah di ', lokasi), ':', md5({_PRED_SQL})))) as context_key, lokasi
        from ev)
, c as (select max(ts) - interval 3600 second as cutoff from k)
select context_key, lpad(cast(arg_max(event_id, (ts, event_id)) as varchar), 20, '0') as request_id,
  concat('## ', arg_max(lokasi, (ts, event_id))) as context
from k, c where ts > cutoff group by context_key""", "ev"))
def cached_contexts(spark, sf):
    """The context cache: texts under their F23 key, folded in micro-batches; the newest of each key, one hour long."""
    ev = jobs.prediction_events(spark, sf)
    pred = X.sorted_json({"tool": F.col("tool"), "lokasi": F.col("lokasi"), "kelas_id": F.col("kelas_id"),
                          "top": F.lit(None).cast("string")})
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = ev.select(F.concat(F.lit("harga rumah di "), F.col("lokasi")).alias("query"), pred.alias("prediction"),
                     F.timestamp_micros(us).alias("ts"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("request_id"),
                     F.concat(F.lit("## "), F.col("lokasi")).alias("brief"))
    rows = materialize(BR.brief_cache_rows(rows, prediction=F.col("prediction")), "contexts")
    root = scratch_path(spark, f"contexts-{uuid.uuid4().hex[:12]}")
    for b in range(2):
        SJ.fold_cache(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == b), b, root, "s0")
    now = rows.agg(F.max("ts").alias("m")).collect()[0]["m"]
    return SJ.cached(spark, root, F.lit(now)).select(
        F.col("cache_key").alias("context_key"), F.col("event_id").alias("request_id"), F.col("output_json").alias("context"))


@register("unclustered_documents", ids="F19 T2", sql=sql("""
select listing_id, case when listing_id % 3 = 0 then 'Unknown' else cluster_label end as segment_label,
  case when listing_id % 3 = 0 then -1 else cluster_id end as cluster_id
from clu_fixed""", "clu_fixed"))
def unclustered_documents(spark, sf):
    """Listings of which a third has no cluster yet."""
    df = jobs.clustered_fixed(spark, sf)
    lost = F.col("listing_id") % 3 == 0
    df = df.withColumns({c: F.when(~lost, F.col(c)) for c in ("cluster_label", "cluster_id")})
    return V.listing_documents(df).select("listing_id", "metadata.segment_label", "metadata.cluster_id")


@register("clustered_or_raw", ids="S5", sql=sql("""
select listing_id, lokasi, harga, cast(null as int) as cluster_id, cast(null as varchar) as cluster_label from reg""", "reg"))
def clustered_or_raw(spark, sf):
    """The clustered table is empty before the first clustering run: the clean rows stand in."""
    reg = jobs.clean_regression_table(spark, sf).select("listing_id", "lokasi", "harga")
    none = jobs.clustered_fixed(spark, sf).select("listing_id", "lokasi", "harga", "cluster_id", "cluster_label").filter("false")
    return S.read_with_fallback(none, reg)


@register("published_events", ids="S11", sql=sql("""
select event_id, concat('{"tool":"', tool, '","input":{"lokasi":"', lokasi, '","kamar_tidur":', cast(kamar_tidur as varchar),
  '},"output":{"kelas_id":', cast(kelas_id as varchar), ',"kelas_label":"', kelas_label, '"}}') as value
from ev""", "ev"))
def published_events(spark, sf):
    ev = jobs.prediction_events(spark, sf)
    return ev.select("event_id", SK.event_payload(F.col("tool"), ["lokasi", "kamar_tidur"], ["kelas_id", "kelas_label"]).alias("value"))


# ---- F25, F27 ----------------------------------------------------------------------------

#: Whole-number chances of the four segments of an event; equal ones occur.
_CHANCES = ["event_id * 7 % 11", "event_id * 5 % 11", "event_id % 11", "event_id * 3 % 11"]
_LABELS = [K.SEGMENT_LABELS[i] for i in range(4)]


@register("top_classes", ids="F25", sql="""
with p as (select event_id, unnest([""" + ", ".join(_CHANCES) + "]) as p, unnest([" + ", ".join(f"'{x}'" for x in _LABELS) + """]) as label
           from events)
select event_id, label as top_class from (
  select *, row_number() over (partition by event_id order by p desc, label) as rn from p) where rn = 1""")
def top_classes(spark, sf):
    probs = F.map_from_arrays(F.array(*map(F.lit, _LABELS)), F.array(*[F.expr(c).cast("double") for c in _CHANCES]))
    return fx.table(spark, sf, "events").select("event_id", X.top_class(probs).alias("top_class"))


@register("estimates_from_log", ids="F27", sql=sql("""
select listing_id, floor(greatest(exp(case when listing_id % 7 = 0 then -1 else 1 end * ln(1 + harga)) - 1, 0) + 0.1) as estimate
from reg""", "reg"))
def estimates_from_log(spark, sf):
    """Back from the models' scale; what is below 0 is clipped."""
    reg = jobs.clean_regression_table(spark, sf)
    out = F.log1p("harga") * F.when(F.col("listing_id") % 7 == 0, -1.0).otherwise(1.0)
    estimate = X.clip_nonnegative(X.estimate_from_log(out))
    return reg.select("listing_id", F.floor(estimate + 0.1).cast("double").alias("estimate"))


# ---- M12, S13 ----------------------------------------------------------------------------

@register("model_registry", ids="M12 S13", sql="""
with m as (select r_name as model, count(n_nationkey) as n from region join nation on r_regionkey = n_regionkey group by r_name),
v as (select model, n, unnest(generate_series(1, 1 + n % 3)) as version from m),
c as (select n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey group by n_name, r_name),
t as (select r_name, sum(customers) as customers from c group by r_name)
select model, cast(version as bigint) as version,
  case when version = (select max(version) from v w where w.model = v.model) then 'Production' else 'Archived' end as stage,
  cast(t.customers * version as bigint) as rows_seen
from v join t on t.r_name = v.model""")
def model_registry(spark, sf):
    """A model for each region: versions registered, described and promoted one after the other."""
    root = scratch_path(spark, f"registry-{uuid.uuid4().hex[:12]}")
    r, n, c = (fx.table(spark, sf, t) for t in ("region", "nation", "customer"))
    sizes = (r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
             .groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n"), F.count("c_custkey").alias("rows")))
    for m in sizes.collect():  # a row for each region
        for _ in range(1 + m["n"] % 3):
            version = REG.register_version(spark, root, m["r_name"], {"nations": m["n"]})
            REG.write_model_metadata(spark, root, m["r_name"], version, {"rows": m["rows"] * version})
            REG.promote(spark, root, m["r_name"], version)
    seen = F.get_json_object("metadata", "$.rows").cast("bigint").alias("rows_seen")
    meta = REG.model_metadata(spark, root).select("model", "version", seen)
    return REG.versions(spark, root).select("model", "version", "stage").join(meta, ["model", "version"])
