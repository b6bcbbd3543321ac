"""Registered batch queries: sources, parsing, cleaning, aggregation, joins, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as X
from ..functions import constants as K
from ..operators import analytics as A
from ..operators import cleaning as C
from ..operators import encoding as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import pricing as P
from . import jobs
from .catalog import REGISTRY, register
from .oracle import sql


def _reasons_sql(rooms: int, garages: int, prices: bool = False, top_k: bool = False) -> str:
    rules = [("kamar_tidur", f"kamar_tidur between 1 and {rooms}"), ("kamar_mandi", f"kamar_mandi between 1 and {rooms}"),
             ("garasi", f"garasi between 0 and {garages}"), ("luas_tanah", "luas_tanah > 0"),
             ("luas_bangunan", "luas_bangunan > 0"), ("lokasi", "length(lokasi) >= 2")]
    if prices:
        rules += [(c, f"{c} between 10000000 and 500000000000") for c in ("harga_prediksi", "harga_asli")]
    if top_k:
        rules.append(("top_k", "coalesce(try_cast(json_extract_string(payload, '$.input.top_k') as int), 3) between 1 and 20"))
    return "concat_ws(',', " + ", ".join(
        f"case when not coalesce({cond}, false) then '{name}' end" for name, cond in rules) + ") as reasons"


# ---- flagship ------------------------------------------------------------------------

def area_analytics(spark, sf):
    return A.area_analytics(jobs.clean_classification_table(spark, sf), jobs.feedback_stored(spark, sf))


register("area_analytics", ids="A1 A3 J1 W2 F1-F7 F15 F17 C1 C7 C8 C14", sql=sql("""
, fbs as (select lokasi, avg(selisih_persen) as avg_selisih from fb_valid group by lokasi)
, seg as (select lokasi, kelas_harga, count(*) as n from cls group by lokasi, kelas_harga)
, dom as (select lokasi, kelas_harga from (
    select *, row_number() over (partition by lokasi order by n desc, kelas_harga asc) as rn from seg) where rn = 1)
, st as (select lokasi, count(*) as total_data, avg(harga / luas_tanah) as avg_per_m2 from cls group by lokasi)
, top as (
  select st.lokasi, st.total_data, st.avg_per_m2, dom.kelas_harga as segmen_dom_id,
         coalesce(f.avg_selisih, 0) as trend_selisih
  from st join dom on st.lokasi = dom.lokasi left join fbs f on st.lokasi = f.lokasi
  order by st.total_data desc, st.lokasi asc limit 10)
select lokasi as nama, round(avg_per_m2, 2) as avg_per_m2, total_data,
  case when trend_selisih > 0 then concat('±', cast(cast(round_even(trend_selisih * 10, 0) as bigint) // 10 as varchar), '.',
       cast(cast(round_even(trend_selisih * 10, 0) as bigint) % 10 as varchar), '%') else 'N/A' end as trend,
  case segmen_dom_id when 0 then 'Murah' when 1 then 'Menengah' when 2 then 'Atas' when 3 then 'Mewah' else 'Menengah' end as segmen_dom,
  'The data is analyzed dynamically based on the classification model' as catatan
from top""", "cls", "fb_valid"))(area_analytics)


# ---- sources and parsing ---------------------------------------------------------------

@register("raw_property", ids="S1 S2 S4 F1 F2 F3 F4", sql=sql("select * from typed", "typed"))
def raw_property(spark, sf):
    return jobs.raw_property(spark, sf).select("listing_id", "created_at", "harga", "kamar_tidur", "kamar_mandi",
                                               "garasi", "luas_tanah", "luas_bangunan", "lokasi")


# ---- cleaning --------------------------------------------------------------------------

@register("clean_classification", ids="C1 C7 C8 F5 F6", sql=sql("""
select listing_id, lokasi, round(harga, 2) as harga, kamar_tidur, kamar_mandi, garasi,
  round(luas_tanah, 4) as luas_tanah, round(luas_bangunan, 4) as luas_bangunan, kelas_harga from cls""", "cls"))
def clean_classification(spark, sf):
    df = jobs.clean_classification(spark, sf)
    return df.select("listing_id", "lokasi", F.round("harga", 2).alias("harga"), "kamar_tidur", "kamar_mandi",
                     "garasi", F.round("luas_tanah", 4).alias("luas_tanah"),
                     F.round("luas_bangunan", 4).alias("luas_bangunan"), "kelas_harga")


@register("clean_regression", ids="C1 C2 C3 C4 C5 C6",
          sql=sql("select listing_id, harga, kamar_tidur, kamar_mandi, garasi, luas_tanah, luas_bangunan, lokasi from reg",
                  "reg"))
def clean_regression(spark, sf):
    return jobs.clean_regression(spark, sf).select(
        "listing_id", "harga", "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi")


_CLU_COLS = ["log_harga", "log_lt", "log_lb", "harga_per_m2", "log_harga_m2", "rasio_lb_lt", "lokasi_enc"]


@register("clean_clustering", ids="C1 C9 C10 C11 F12 E2", sql=sql(
    "select listing_id, lokasi, harga, luas_tanah, luas_bangunan, "
    + ", ".join(f"round({c}, 6) as {c}" for c in _CLU_COLS) + " from clu", "clu"))
def clean_clustering(spark, sf):
    df = jobs.clean_clustering(spark, sf)
    return df.select("listing_id", "lokasi", "harga", "luas_tanah", "luas_bangunan",
                     *[F.round(c, 6).alias(c) for c in _CLU_COLS])


@register("removal_report", ids="C12", sql=sql("""
select step_no, step, rows, coalesce(lag(rows) over (order by step_no) - rows, 0) as removed from (
  select 0 as step_no, 'raw' as step, (select count(*) from typed) as rows
  union all select 1, 'drop_incomplete', (select count(*) from complete)
  union all select 2, 'price_range', (select count(*) from clu1)
  union all select 3, 'iqr_harga', (select count(*) from clu2)
  union all select 4, 'iqr_luas_tanah', (select count(*) from clu3)
  union all select 5, 'iqr_luas_bangunan', (select count(*) from clu4)
  union all select 6, 'features', (select count(*) from clu))""", "clu"))
def removal_report(spark, sf):
    rep = C.StepCounts()
    jobs.clean_clustering(spark, sf, report=rep)
    return C.removal_report(rep).select(F.col("step_no").cast("int"), "step", "rows", "removed")


@register("feedback_validation", ids="C14 F15 S7", sql=sql("""
select feedback_id, lokasi, is_valid, selisih_persen, reasons from (
  select feedback_id, lokasi, """ + _reasons_sql(20, 10, prices=True) + """,
    kamar_tidur between 1 and 20 and kamar_mandi between 1 and 20 and garasi between 0 and 10
    and luas_tanah > 0 and luas_bangunan > 0 and length(lokasi) >= 2
    and harga_prediksi between 10000000 and 500000000000 and harga_asli between 10000000 and 500000000000 as is_valid,
    round_even(abs(harga_asli - harga_prediksi) / harga_prediksi * 100, 2) as selisih_persen
  from feedback)""", fixtures=("feedback",)))
def feedback_validation(spark, sf):
    fb = C.validate_feedback(fx.feedback(spark, sf))
    return fb.select("feedback_id", "lokasi", "is_valid", F.concat_ws(",", "reasons").alias("reasons"),
                     X.deviation_pct("harga_asli", "harga_prediksi").alias("selisih_persen"))


# ---- more cleaning / validation ----------------------------------------------------------

@register("request_validation", ids="C13 F20", sql=sql("""
select event_id, """ + _reasons_sql(10, 5, top_k=True) + """,
  (kamar_tidur between 1 and 10) and (kamar_mandi between 1 and 10) and (garasi between 0 and 5)
  and luas_tanah > 0 and luas_bangunan > 0 and length(lokasi) >= 2
  and coalesce(try_cast(json_extract_string(payload, '$.input.top_k') as int), 3) between 1 and 20 as is_valid
from ev""", "ev"))
def request_validation(spark, sf):
    return C.validate_requests(jobs.prediction_events(spark, sf)).select(
        "event_id", "is_valid", F.concat_ws(",", "reasons").alias("reasons"))


@register("unprocessed_feedback", ids="C15 J4", sql=sql("""
select feedback_id, lokasi, selisih_persen from fb_valid
where feedback_id in (select feedback_id from fb_valid where not processed)""", "fb_valid"))
def unprocessed_feedback(spark, sf):
    fb = jobs.feedback_stored(spark, sf)
    ids = C.unprocessed(fb).select("feedback_id")      # the snapshot a retrain takes
    return J.rows_by_ids(fb, ids, "feedback_id").select("feedback_id", "lokasi", "selisih_persen")


# ---- aggregations --------------------------------------------------------------------------

@register("area_price_stats", ids="A2 R8 T2 F19", sql=sql("""
, d as (select lokasi, cast(trunc(harga) as bigint) as harga, coalesce(cluster_label, 'Unknown') as segment_label from clu_fixed)
, m as (select lokasi, segment_label from (
    select lokasi, segment_label, row_number() over (partition by lokasi order by count(*) desc, segment_label) as rn
    from d group by lokasi, segment_label) where rn = 1)
select d.lokasi, cast((2 * sum(cast(d.harga as hugeint)) + count(*)) // (2 * count(*)) as bigint) as avg_harga,
  min(d.harga) as min_harga, max(d.harga) as max_harga, count(*) as jumlah_data, m.segment_label as dominant_segment
from d join m on d.lokasi = m.lokasi group by d.lokasi, m.segment_label""", "clu_fixed"))
def area_price_stats(spark, sf):
    from ..operators.similarity import listing_documents
    docs = listing_documents(jobs.clustered_fixed(spark, sf))
    flat = docs.select("metadata.lokasi", "metadata.harga", "metadata.segment_label")
    return A.area_price_stats(flat).withColumn("avg_harga", F.col("avg_harga").cast("bigint"))


@register("market_overview", ids="A4", sql="""
select nama, avg_per_m2, total_data, round(avg_per_m2 / max(avg_per_m2) over () * 100, 2) as bar_pct,
  round(avg(avg_per_m2) over (), 2) as market_avg_per_m2, cast(sum(total_data) over () as bigint) as market_total
from (""" + REGISTRY["area_analytics"].sql + ") a")
def market_overview(spark, sf):
    return A.market_overview(area_analytics(spark, sf))


@register("cluster_summary", ids="A5 W1", sql=sql("""
select cluster_id, count(*) as jumlah_data, min(harga) as harga_min, max(harga) as harga_max,
  round(median(harga), 2) as harga_median, round(median(luas_tanah), 4) as luas_tanah_median,
  round(median(luas_bangunan), 4) as luas_bangunan_median
from clu_fixed group by cluster_id""", "clu_fixed"))
def cluster_summary(spark, sf):
    s = A.cluster_summary(jobs.clustered_fixed(spark, sf))
    return s.withColumns({"harga_median": F.round("harga_median", 2),
                          "luas_tanah_median": F.round("luas_tanah_median", 4),
                          "luas_bangunan_median": F.round("luas_bangunan_median", 4)})


@register("dominant_areas", ids="A6", sql=sql("""
select cluster_id, lokasi, n_rows, rank from (
  select cluster_id, lokasi, count(*) as n_rows,
         row_number() over (partition by cluster_id order by count(*) desc, lokasi asc) as rank
  from clu_fixed group by cluster_id, lokasi) where rank <= 3""", "clu_fixed"))
def dominant_areas(spark, sf):
    return A.dominant_areas(jobs.clustered_fixed(spark, sf), 3).withColumn("rank", F.col("rank").cast("bigint"))


_CORR = ["kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan"]


@register("price_correlation", ids="A7", sql=sql(
    "select " + ", ".join(f"round(corr(cast(harga as double), cast({c} as double)), 6) as corr_{c}" for c in _CORR)
    + " from reg", "reg"))
def price_correlation(spark, sf):
    return A.price_correlation(jobs.clean_regression_table(spark, sf))


@register("segment_threshold", ids="A8", sql=sql("select round(median(harga), 2) as batas_segmen from reg", "reg"))
def segment_threshold(spark, sf):
    return A.segment_threshold(jobs.clean_regression_table(spark, sf)).select(F.round("batas_segmen", 2).alias("batas_segmen"))


@register("unprocessed_count", ids="A9 C15", sql=sql("""
select count(*) filter (where not processed) as unprocessed, count(*) filter (where not processed) >= 100 as should_retrain
from fb_valid""", "fb_valid"))
def unprocessed_count(spark, sf):
    return A.unprocessed_count(jobs.feedback_stored(spark, sf))


@register("history_summary", ids="A10 F20", sql=sql("""
select tool, count(*) as n_predictions, max(harga_estimasi) as max_harga,
  arg_max(lokasi, (harga_estimasi, lokasi)) as max_harga_lokasi, cast(round(avg(harga_estimasi), 0) as bigint) as avg_harga
from ev group by tool""", "ev"))
def history_summary(spark, sf):
    return A.history_summary(jobs.prediction_events(spark, sf), "tool")


@register("rank_clusters", ids="W1 F8", sql=sql("""
select cluster_raw, round(median_price, 2) as median_price, rank_id,
  case rank_id when 0 then 'Budget' when 1 then 'Affordable' when 2 then 'Mid-Market' when 3 then 'Premium'
    when 4 then 'Luxury' when 5 then 'Ultra-Luxury' when 6 then 'Tier-7' when 7 then 'Tier-8'
    else concat('Tier-', cast(rank_id + 1 as varchar)) end as cluster_label
from (select cluster_raw, median_price, cast(row_number() over (order by median_price, cluster_raw) - 1 as int) as rank_id
      from (select kamar_mandi as cluster_raw, median(harga) as median_price from clu group by kamar_mandi))""", "clu"))
def rank_clusters(spark, sf):
    df = jobs.clean_clustering_table(spark, sf).withColumn("cluster_raw", F.col("kamar_mandi"))
    r = A.rank_clusters(df, "cluster_raw")
    return r.select("cluster_raw", F.round("median_price", 2).alias("median_price"), "rank_id", "cluster_label")


@register("last_n_per_user", ids="W3", sql="""
select event_id, user_id, pos from (
  select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as pos
  from events) where pos <= 50""")
def last_n_per_user(spark, sf):
    ev = fx.table(spark, sf, "events")
    return A.last_n_per_key(ev, "user_id", "ts", 50, "event_id").select(
        "event_id", "user_id", F.col("pos").cast("bigint").alias("pos"))


# ---- metrics on the scored stand-in ------------------------------------------------------------

_T = K.DEFAULT_SEGMENT_THRESHOLD


def _scored_sides(spark, sf):
    s = fx.scored(spark, sf)
    side = P.price_side("harga_asli", _T)
    return s.withColumns({"side": side,
                          "p": F.when(side == "low", F.col("harga_low")).otherwise(F.col("harga_high")),
                          "y": F.col("harga_asli")})


_METRICS_SQL = f"""
, s as (select harga_asli as y, case when harga_asli <= {_T!r} then 'low' else 'high' end as side,
               greatest(case when harga_asli <= {_T!r} then harga_low else harga_high end, 0.0) as p from scored)
, m as (select coalesce(side, 'overall') as side, count(*) as n, round(sqrt(avg((y - p) * (y - p))), 2) as rmse,
          round(avg(abs(y - p)), 2) as mae, round(avg(abs(y - p) / y) * 100, 4) as mape,
          round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2
        from s group by rollup(side))
"""


@register("regression_metrics", ids="A11 F27", sql=sql(_METRICS_SQL + "select * from m", fixtures=("scored",)))
def regression_metrics(spark, sf):
    return M.regression_metrics(_scored_sides(spark, sf), "y", "p", "side")


@register("retrain_score", ids="A14", sql=sql(
    _METRICS_SQL + "select round(avg(mape), 4) as score from m where side in ('low', 'high')", fixtures=("scored",)))
def retrain_score(spark, sf):
    return M.retrain_score(regression_metrics(spark, sf))


def _seg_sql(c: str) -> str:
    return (f"case when {c} <= 745000000 then 0 when {c} <= 1300000000 then 1 "
            f"when {c} <= 2645000000 then 2 else 3 end")


@register("classification_report", ids="A12", sql=sql(f"""
, c as (select {_seg_sql('harga_asli')} as y, {_seg_sql('harga_final')} as p from blend)
, k as (select unnest([0, 1, 2, 3]) as cls)
, per as (select cast(k.cls as varchar) as label,
    coalesce(sum(case when y = k.cls and p = k.cls then 1 else 0 end), 0) as tp,
    coalesce(sum(case when p = k.cls then 1 else 0 end), 0) as pr,
    coalesce(sum(case when y = k.cls then 1 else 0 end), 0) as tr
  from k left join c on true group by k.cls)
, met as (select label, case when pr > 0 then tp / pr else 0.0 end as precision,
    case when tr > 0 then tp / tr else 0.0 end as recall, tr as support from per)
, f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from met)
, tot as (select count(*) as n, sum(case when y = p then 1 else 0 end) as correct from c)
select label, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, cast(support as bigint) as support from f
union all select 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), (select n from tot) from f
union all select 'accuracy', round(correct / n, 4), round(correct / n, 4), round(correct / n, 4), n from tot""", "blend"))
def classification_report(spark, sf):
    b = P.route_and_blend(fx.scored(spark, sf), _T, K.STORED_MAPE_LOW, K.STORED_MAPE_HIGH)
    df = b.select(X.price_segment("harga_asli").alias("y"), X.price_segment("harga_final").alias("p"))
    return M.classification_report(df, "y", "p")


_QF = ["log_harga", "log_lt", "log_lb"]


@register("cluster_quality", ids="A13", sql=sql(f"""
, cen as (select cluster_id, count(*) as n_i, {", ".join(f"avg({c}) as c_{c}" for c in _QF)} from clu_fixed group by cluster_id)
, g as (select count(*) as n, {", ".join(f"avg({c}) as g_{c}" for c in _QF)} from clu_fixed)
, d as (select x.cluster_id, sqrt({" + ".join(f"(x.{c} - cen.c_{c}) * (x.{c} - cen.c_{c})" for c in _QF)}) as dist
        from clu_fixed x join cen on x.cluster_id = cen.cluster_id)
, s as (select cluster_id, avg(dist) as s_i, sum(dist * dist) as w_i from d group by cluster_id)
, cs as (select cen.*, s.s_i, s.w_i from cen join s on cen.cluster_id = s.cluster_id)
, r as (select a.cluster_id, max((a.s_i + b.s_i) / sqrt({" + ".join(f"(a.c_{c} - b.c_{c}) * (a.c_{c} - b.c_{c})" for c in _QF)})) as r_i
        from cs a join cs b on a.cluster_id <> b.cluster_id group by a.cluster_id)
select round((select avg(r_i) from r), 6) as davies_bouldin,
  round(((select sum(n_i * ({" + ".join(f"(c_{c} - g_{c}) * (c_{c} - g_{c})" for c in _QF)})) from cs, g) / ((select count(*) from cs) - 1))
        / ((select sum(w_i) from cs) / ((select n from g) - (select count(*) from cs))), 4) as calinski_harabasz,
  cast((select count(*) from cs) as int) as n_clusters, (select n from g) as n_rows""", "clu_fixed"))
def cluster_quality(spark, sf):
    return M.cluster_quality(jobs.clustered_fixed(spark, sf), _QF)


@register("silhouette", ids="A13", sql=sql(f"""
, q as (select * from clu_fixed where listing_id % 20 = 0)
, n as (select cluster_id, count(*) as n from clu_fixed group by cluster_id)
, p as (select q.listing_id, q.cluster_id as own, x.cluster_id as other,
          sum(sqrt({" + ".join(f"(q.{c} - x.{c}) * (q.{c} - x.{c})" for c in _QF)})) as d
        from q, clu_fixed x group by q.listing_id, q.cluster_id, x.cluster_id)
, m as (select p.*, n.n, case when own = other then case when n.n > 1 then d / (n.n - 1) end else d / n.n end as mean
        from p join n on p.other = n.cluster_id)
, s as (select listing_id, own, max(case when own = other then mean end) as a, min(case when own <> other then mean end) as b
        from m group by listing_id, own)
, v as (select own, case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end as s from s)
, t as (select own as cluster_id, n.n as n_rows, count(*) as n_sampled, avg(s) as s, sqrt(coalesce(var_samp(s), 0) / count(*)) as e
        from v join n on v.own = n.cluster_id group by own, n.n)
select cluster_id, n_rows, n_sampled, round(s, 6) as silhouette, round(e, 6) as std_error from t
union all
select null, cast(sum(n_rows) as bigint), cast(sum(n_sampled) as bigint), round(sum(n_rows * s) / sum(n_rows), 6),
  round(sqrt(sum(n_rows * e * n_rows * e)) / sum(n_rows), 6) from t""", "clu_fixed"))
def silhouette(spark, sf):
    df = jobs.clustered_fixed(spark, sf)
    out = M.silhouette_sample(df, df.where("listing_id % 20 = 0"), _QF)
    return out.withColumns({c: F.round(c, 6) for c in ("silhouette", "std_error")})


# ---- pricing math ---------------------------------------------------------------------------

@register("train_test_split", ids="M1", sql=sql("""
select listing_id, (('0x' || substr(md5(cast(listing_id as varchar)), 1, 8))::BIGINT % 100) < 80 as is_train from reg""",
                                                "reg"))
def train_test_split(spark, sf):
    return P.train_test_split(jobs.clean_regression_table(spark, sf), "listing_id").select("listing_id", "is_train")


@register("stratified_split", ids="M2", sql=sql("""
select listing_id, kelas_harga, rn <= floor(n * 0.8 + 0.5) as is_train from (
  select listing_id, kelas_harga, count(*) over (partition by kelas_harga) as n, row_number() over (partition by kelas_harga
    order by ('0x' || substr(md5(concat(cast(kelas_harga as varchar), '|', cast(listing_id as varchar))), 1, 8))::BIGINT, listing_id) as rn
  from cls)""", "cls"))
def stratified_split(spark, sf):
    df = jobs.clean_classification_table(spark, sf)
    return P.stratified_split(df, "listing_id", "kelas_harga").select("listing_id", "kelas_harga", "is_train")


@register("extreme_weights", ids="M3", sql=sql(f"""
select listing_id, side, case when (side = 'low' and harga < {_T / 2!r}) or (side = 'high' and harga > {_T * 2!r})
  then 2.0 else 1.0 end as weight
from (select listing_id, harga, case when harga <= {_T!r} then 'low' else 'high' end as side from reg)""", "reg"))
def extreme_weights(spark, sf):
    df = jobs.clean_regression_table(spark, sf).withColumn("side", P.price_side("harga", _T))
    return P.extreme_weights(df, _T).select("listing_id", "side", "weight")


@register("route_and_blend", ids="M5 F16", sql=sql("""
select listing_id, cast(round_even(harga_final, 0) as bigint) as harga_estimasi, model_digunakan,
  round(mape_persen, 4) as mape_persen,
  case when harga_final >= 1e9 then concat('Rp ', cast(cast(round_even(harga_final / 1e7, 0) as bigint) // 100 as varchar), '.',
         lpad(cast(cast(round_even(harga_final / 1e7, 0) as bigint) % 100 as varchar), 2, '0'), ' Miliar')
       when harga_final >= 1e6 then concat('Rp ', cast(cast(round_even(harga_final / 1e5, 0) as bigint) // 10 as varchar), '.',
         cast(cast(round_even(harga_final / 1e5, 0) as bigint) % 10 as varchar), ' Juta')
       else concat('Rp ', format('{:,}', cast(trunc(harga_final) as bigint))) end as harga_estimasi_format
from blend""", "blend"))
def route_and_blend(spark, sf):
    b = P.route_and_blend(fx.scored(spark, sf), _T, K.STORED_MAPE_LOW, K.STORED_MAPE_HIGH)
    return b.select("listing_id", "harga_estimasi", "model_digunakan", F.round("mape_persen", 4).alias("mape_persen"),
                    "harga_estimasi_format")


# ---- encoders --------------------------------------------------------------------------------

@register("target_encoder", ids="E1", sql=sql("""
, p as (select avg(harga) as prior from reg)
, a as (select lokasi, count(*) as n, avg(harga) as mean from reg where lokasi is not null group by lokasi)
select lokasi, n, round(case when n = 1 then prior
  else prior * (1 - 1.0 / (1.0 + exp(-(n - 20) / 10.0))) + mean * (1.0 / (1.0 + exp(-(n - 20) / 10.0))) end, 0) as enc
from a, p""", "reg"))
def target_encoder(spark, sf):
    enc = E.fit_target_encoder(jobs.clean_regression_table(spark, sf))
    return enc.select("lokasi", "n", F.round("enc", 0).alias("enc"))


_ZF = ["log_harga", "log_lt", "log_lb", "log_harga_m2", "rasio_lb_lt"]


@register("standardize", ids="E3", sql=sql(
    ", st as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _ZF) + " from clu)\n"
    "select listing_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) as {c}_z" for c in _ZF) + " from clu, st",
    "clu"))
def standardize(spark, sf):
    df = jobs.clean_clustering_table(spark, sf)
    z = E.standardize(df, E.fit_standardizer(df, _ZF))
    return z.select("listing_id", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in _ZF])


@register("encoder_lookup", ids="J3 E2", sql=sql("""
, e as (select lokasi, median(log_harga) as lokasi_enc from clu where lokasi is not null group by lokasi)
, fb as (select median(lokasi_enc) as m from e)
select f.feedback_id, f.lokasi, round(coalesce(e.lokasi_enc, fb.m), 6) as lokasi_enc
from fb_valid f left join e on f.lokasi = e.lokasi, fb""", "clu", "fb_valid"))
def encoder_lookup(spark, sf):
    clu = jobs.clean_clustering_table(spark, sf)
    enc = E.fit_median_encoder(clu.drop("lokasi_enc"), "lokasi", "log_harga")
    out = E.encoder_lookup(jobs.feedback_stored(spark, sf), enc)
    return out.select("feedback_id", "lokasi", F.round("lokasi_enc", 6).alias("lokasi_enc"))


# ---- joins ----------------------------------------------------------------------------------

@register("collection_filter", ids="J2", sql="""
select e.vec_id, e.label from embeddings e
join (select distinct label as collection_id, concat('collection_', cast(label as varchar)) as name from embeddings) c
  on e.label = c.collection_id
where c.name = 'collection_1'""")
def collection_filter(spark, sf):
    emb = fx.table(spark, sf, "embeddings")
    collections = emb.select(F.col("label").alias("collection_id")).distinct().withColumn(
        "name", F.concat(F.lit("collection_"), F.col("collection_id").cast("string")))
    store = emb.select("vec_id", "label", F.col("label").alias("collection_id"))
    return J.filter_by_collection(store, collections, "collection_1").select("vec_id", "label")


@register("cluster_summary_lookup", ids="J5", sql=sql("""
, s as (select cluster_id, count(*) as jumlah_data, round(median(harga), 2) as harga_median from clu_fixed group by cluster_id)
select ev.event_id, ev.cluster_id, s.jumlah_data, s.harga_median
from ev left join s on ev.cluster_id = s.cluster_id where ev.topic = 'property.prediction.clustering'""",
                                                         "clu_fixed", "ev"))
def cluster_summary_lookup(spark, sf):
    summ = A.cluster_summary(jobs.clustered_fixed(spark, sf)).select(
        "cluster_id", "jumlah_data", F.round("harga_median", 2).alias("harga_median"))
    ev = jobs.prediction_events(spark, sf).filter(F.col("topic") == "property.prediction.clustering")
    return J.attach_cluster_summary(ev.select("event_id", "cluster_id"), summ)


@register("base_plus_feedback", ids="J6", sql=sql("""
select harga, kamar_tidur, kamar_mandi, garasi, luas_tanah, luas_bangunan, lokasi, 'base' as origin from reg
union all
select harga_asli, kamar_tidur, kamar_mandi, garasi, luas_tanah, luas_bangunan, lokasi, 'feedback' from fb_valid""",
                                                  "reg", "fb_valid"))
def base_plus_feedback(spark, sf):
    return J.base_plus_feedback(jobs.clean_regression_table(spark, sf), jobs.feedback_stored(spark, sf))


_LAND = [50.0, 100.0, 200.0, 500.0, 1000.0]


def _top_areas(df, n: int = 8) -> list[str]:
    """The n most frequent areas (one small aggregate; n names reach the driver)."""
    rows = (df.groupBy("lokasi").agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.col("c").desc(), F.col("lokasi")).limit(n).collect())
    return [r["lokasi"] for r in rows]


@register("scenario_grid", ids="J8 F10", sql=sql(f"""
, ar as (select lokasi as a from reg group by lokasi order by count(*) desc, lokasi limit 8)
, v as (select r.listing_id, 'lokasi' as vary, ar.a as lokasi, r.luas_tanah, r.luas_bangunan from reg r, ar
        union all
        select r.listing_id, 'luas_tanah', r.lokasi, s.lt, r.luas_bangunan from reg r,
          (select unnest({_LAND!r}) as lt) s)
select listing_id, vary, lokasi, luas_tanah, round(luas_bangunan / (luas_tanah + 1), 9) as rasio_bangunan_tanah,
  luas_tanah + luas_bangunan as luas_total from v""", "reg"))
def scenario_grid(spark, sf):
    reg = jobs.clean_regression_table(spark, sf)
    g = J.scenario_grid(reg, _top_areas(reg), _LAND)
    feats = X.classification_features()
    return g.select("listing_id", "vary", "lokasi", "luas_tanah",
                    F.round(feats["rasio_bangunan_tanah"], 9).alias("rasio_bangunan_tanah"),
                    feats["luas_total"].alias("luas_total"))


@register("scenario_feature_diff", ids="J9 F10", sql=sql("""
, a as (select listing_id, luas_bangunan / (100.0 + 1) as rasio_bangunan_tanah, harga / (100.0 + 1) as harga_per_m2_tanah,
          100.0 + luas_bangunan as luas_total, ln(1 + 100.0) as log_luas_tanah,
          luas_bangunan / (200.0 + 1) as b_rasio, harga / (200.0 + 1) as b_hpm, 200.0 + luas_bangunan as b_lt,
          ln(1 + 200.0) as b_log from reg)
, u as (select listing_id, 'rasio_bangunan_tanah' as feature, rasio_bangunan_tanah as a, b_rasio as b from a
        union all select listing_id, 'harga_per_m2_tanah', harga_per_m2_tanah, b_hpm from a
        union all select listing_id, 'luas_total', luas_total, b_lt from a
        union all select listing_id, 'log_luas_tanah', log_luas_tanah, b_log from a)
select listing_id, feature, round(b - a, 6) as diff from u where abs(b - a) > 0.0001""", "reg"))
def scenario_feature_diff(spark, sf):
    reg = jobs.clean_regression_table(spark, sf)
    def feats(lt: float):
        return X.classification_features({"luas_tanah": F.lit(lt)})

    d = J.feature_diff(reg, feats(100.0), feats(200.0), "listing_id")
    return d.select("listing_id", "feature", F.round("diff", 6).alias("diff"))
