"""DuckDB twins of the registered queries (correctness gate only).

Shared CTE fragments mirror the Spark jobs step by step.  DuckDB casts of
doubles to integers round, Spark's truncate: the twins use ``trunc`` first.
"""

from __future__ import annotations

from ..fixtures import with_fixtures
from ..functions import constants as K

_T = K.DEFAULT_SEGMENT_THRESHOLD
_M = _T * K.BLEND_MARGIN
_LO, _HI, _W = _T - _M, _T + _M, 2 * _M

NUM6 = ["harga", "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan"]


def _price(c: str) -> str:
    t = f"replace({c}, ',', '.')"
    n = f"try_cast(regexp_extract({t}, '[0-9.]+', 0) as double)"
    return (f"case when lower({t}) like '%miliar%' then {n} * 1000000000 "
            f"when lower({t}) like '%juta%' then {n} * 1000000 else {n} end")


def _area(c: str) -> str:
    return f"try_cast(regexp_extract({c}, '[0-9.]+', 0) as double)"


def _num(c: str) -> str:
    return f"try_cast(trim({c}) as double)"


CTE = {
    # S2 + F1-F4
    "typed": f"""
select listing_id, created_at,
  {_price('harga')} as harga,
  cast(trunc({_num('kamar_tidur')}) as int) as kamar_tidur,
  cast(trunc({_num('kamar_mandi')}) as int) as kamar_mandi,
  cast(trunc(coalesce({_num('garasi')}, 0)) as int) as garasi,
  {_area('luas_tanah')} as luas_tanah,
  {_area('luas_bangunan')} as luas_bangunan,
  kecamatan as lokasi
from listings_raw""",
    # C1
    "complete": "select * from typed where " + " and ".join(f"{c} is not null" for c in NUM6),
    # C7 fences (one row)
    "fences": "select " + ", ".join(
        f"quantile_cont(cast({c} as double), [0.25, 0.75]) as q_{c}" for c in NUM6) + " from complete",
    # C8
    "cls_clean": """
select listing_id, lokasi,
  least(greatest(harga, q_harga[1] - 1.5 * (q_harga[2] - q_harga[1])), q_harga[2] + 1.5 * (q_harga[2] - q_harga[1])) as harga,
""" + ",\n".join(
        f"  cast(trunc(least(greatest(cast({c} as double), q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1])), q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]))) as int) as {c}"
        for c in ["kamar_tidur", "kamar_mandi", "garasi"]) + ",\n" + ",\n".join(
        f"  least(greatest({c}, q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1])), q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1])) as {c}"
        for c in ["luas_tanah", "luas_bangunan"]) + """
from complete, fences""",
    "cls": """
select *, cast(case when harga <= 745000000 then 0 when harga <= 1300000000 then 1
                    when harga <= 2645000000 then 2 else 3 end as int) as kelas_harga
from cls_clean""",
    # C14 + F15
    "fb_valid": """
select *, round_even(abs(harga_asli - harga_prediksi) / harga_prediksi * 100, 2) as selisih_persen
from feedback
where kamar_tidur between 1 and 20 and kamar_mandi between 1 and 20 and garasi between 0 and 10
  and luas_tanah > 0 and luas_bangunan > 0 and length(lokasi) >= 2
  and harga_prediksi between 10000000 and 500000000000 and harga_asli between 10000000 and 500000000000""",
    # C2
    "sane": """
select * from complete
where luas_bangunan > 10 and luas_tanah > 10 and not (luas_tanah > 400 and luas_bangunan < 150)
  and luas_bangunan <= 600 and luas_tanah <= 1000 and kamar_tidur <= 8 and kamar_mandi <= 8
  and garasi <= 6 and harga >= 200000000""",
    # C3
    "reg3": """
select s.* from sane s, (select quantile_cont(harga, [0.01, 0.99]) as q from sane) b
where s.harga between b.q[1] and b.q[2]""",
    # C4
    "reg4": """
select r.* from reg3 r join (select lokasi, count(*) as n, quantile_cont(harga, [0.05, 0.95]) as q
                             from reg3 where lokasi is not null group by lokasi) g on r.lokasi = g.lokasi
where g.n < 10 or r.harga between g.q[1] and g.q[2]""",
    # C5
    "reg": """
select r.* from reg4 r, (select quantile_cont(harga / luas_bangunan, [0.05, 0.95]) as q from reg4) b
where r.harga / r.luas_bangunan between b.q[1] and b.q[2]""",
    # C9, C10
    "clu1": "select * from complete where harga between 50000000 and 10000000000",
    "clu2": """
select c.* from clu1 c, (select quantile_cont(harga, [0.25, 0.75]) as q from clu1) b
where c.harga between b.q[1] - 1.5 * (b.q[2] - b.q[1]) and b.q[2] + 1.5 * (b.q[2] - b.q[1])""",
    "clu3": """
select c.* from clu2 c, (select quantile_cont(luas_tanah, [0.25, 0.75]) as q from clu2) b
where c.luas_tanah between b.q[1] - 1.5 * (b.q[2] - b.q[1]) and b.q[2] + 1.5 * (b.q[2] - b.q[1])""",
    "clu4": """
select c.* from clu3 c, (select quantile_cont(luas_bangunan, [0.25, 0.75]) as q from clu3) b
where c.luas_bangunan between b.q[1] - 1.5 * (b.q[2] - b.q[1]) and b.q[2] + 1.5 * (b.q[2] - b.q[1])""",
    # F12
    "clu5": """
select *, ln(1 + harga) as log_harga, ln(1 + luas_tanah) as log_lt, ln(1 + luas_bangunan) as log_lb,
  harga / nullif(luas_bangunan, 0) as harga_per_m2, ln(1 + harga / nullif(luas_bangunan, 0)) as log_harga_m2,
  luas_bangunan / nullif(luas_tanah, 0) as rasio_lb_lt
from clu4""",
    # E2 + drop null features
    "clu": """
select c.*, e.lokasi_enc from clu5 c
left join (select lokasi, median(log_harga) as lokasi_enc from clu5 where lokasi is not null group by lokasi) e
  on c.lokasi = e.lokasi
where c.log_harga is not null and c.log_lt is not null and c.log_lb is not null and c.log_harga_m2 is not null
  and c.rasio_lb_lt is not null and c.kamar_tidur is not null and c.kamar_mandi is not null and e.lokasi_enc is not null""",
    # fixed cluster assignment (price segment) standing in for the KMeans output
    "clu_fixed": """
select *, cast(case when harga <= 745000000 then 0 when harga <= 1300000000 then 1
                    when harga <= 2645000000 then 2 else 3 end as int) as cluster_id,
  case (case when harga <= 745000000 then 0 when harga <= 1300000000 then 1
             when harga <= 2645000000 then 2 else 3 end)
    when 0 then 'Budget' when 1 then 'Affordable' when 2 then 'Mid-Market' when 3 then 'Premium'
    when 4 then 'Luxury' when 5 then 'Ultra-Luxury' end as cluster_label
from clu""",
    # F20 over the three prediction topics
    "ev": """
select event_id, ts, topic, payload,
  json_extract_string(payload, '$.tool') as tool,
  coalesce(json_extract_string(payload, '$.input.lokasi'), 'unknown') as lokasi,
  cast(json_extract(payload, '$.input.luas_tanah') as double) as luas_tanah,
  cast(json_extract(payload, '$.input.luas_bangunan') as double) as luas_bangunan,
  cast(json_extract(payload, '$.input.kamar_tidur') as int) as kamar_tidur,
  cast(json_extract(payload, '$.input.kamar_mandi') as int) as kamar_mandi,
  cast(json_extract(payload, '$.input.garasi') as int) as garasi,
  coalesce(cast(json_extract(payload, '$.output.harga_estimasi') as double), 0) as harga_estimasi,
  coalesce(cast(json_extract(payload, '$.output.latency_ms') as double), 0) as latency_ms,
  coalesce(json_extract_string(payload, '$.output.model_digunakan'), 'unknown') as model_digunakan,
  coalesce(cast(json_extract(payload, '$.output.kelas_id') as int), -1) as kelas_id,
  coalesce(json_extract_string(payload, '$.output.kelas_label'), 'unknown') as kelas_label,
  coalesce(cast(json_extract(payload, '$.output.cluster_id') as int), -1) as cluster_id,
  coalesce(json_extract_string(payload, '$.output.cluster_label'), 'unknown') as cluster_label
from prediction_events""",
    # M5 over the scored stand-in (threshold 1.2e9, stored side errors)
    "blend": f"""
select *, case when harga_low < {_LO!r} then harga_low when harga_low > {_HI!r} then harga_high
               else harga_low * (1 - r) + harga_high * r end as harga_final,
  case when harga_low < {_LO!r} then 'model_low' when harga_low > {_HI!r} then 'model_high' else 'blended' end
    as model_digunakan,
  case when harga_low < {_LO!r} then {K.STORED_MAPE_LOW!r} when harga_low > {_HI!r} then {K.STORED_MAPE_HIGH!r}
       else {K.STORED_MAPE_LOW!r} * (1 - r) + {K.STORED_MAPE_HIGH!r} * r end as mape_persen
from (select *, least(greatest((harga_low - {_LO!r}) / {_W!r}, 0.0), 1.0) as r from scored)""",
}

_CTE_DEPS = {
    "typed": ["@listings_raw"], "complete": ["typed"], "fences": ["complete"],
    "cls_clean": ["complete", "fences"], "cls": ["cls_clean"], "fb_valid": ["@feedback"],
    "sane": ["complete"], "reg3": ["sane"], "reg4": ["reg3"], "reg": ["reg4"],
    "clu1": ["complete"], "clu2": ["clu1"], "clu3": ["clu2"], "clu4": ["clu3"], "clu5": ["clu4"], "clu": ["clu5"],
    "clu_fixed": ["clu"], "ev": ["@prediction_events"], "blend": ["@scored"],
}


def sql(body: str, *ctes: str, fixtures: tuple[str, ...] = (), recursive: bool = False) -> str:
    """Assemble ``with <fixtures>, <ctes in dependency order> <body>``."""
    order: list[str] = []
    fx_names: list[str] = list(fixtures)

    def add(n: str) -> None:
        if n.startswith("@"):
            if n[1:] not in fx_names:
                fx_names.append(n[1:])
            return
        for d in _CTE_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in ctes:
        add(n)
    text = with_fixtures(body, *fx_names, extra=[(n, CTE[n]) for n in order])
    return text.replace("with ", "with recursive ", 1) if recursive else text
