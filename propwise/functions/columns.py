"""Column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions`` only,
so it stays inside whole-stage codegen.  None of them is a Python UDF.
Canonical column names: harga, kamar_tidur, kamar_mandi, garasi, luas_tanah,
luas_bangunan, lokasi.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

NUMBER_RUN = r"[0-9.]+"


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill a ``{name}`` text template with columns (one ``concat``, no UDF)."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if i % 2 == 1 or p]
    return F.concat(*cols)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- F1-F5: parsing and null rules -------------------------------------------------

def parse_price(c: Column | str) -> Column:
    """',' -> '.', first number run, x1e9 for 'miliar', x1e6 for 'juta'."""
    text = F.regexp_replace(_c(c), ",", ".")
    num = F.regexp_extract(text, NUMBER_RUN, 0).try_cast("double")
    low = F.lower(text)
    return (F.when(low.contains("miliar"), num * 1_000_000_000)
            .when(low.contains("juta"), num * 1_000_000)
            .otherwise(num))


def parse_area(c: Column | str) -> Column:
    """first number run as double; no digits -> null."""
    return F.regexp_extract(_c(c), NUMBER_RUN, 0).try_cast("double")


def coerce_numeric(c: Column | str) -> Column:
    """unparsable text -> null (ANSI-safe)."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def fill_garage(c: Column | str) -> Column:
    """missing garage -> 0."""
    return F.coalesce(_c(c), F.lit(0))


def nullify_inf(c: Column | str) -> Column:
    """+-inf and NaN -> null."""
    x = _c(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


# ---- F6-F8: labels -------------------------------------------------------------------

def price_segment(c: Column | str) -> Column:
    """right-closed segment id 0..3."""
    x = _c(c)
    b0, b1, b2 = K.SEGMENT_BOUNDS
    return (F.when(x <= b0, 0).when(x <= b1, 1).when(x <= b2, 2).otherwise(3)).cast("int")


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def segment_name(c: Column | str) -> Column:
    """short segment name, default Menengah."""
    return F.coalesce(_lookup(K.SEGMENT_NAMES, _c(c)), F.lit(K.SEGMENT_DEFAULT))


def segment_label(c: Column | str) -> Column:
    """F7 (long form): metadata label of a segment id."""
    return _lookup(K.SEGMENT_LABELS, _c(c))


def cluster_name(c: Column | str, on_write: bool = False) -> Column:
    """F8: cluster label; default ``Cluster-<id>`` on read, ``Tier-<id+1>`` on write."""
    x = _c(c)
    fallback = (F.concat(F.lit("Tier-"), (x + 1).cast("string")) if on_write
                else F.concat(F.lit("Cluster-"), x.cast("string")))
    return F.coalesce(_lookup(K.CLUSTER_LABELS, x), fallback)


# ---- F9-F14: feature sets ------------------------------------------------------------

def regression_features(enc: Column | str = "lokasi_target") -> dict[str, Column]:
    """15 engineered columns (training form), keyed by output name, in contract order."""
    kt, km, g = F.col("kamar_tidur"), F.col("kamar_mandi"), F.col("garasi")
    lt, lb, e = F.col("luas_tanah"), F.col("luas_bangunan"), _c(enc)
    total = kt + km
    luxury = kt * km * (g + 1)
    log_lok = F.log1p(e)
    return {
        "total_kamar": total,
        "kamar_ratio": kt / (km + 1),
        "garasi_kamar": g * total,
        "luxury_score": luxury,
        "rasio_bang_tanah": lb / (lt + 1),
        "luas_per_kamar": lb / (total + 1),
        "luas_total": lt + lb,
        "log_luas_tanah": F.log1p(lt),
        "log_luas_bangunan": F.log1p(lb),
        "log_lokasi": log_lok,
        "lokasi_x_kamar": e * total,
        "lokasi_x_garasi": e * g,
        "lokasi_x_luxury": log_lok * luxury,
        "lokasi_x_luas_bang": log_lok * F.log1p(lb),
        "lokasi_per_kamar": e / (total + 1),
    }


REGRESSION_FEATURES = [
    "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi_target",
    "total_kamar", "kamar_ratio", "garasi_kamar", "luxury_score", "rasio_bang_tanah",
    "luas_per_kamar", "luas_total", "log_luas_tanah", "log_luas_bangunan", "log_lokasi",
    "lokasi_x_kamar", "lokasi_x_garasi", "lokasi_x_luxury", "lokasi_x_luas_bang", "lokasi_per_kamar",
]


def classification_features(given: dict[str, Column] | None = None) -> dict[str, Column]:
    """ratios from raw values first, then log1p of both areas (order matters).

    ``given`` replaces inputs by name (the variants of a scenario).
    """
    kt, km, g, lt, lb, h = ((given or {}).get(c, F.col(c)) for c in (
        "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "harga"))
    total = kt + km
    return {
        "rasio_bangunan_tanah": lb / (lt + 1),
        "total_kamar": total,
        "harga_per_m2_tanah": h / (lt + 1),
        "harga_per_m2_bangunan": h / (lb + 1),
        "luas_total": lt + lb,
        "kamar_per_luas": total / (lb + 1),
        "garasi_flag": (g > 0).cast("int"),
        # applied last: replaces the raw areas
        "log_luas_tanah": F.log1p(lt),
        "log_luas_bangunan": F.log1p(lb),
    }


def area_indicator_name(area: str) -> str:
    """The area's own spelling: names that differ only in marks stay apart."""
    return "lokasi_" + area


def one_hot_area(areas: list[str], col: str = "lokasi") -> dict[str, Column]:
    """F11 for a given short list: one 0/1 column per area; unknown area -> all zeros.

    Models use the sparse encoder of ``operators.models.fit_segment_encoder``.
    """
    return {area_indicator_name(a): (F.col(col) == F.lit(a)).cast("int") for a in areas}


def clustering_features() -> dict[str, Column]:
    """log1p of price, areas and price per building m2; LB/LT; zero denominators -> null."""
    h, lt, lb = F.col("harga"), F.col("luas_tanah"), F.col("luas_bangunan")
    per_m2 = F.try_divide(h, F.nullif(lb, F.lit(0.0)))
    return {
        "log_harga": F.log1p(h),
        "log_lt": F.log1p(lt),
        "log_lb": F.log1p(lb),
        "harga_per_m2": per_m2,
        "log_harga_m2": F.log1p(per_m2),
        "rasio_lb_lt": F.try_divide(lb, F.nullif(lt, F.lit(0.0))),
    }


CLUSTERING_FEATURES = ["log_harga", "log_lt", "log_lb", "log_harga_m2", "rasio_lb_lt",
                       "kamar_tidur", "kamar_mandi", "lokasi_enc"]


# ---- F15-F27: derived values and text -------------------------------------------------

def deviation_pct(actual: Column | str = "harga_asli", predicted: Column | str = "harga_prediksi") -> Column:
    """|actual - predicted| / predicted * 100, rounded half-even to 2 decimals."""
    a, p = _c(actual), _c(predicted)
    return F.bround(F.try_divide(F.abs(a - p), p) * 100, 2)


def format_rupiah(c: Column | str) -> Column:
    """F16: 'Rp x.xx Miliar' / 'Rp x.x Juta' / 'Rp 1,234,567'.

    Built from integers (round half-even of the scaled value) so the text does not
    depend on an engine's float formatting.
    """
    x = _c(c)
    bil = F.bround(x / 1e7, 0).cast("bigint")   # hundredths of a miliar
    mil = F.bround(x / 1e5, 0).cast("bigint")   # tenths of a juta
    return (
        F.when(x >= 1e9, render(K.PRICE_TEXT_MILIAR, {
            "whole": (bil / 100).cast("bigint").cast("string"),
            "hundredths": F.lpad((bil % 100).cast("string"), 2, "0")}))
        .when(x >= 1e6, render(K.PRICE_TEXT_JUTA, {
            "whole": (mil / 10).cast("bigint").cast("string"), "tenth": (mil % 10).cast("string")}))
        .otherwise(render(K.PRICE_TEXT_PLAIN, {"grouped": F.format_number(x.cast("bigint"), 0)}))
    )


def trend_text(c: Column | str) -> Column:
    """'±x.x%' if > 0 else 'N/A' (tenths built from an integer)."""
    x = _c(c)
    tenths = F.bround(x * 10, 0).cast("bigint")
    return F.when(x > 0, render(K.TREND_TEXT, {"whole": (tenths / 10).cast("bigint").cast("string"),
                                               "tenth": (tenths % 10).cast("string")})).otherwise(F.lit("N/A"))


def render_listing_text() -> Column:
    """one descriptive sentence per listing (indexing form)."""
    return render(K.LISTING_TEXT, {
        "lokasi": F.col("lokasi"),
        "kamar_tidur": F.col("kamar_tidur").cast("int").cast("string"),
        "kamar_mandi": F.col("kamar_mandi").cast("int").cast("string"),
        "garasi": F.col("garasi").cast("int").cast("string"),
        "luas_tanah": F.col("luas_tanah").cast("double").cast("string"),
        "luas_bangunan": F.col("luas_bangunan").cast("double").cast("string"),
        "harga": F.format_number(F.col("harga").cast("double"), 0),
        "segment": F.coalesce(F.col("cluster_label"), F.lit("Unknown")),
    })


def render_query_text() -> Column:
    """F18 (query variant, English)."""
    return render(K.QUERY_TEXT, {
        "lokasi": F.col("lokasi"),
        "kamar_tidur": F.col("kamar_tidur").cast("string"),
        "kamar_mandi": F.col("kamar_mandi").cast("string"),
        "luas_tanah": F.col("luas_tanah").cast("string"),
        "luas_bangunan": F.col("luas_bangunan").cast("string"),
        "harga": F.format_number(F.col("harga").cast("bigint"), 0),
    })


def default_cluster_fields(label: str = "cluster_label", cid: str = "cluster_id") -> dict[str, Column]:
    """null label -> Unknown, null id -> -1."""
    return {label: F.coalesce(F.col(label), F.lit("Unknown")),
            cid: F.coalesce(F.col(cid).cast("int"), F.lit(-1))}


def context_key(query: Column | str, prediction_json: Column | str) -> Column:
    """md5(query || ':' || md5(prediction json))."""
    return F.concat(F.lit("rag:"), F.md5(F.concat(_c(query), F.lit(":"), F.md5(_c(prediction_json)))))


def sorted_json(fields: dict[str, Column]) -> Column:
    """Text of a flat JSON object: keys sorted, ``", "`` and ``": "`` between parts, null as ``null``."""
    parts: list[Column] = []
    for i, k in enumerate(sorted(fields)):
        boxed = F.to_json(F.array(fields[k]))  # [value], with JSON's own quoting
        parts += [F.lit((", " if i else "") + f'"{k}": '), F.substring(boxed, F.lit(2), F.length(boxed) - 2)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def is_market_query(c: Column | str) -> Column:
    """lower-cased text contains any keyword."""
    # one pattern: the text, often a rendered column, is evaluated once
    return F.lower(_c(c)).rlike("|".join(re.escape(kw) for kw in K.MARKET_KEYWORDS))


def top_class(prob_map: Column | str) -> Column:
    """key of the highest-probability entry (ties -> smallest key)."""
    entries = F.map_entries(_c(prob_map))
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    top = F.filter(entries, lambda e: e["value"] == best)
    return F.array_min(F.transform(top, lambda e: e["key"]))


def title_from_source(c: Column | str) -> Column:
    """file stem, '_' -> ' ', title case."""
    stem = F.regexp_extract(_c(c), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.initcap(F.regexp_replace(stem, "_", " "))


def preview(c: Column | str, n: int = K.PREVIEW_CHARS) -> Column:
    """first n characters."""
    return F.substring(_c(c), 1, n)


def estimate_from_log(c: Column | str) -> Column:
    """expm1 of a log1p-scale model output."""
    return F.expm1(_c(c))


def clip_nonnegative(c: Column | str) -> Column:
    """negative predictions clipped to 0 before metrics."""
    return F.greatest(_c(c), F.lit(0.0))
