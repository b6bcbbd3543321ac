"""Area encoders and scaling.

Encoders are aggregates with one row per area, applied by a checked broadcast
join; unknown areas fall back to a global value.  No row ever moves to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import bounded_broadcast, first_row


def fit_target_encoder(df: DataFrame, key: str = "lokasi", target: str = "harga",
                       smoothing: float = K.TARGET_SMOOTHING, min_samples_leaf: int = K.TARGET_MIN_SAMPLES_LEAF,
                       log: bool = False) -> DataFrame:
    """Smoothed area mean.  lambda = 1/(1+exp(-(n-min_leaf)/smoothing));
    enc = lambda*mean + (1-lambda)*prior; areas seen once take the prior.

    Returns (key, n, mean, prior, enc): one row per area; ``prior`` (the global
    mean, one aggregate row) is what unknown areas receive.
    """
    y = F.log1p(F.col(target)) if log else F.col(target)
    base = df.select(F.col(key).alias(key), y.alias("_y"))
    prior = first_row(base.agg(F.avg("_y").alias("prior"))).get("prior")
    per_area = base.groupBy(key).agg(F.count("_y").alias("n"), F.avg("_y").alias("mean"))
    lam = 1.0 / (1.0 + F.exp(-(F.col("n") - min_samples_leaf) / F.lit(smoothing)))
    p = F.lit(prior).cast("double")
    enc = F.when(F.col("n") == 1, p).otherwise(p * (1 - lam) + F.col("mean") * lam)
    return per_area.filter(F.col(key).isNotNull()).withColumns({"prior": p, "enc": enc})


def apply_encoder(df: DataFrame, enc: DataFrame, key: str = "lokasi", out: str = "lokasi_target",
                  fallback: float | None = None) -> DataFrame:
    """Broadcast left join of a per-area encoder; unknown areas get ``fallback``
    (default: the encoder's prior / global value)."""
    if fallback is None:
        r = first_row(enc.select("prior")) if "prior" in enc.columns else {}
        fallback = r.get("prior")
    small = bounded_broadcast(enc.select(F.col(key), F.col("enc").alias(out)))
    return df.join(small, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(fallback)))


def fit_median_encoder(df: DataFrame, key: str = "lokasi", col: str = "log_harga", out: str = "lokasi_enc") -> DataFrame:
    """Area median of ``col`` (exact; a hot area is refined, see ``quantiles.group_quantiles``)."""
    from .quantiles import group_quantiles
    return group_quantiles(df, key, F.col(col), [0.5]).select(key, F.col("q")[0].alias(out))


def median_fallback(enc: DataFrame, col: str = "lokasi_enc") -> float | None:
    """J3 fallback: median of the area medians."""
    return first_row(enc.agg(F.median(col).alias("m"))).get("m")


def encoder_lookup(df: DataFrame, enc: DataFrame, key: str = "lokasi", col: str = "lokasi_enc") -> DataFrame:
    """Broadcast lookup by area, unknown -> median of area medians."""
    fb = median_fallback(enc, col)
    return df.join(bounded_broadcast(enc.select(key, col)), key, "left").withColumn(
        col, F.coalesce(F.col(col), F.lit(fb)))


def fit_standardizer(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of each column (one aggregate row)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    r = first_row(df.agg(*aggs))
    return {c: (r[f"{c}__m"], r[f"{c}__s"]) for c in cols}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    """Z-score; zero std -> 0."""
    return df.withColumns({
        f"{c}{suffix}": ((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0)
        for c, (m, s) in stats.items()
    })
