"""Aggregations and rankings over the cleaned tables.

Pattern everywhere: aggregate first (map-side partial aggregation), then join
the small per-area/per-cluster results.  Full rows are never shuffled by area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as K


def area_deviation(feedback: DataFrame) -> DataFrame:
    """A3: mean deviation per area."""
    return feedback.groupBy("lokasi").agg(F.avg("selisih_persen").alias("avg_selisih"))


def area_stats(clean: DataFrame) -> DataFrame:
    """Per-area count, mean price per land m2 and dominant segment (lowest id on ties)."""
    return clean.groupBy("lokasi").agg(
        F.count(F.lit(1)).alias("total_data"),
        F.avg(F.try_divide(F.col("harga"), F.col("luas_tanah"))).alias("avg_per_m2"),
        F.mode("kelas_harga", True).alias("segmen_dom_id"),
    )


def area_analytics(clean: DataFrame, feedback: DataFrame, top_n: int = 10) -> DataFrame:
    """A1 (flagship) + J1 + W2: top areas by listing count with trend and segment text.

    Two partial/final hash aggregates, a left join of two small aggregates
    (AQE broadcasts the smaller at runtime), then TakeOrderedAndProject.
    """
    stats = area_stats(clean)
    dev = area_deviation(feedback)
    joined = stats.join(dev, "lokasi", "left").withColumn(
        "trend_selisih", F.coalesce(F.col("avg_selisih"), F.lit(0.0)))
    top = joined.orderBy(F.col("total_data").desc(), F.col("lokasi").asc()).limit(top_n)
    return top.select(
        F.col("lokasi").alias("nama"),
        F.round("avg_per_m2", 2).alias("avg_per_m2"),
        F.col("total_data"),
        X.trend_text("trend_selisih").alias("trend"),
        X.segment_name("segmen_dom_id").alias("segmen_dom"),
        F.lit(K.AREA_NOTE).alias("catatan"),
    )


def area_price_stats(docs: DataFrame, lokasi: str | None = None) -> DataFrame:
    """Per area avg (rounded half-up to an integer, exact), min, max, count,
    dominant segment label.  One aggregate for all areas; ``lokasi`` filters one."""
    src = docs if lokasi is None else docs.filter(F.col("lokasi") == lokasi)
    h = F.col("harga").cast("bigint")
    # exact half-up rounding of the mean: div(2*sum + n, 2*n) on a decimal sum
    n = F.count(F.lit(1))
    return src.groupBy("lokasi").agg(
        F.expr("div(2 * sum(cast(cast(harga as bigint) as decimal(38,0))) + count(1), 2 * count(1))")
        .alias("avg_harga"),
        F.min(h).alias("min_harga"),
        F.max(h).alias("max_harga"),
        n.alias("jumlah_data"),
        F.mode("segment_label", True).alias("dominant_segment"),
    )


def market_overview(areas: DataFrame) -> DataFrame:
    """A4: over the (top-N, bounded) area rows: mean of area averages, total count,
    and each area's bar share = avg / max * 100."""
    w = Window.partitionBy(F.lit(0))  # bounded: area analytics returns at most top_n rows
    return areas.select(
        "nama", "avg_per_m2", "total_data",
        F.round(F.col("avg_per_m2") / F.max("avg_per_m2").over(w) * 100, 2).alias("bar_pct"),
        F.round(F.avg("avg_per_m2").over(w), 2).alias("market_avg_per_m2"),
        F.sum("total_data").over(w).alias("market_total"),
    )


def cluster_summary(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """A5: per cluster count, min/max/median price, median land and building size.

    Clusters are few and one may hold most rows: medians come from
    ``group_quantiles`` (percentile buffers, or refinement for a hot cluster)."""
    from ..session import stored_row_bound
    from .quantiles import MAX_DISTINCT_FOR_PERCENTILE, group_quantiles
    basic = [F.count(F.lit(1)).alias("jumlah_data"), F.min("harga").alias("harga_min"), F.max("harga").alias("harga_max")]
    three = ("harga", "luas_tanah", "luas_bangunan")
    bound = stored_row_bound(df)
    if bound is not None and bound <= MAX_DISTINCT_FOR_PERCENTILE:  # all medians in the one aggregate
        return df.groupBy(cluster_col).agg(*basic, *[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"{c}_median")
                                                     for c in three])
    out = df.groupBy(cluster_col).agg(*basic)
    for c, name in (("harga", "harga_median"), ("luas_tanah", "luas_tanah_median"),
                    ("luas_bangunan", "luas_bangunan_median")):
        med = group_quantiles(df, cluster_col, F.col(c), [0.5]).select(cluster_col, F.col("q")[0].alias(name))
        out = out.join(med, cluster_col, "left")
    return out


def dominant_areas(df: DataFrame, n: int = 3, cluster_col: str = "cluster_id") -> DataFrame:
    """The n most frequent areas per cluster (ties by name), as rank rows."""
    counts = df.groupBy(cluster_col, "lokasi").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(cluster_col).orderBy(F.col("n_rows").desc(), F.col("lokasi").asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def price_correlation(df: DataFrame, cols=("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan")) -> DataFrame:
    """Pearson correlation of price with each numeric column (one aggregate row)."""
    return df.agg(*[F.round(F.corr(F.col("harga").cast("double"), F.col(c).cast("double")), 6).alias(f"corr_{c}")
                    for c in cols])


def segment_threshold(df: DataFrame) -> DataFrame:
    """Median price of the cleaned rows (no task merges all distinct prices)."""
    from .quantiles import quantiles
    q = quantiles(df, F.col("harga"), [0.5])
    return df.sparkSession.createDataFrame([(q[0] if q else None,)], "batas_segmen double")


def unprocessed_count(feedback: DataFrame, threshold: int = K.RETRAIN_THRESHOLD) -> DataFrame:
    """Unprocessed corrections vs the retrain threshold."""
    n = F.count_if(~F.col("processed"))
    return feedback.agg(n.alias("unprocessed"), (n >= threshold).alias("should_retrain"))


def history_summary(history: DataFrame, key: str = "tool") -> DataFrame:
    """A10: per key count, max price and its area (ties: larger name), rounded mean."""
    top = F.max(F.struct(F.col("harga_estimasi"), F.col("lokasi")))
    return history.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.max("harga_estimasi").alias("max_harga"),
        top["lokasi"].alias("max_harga_lokasi"),
        F.round(F.avg("harga_estimasi"), 0).cast("bigint").alias("avg_harga"),
    )


def rank_clusters(df: DataFrame, cluster_col: str = "cluster_id", price: str = "harga") -> DataFrame:
    """Map raw cluster ids to 0..k-1 by ascending median price (k rows; the
    window over k rows is bounded by the model's k)."""
    from .quantiles import group_quantiles
    med = group_quantiles(df, cluster_col, F.col(price), [0.5]).select(cluster_col, F.col("q")[0].alias("median_price"))
    w = Window.partitionBy(F.lit(0)).orderBy("median_price", cluster_col)
    return med.withColumn("rank_id", (F.row_number().over(w) - 1).cast("int")).withColumn(
        "cluster_label", X.cluster_name("rank_id", on_write=True))


def last_n_per_key(df: DataFrame, key: str, ts: str, n: int = 50, tiebreak: str | None = None) -> DataFrame:
    """Newest n entries per key, newest first (window group limit is planned)."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
