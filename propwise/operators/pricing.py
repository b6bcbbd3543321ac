"""Price-model math that is plain column arithmetic.

Splits are deterministic by hashes of the row key (no global sort, no
sampling RNG); routing and blending are ``when`` expressions over the two
prediction columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as K
from ..session import bounded_broadcast


def hash_bucket(key: Column | str, buckets: int = 100) -> Column:
    """md5 of the key's text, first 8 hex digits as an integer, mod buckets."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def train_test_split(df: DataFrame, key: str, train_pct: int = 80) -> DataFrame:
    """M1: ``is_train`` for ~train_pct % of keys; the same key always lands on the same side."""
    return df.withColumn("is_train", hash_bucket(key) < train_pct)


def stratified_split(df: DataFrame, key: str, label: str, train_pct: int = 80) -> DataFrame:
    """M2: of each class exactly ``round(train_pct % of its rows)`` rows train, in order of the hash of class and
    key (then the key).

    A histogram of the hashes' upper halves says in which of 65,536 bins a class's last training row lies;
    only the rows of that bin are ranked, so no window sees a whole class.  Rows with a null class
    are a class of their own; ``key`` is unique in its class.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(label).cast("string"), F.col(key))), 1, 8), 16, 10).cast("bigint")
    rows = df.withColumns({"_h": h, "_bin": F.shiftright(h, 16), "_class": F.coalesce(F.col(label).cast("string"), F.lit("\0"))})
    hist = rows.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("n"))
    by_bin = Window.partitionBy("_class").orderBy("_bin")  # at most 65,536 rows a class
    upto = hist.select("_class", "_bin", "n", F.sum("n").over(by_bin).alias("upto"),
                       F.sum("n").over(Window.partitionBy("_class")).alias("all"))
    want = F.floor(F.col("all") * train_pct / 100 + 0.5)
    cuts = (upto.where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want))
            .select("_class", F.col("_bin").alias("_cut"), (want - F.col("upto") + F.col("n")).alias("_rest")))
    rows = rows.join(bounded_broadcast(cuts), "_class", "left")  # one row a class; none where nothing trains
    at_cut = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_h", key))
    sure = rows.where(~at_cut).withColumn("is_train", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False)))
    last = rows.where(at_cut).withColumn("is_train", rank <= F.col("_rest"))
    return sure.unionByName(last).select(*df.columns, "is_train")


def extreme_weights(df: DataFrame, threshold: float, price: str = "harga", side: str = "side") -> DataFrame:
    """M3: weight 2 on the low side below t/2 and on the high side above 2t."""
    p, s = F.col(price), F.col(side)
    w = F.when(((s == "low") & (p < threshold / 2)) | ((s == "high") & (p > threshold * 2)), 2.0).otherwise(1.0)
    return df.withColumn("weight", w)


def price_side(price: Column | str, threshold: float) -> Column:
    p = F.col(price) if isinstance(price, str) else price
    return F.when(p <= threshold, F.lit("low")).otherwise(F.lit("high"))


def route_and_blend(df: DataFrame, threshold: float, mape_low: float, mape_high: float,
                    low: str = "harga_low", high: str = "harga_high", margin: float = K.BLEND_MARGIN) -> DataFrame:
    """M5: low model below t(1-m), high model above t(1+m), linear mix in between;
    the reported error is mixed the same way."""
    lo, hi = F.col(low), F.col(high)
    m = threshold * margin
    ratio = F.least(F.greatest((lo - (threshold - m)) / (2 * m), F.lit(0.0)), F.lit(1.0))
    final = (F.when(lo < threshold - m, lo).when(lo > threshold + m, hi)
             .otherwise(lo * (1 - ratio) + hi * ratio))
    used = (F.when(lo < threshold - m, F.lit("model_low")).when(lo > threshold + m, F.lit("model_high"))
            .otherwise(F.lit("blended")))
    mape = (F.when(lo < threshold - m, F.lit(mape_low)).when(lo > threshold + m, F.lit(mape_high))
            .otherwise(F.lit(mape_low) * (1 - ratio) + F.lit(mape_high) * ratio))
    return df.withColumns({
        "harga_final": final,
        "model_digunakan": used,
        "mape_persen": mape,
        "batas_segmen_idr": F.lit(float(threshold)),
    }).withColumns({
        "harga_estimasi": F.bround("harga_final", 0).cast("bigint"),
        "harga_estimasi_format": X.format_rupiah("harga_final"),
    })
