"""MLlib training and scoring.

Price and cluster models are distributed MLlib estimators, the rest column expressions:

* price: two ``GBTRegressor`` (one per price side) on log1p(price) with sample
  weights; the round is chosen by validation rows with patience, the error measured on others;
* segment: boosted trees (``boosting``) for each class against the others, on ratio + one-hot area features;
* clusters: population z-scores -> a landmark map to 10 dimensions, fitted on a bounded sample and
  applied to every row -> ``KMeans``; restarts are separate fits on the persisted table and the
  lowest training cost wins.

Scoring is ``transform`` plus column arithmetic; the nested "price missing ->
estimate it" call is a ``coalesce`` column, not a second request.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as K
from ..session import at_once, bounded_broadcast, dealt, first_row, materialize, spread
from . import boosting as BO
from . import encoding as E
from . import metrics as MT
from . import pricing as P
from .quantiles import quantiles


# ---- boosting with the best round (M4) ----------------------------------------------------

#: Part of the training rows that chooses the round; the reported error is of rows that neither saw.
VALIDATION_SHARE = 10


def validation_rows(key: str) -> F.Column:
    """A tenth of the rows, by a hash of the key that the train/test split does not use."""
    return F.pmod(F.xxhash64(F.lit("validation"), F.col(key)), F.lit(VALIDATION_SHARE)) == 0


def first_trees(model, n: int):
    """A boosted model of the first ``n`` trees of ``model``."""
    from pyspark import SparkContext

    sc, j = SparkContext._active_spark_context, model._java_obj
    trees, weights = j.trees(), j.treeWeights()
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    ws = sc._gateway.new_array(sc._gateway.jvm.double, n)
    for k in range(n):
        kept[k], ws[k] = trees[k], weights[k]
    jclass = (sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel if isinstance(model, GBTRegressionModel)
              else sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel)
    cut = type(model)(jclass(j.uid(), kept, ws, j.numFeatures()))
    cut._resetUid(j.uid())
    model._copyValues(cut)
    cut._transfer_params_to_java()
    return cut


def fit_boosted(estimator, train: DataFrame, valid: DataFrame, max_iter: int, patience: int, losses: list | None = None):
    """Boost until ``patience`` rounds bring no lower loss on ``valid``, at most ``max_iter``; the best round stays.

    Rounds are looked at in steps that double, and a fit runs to the step after the one looked at: its first
    trees are those of a shorter fit, so no step but the last of a fit costs one of its own.  ``losses`` gets
    the validation loss of each round looked at.
    """
    rounds, seen = min(max_iter, max(patience, 16)), []
    while True:
        if rounds > len(seen):
            model = estimator.copy({estimator.maxIter: min(max_iter, 2 * rounds)}).fit(train)
            seen = list(model.evaluateEachIteration(valid, "squared") if isinstance(model, GBTRegressionModel)
                        else model.evaluateEachIteration(valid))
        best = min(range(rounds), key=seen.__getitem__) + 1
        if rounds >= max_iter or best + patience <= rounds:
            if losses is not None:
                losses[:] = seen[:rounds]
            return first_trees(model, best) if best < len(seen) else model
        rounds = min(max_iter, 2 * rounds)


# ---- price models (M4, M6) -------------------------------------------------------------

@dataclass
class PriceModels:
    low: object
    high: object
    encoder: DataFrame
    prior: float
    threshold: float
    mape_low: float
    mape_high: float
    features: list[str] = field(default_factory=lambda: list(X.REGRESSION_FEATURES))


def regression_frame(df: DataFrame, encoder: DataFrame, prior: float) -> DataFrame:
    """E1 lookup (unknown -> prior) + F9 features + assembled vector."""
    enc = E.apply_encoder(df, encoder, "lokasi", "lokasi_target", fallback=prior)
    feats = enc.withColumns(X.regression_features("lokasi_target"))
    casted = feats.withColumns({c: F.col(c).cast("double") for c in X.REGRESSION_FEATURES})
    return VectorAssembler(inputCols=X.REGRESSION_FEATURES, outputCol="features", handleInvalid="keep").transform(casted)


def train_price_models(clean: DataFrame, key: str = "listing_id", threshold: float | None = None,
                       max_iter: int = 5000, max_depth: int = 6, step_size: float = 0.02, patience: int = 200,
                       seed: int = 42) -> tuple[PriceModels, DataFrame]:
    """M4: threshold = median price (A8) unless given; one GBT per side on log1p(price).

    At most ``max_iter`` rounds: boosting stops when validation rows, a tenth of the training part,
    have not gained for ``patience`` rounds, and the best round is kept.  The errors are those of the
    holdout, which no round saw.

    Returns the models and the holdout predictions (for A11 metrics).
    """
    if threshold is None:
        threshold = float(quantiles(clean, F.col("harga"), [0.5])[0])
    df = P.train_test_split(clean, key).withColumn("side", P.price_side("harga", threshold))
    df = P.extreme_weights(df, threshold)
    train = df.filter("is_train")
    encoder = E.fit_target_encoder(train)
    prior = float(first_row(encoder.select("prior"))["prior"])
    frame = dealt(regression_frame(df, encoder, prior), [key, "side", "harga", "weight", "label", "is_train", "is_val", "features"],
                  lambda rows: rows.withColumns({"label": F.log1p("harga"), "is_val": F.col("is_train") & validation_rows(key)})).persist()

    def fit(side: str):
        gbt = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=max_depth,
                           stepSize=step_size, seed=seed)
        rows = frame.filter((F.col("side") == side) & F.col("is_train"))
        return fit_boosted(gbt, rows.filter("not is_val"), rows.filter("is_val"), max_iter, patience)

    sides = ("low", "high")
    models = dict(zip(sides, at_once(frame.sparkSession, [partial(fit, side) for side in sides])))
    holdout = frame.filter("not is_train")
    # score each side with its own model (rows routed by actual price)
    lo = models["low"].setPredictionCol("_pl").transform(holdout.filter(F.col("side") == "low"))
    hi = models["high"].setPredictionCol("_ph").transform(holdout.filter(F.col("side") == "high"))
    pred = (lo.select(key, "side", F.col("harga").alias("y"), X.estimate_from_log("_pl").alias("p"))
            .unionByName(hi.select(key, "side", F.col("harga").alias("y"), X.estimate_from_log("_ph").alias("p"))))
    pred = materialize(pred, "price-holdout")  # read again when the frame is gone
    m = MT.regression_metrics(pred, "y", "p", "side")
    mrow = {r["side"]: r["mape"] for r in m.collect()}  # three rows
    frame.unpersist()
    return PriceModels(models["low"], models["high"], encoder, prior, threshold,
                       mrow.get("low") or 0.0, mrow.get("high") or 0.0), pred


def score_prices(df: DataFrame, pm: PriceModels) -> DataFrame:
    """M6: features -> both models -> M5 routing/blend -> estimate, text, model used, error."""
    frame = regression_frame(df, pm.encoder, pm.prior)
    lo = pm.low.setPredictionCol("_log_low").transform(frame)
    both = pm.high.setPredictionCol("_log_high").transform(lo)
    both = both.withColumns({"harga_low": X.estimate_from_log("_log_low"),
                             "harga_high": X.estimate_from_log("_log_high")})
    out = P.route_and_blend(both, pm.threshold, pm.mape_low, pm.mape_high)
    return out.drop("features", "_log_low", "_log_high", *X.regression_features().keys(), "lokasi_target")


# ---- segment model (M7, M8) ------------------------------------------------------------

@dataclass
class SegmentModel:
    models: list  # one boosted classifier for each segment, against the others
    encoder: object  # fitted area indexer + sparse one-hot + assembler
    features: list[str]
    borders: BO.Borders  # bins of the numbers


SEGMENT_NUMBERS = ["kamar_tidur", "kamar_mandi", "garasi", "luas_tanah_log", "luas_bangunan_log",
                   "rasio_bangunan_tanah", "total_kamar", "harga_per_m2_tanah", "harga_per_m2_bangunan",
                   "luas_total", "kamar_per_luas", "garasi_flag"]


def segment_numbers(df: DataFrame) -> DataFrame:
    """F10 columns as doubles."""
    feats = X.classification_features()
    base = df.withColumns({k: v for k, v in feats.items() if not k.startswith("log_")})
    base = base.withColumns({"luas_tanah_log": feats["log_luas_tanah"], "luas_bangunan_log": feats["log_luas_bangunan"]})
    return base.withColumns({c: F.col(c).cast("double") for c in SEGMENT_NUMBERS})


def fit_segment_encoder(df: DataFrame):
    """F11 at any number of areas: index + sparse one-hot; an unknown area is all zeros."""
    return Pipeline(stages=[
        StringIndexer(inputCol="lokasi", outputCol="_area", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_area"], outputCols=["_area_vec"], dropLast=True),
        VectorAssembler(inputCols=[*SEGMENT_NUMBERS, "_area_vec"], outputCol="features", handleInvalid="keep"),
    ]).fit(df)


def segment_feature_names(encoder) -> list[str]:
    """F13 contract order: raw counts, logged areas, ratios, then one column per known area."""
    return SEGMENT_NUMBERS + [X.area_indicator_name(a) for a in encoder.stages[0].labels]


def class_probabilities(frame: DataFrame, sm: SegmentModel) -> DataFrame:
    """Appends ``probability array<double>``: each classifier's chance of its class, made to sum to 1."""
    return frame.withColumn("probability", BO.probabilities(frame, sm.models, sm.borders, SEGMENT_NUMBERS, "_area"))


def likeliest(probability: str = "probability") -> F.Column:
    """The class of the highest probability (the first of equal ones)."""
    return (F.array_position(F.col(probability), F.array_max(F.col(probability))) - 1).cast("int")


def train_segment_model(clean_cls: DataFrame, key: str = "listing_id", max_iter: int = 1500, max_depth: int = 8,
                        step_size: float = 0.05, patience: int = 100) -> tuple[SegmentModel, DataFrame]:
    """M7: stratified 80/20 (M2); a boosted classifier for each segment against the others, its round
    chosen by a tenth of the training part; probabilities are normalised.  Returns the holdout (y, p)."""
    df = segment_numbers(P.stratified_split(clean_cls, key, "kelas_harga"))
    encoder = fit_segment_encoder(df)
    rows = encoder.transform(df).select(key, "is_train", F.col("kelas_harga").alias("label"), F.col("_area").cast("int").alias("_area"),
                                        (F.col("is_train") & validation_rows(key)).alias("is_val"), *SEGMENT_NUMBERS)
    rows = materialize(rows, "segment-rows")
    borders = BO.fit_borders(rows.filter("is_train and not is_val"), SEGMENT_NUMBERS, len(encoder.stages[0].labels), key)
    rows = materialize(BO.binned(spread(rows), borders, SEGMENT_NUMBERS, "_area", ["label", "is_train", "is_val"]), "segment-codes")
    train = rows.filter("is_train")
    models = BO.fit_classes(train, train.count(), len(K.SEGMENT_LABELS), borders, max_iter, max_depth, step_size, patience)
    hold = spread(rows.filter(~F.col("is_train")))
    hold = hold.withColumn("probability", BO.probabilities_of_codes(hold, models, borders))
    hold = materialize(hold.select(F.col("label").alias("y"), likeliest().alias("p")), "segment-holdout")
    return SegmentModel(models, encoder, segment_feature_names(encoder), borders), hold


def price_or_estimate(df: DataFrame, pm: PriceModels | None) -> DataFrame:
    """Rows with ``harga`` filled by M6 where it is missing, and ``harga_sumber`` telling which it is."""
    if pm is None:
        return df.withColumn("harga_sumber", F.lit("input"))
    est = score_prices(df, pm).select(*df.columns, F.col("harga_estimasi").cast("double").alias("_est"))
    return est.withColumns({
        "harga_sumber": F.when(F.col("harga").isNull(), F.lit("estimated_by_regression")).otherwise(F.lit("input")),
        "harga": F.coalesce(F.col("harga"), F.col("_est"))}).drop("_est")


def segment_columns(df: DataFrame, sm: SegmentModel) -> DataFrame:
    """Appends ``kelas_id, kelas_label, probabilitas`` (4 decimals) to rows with a price."""
    out = class_probabilities(sm.encoder.transform(segment_numbers(df)), sm)
    labels = [K.SEGMENT_LABELS[i] for i in range(4)]
    probs = F.transform("probability", lambda p: F.bround(p, 4))
    kelas = likeliest()
    return out.select(*df.columns, kelas.alias("kelas_id"), X.segment_label(kelas).alias("kelas_label"),
                      F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.slice(probs, 1, 4)).alias("probabilitas"))


def score_segments(df: DataFrame, sm: SegmentModel, pm: PriceModels | None = None) -> DataFrame:
    """M8: price missing -> M6 estimate; class id, label, probability map (4 decimals), source flag."""
    out = segment_columns(price_or_estimate(df, pm), sm)
    return out.select(*[c for c in df.columns if c != "harga"], "kelas_id", "kelas_label", "probabilitas",
                      F.bround("harga", 0).cast("bigint").alias("harga_digunakan"), "harga_sumber")


# ---- market clusters (M9, M10, W1, J5) ----------------------------------------------

#: Rows that the reduced space is fitted on, at most; every row is mapped into it.
LANDMARKS = 256
REDUCED = 10


@dataclass
class LandmarkMap:
    """A smooth non-linear map of standardized rows to few dimensions (Nystroem).

    ``exp(-gamma * squared distance)`` to each landmark, projected on the first principal directions of the
    landmarks' own similarities.
    """

    landmarks: list[list[float]]
    projection: list[list[float]]
    gamma: float

    def columns(self, z: list[str]) -> F.Column:
        """The mapped row as an array column, Arrow batch by Arrow batch."""
        marks, project, gamma = np.array(self.landmarks), np.array(self.projection), self.gamma

        @F.pandas_udf("array<double>")
        def apply(v: pd.Series) -> pd.Series:
            if not len(v):
                return v
            x = np.stack(v.to_numpy())
            d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ marks.T + (marks ** 2).sum(axis=1)
            return pd.Series(list(np.exp(-gamma * np.maximum(d, 0)) @ project))

        return apply(F.array(*[F.col(c) for c in z]))


def fit_landmarks(z: DataFrame, cols: list[str], key: str, dims: int = REDUCED, landmarks: int = LANDMARKS) -> LandmarkMap:
    """Fit on ``landmarks`` rows at most, those of smallest hash of the key; gamma by their median distance."""
    rows = z.orderBy(F.xxhash64(F.col(key)), key).limit(landmarks).select(*[F.col(c).cast("double") for c in cols]).collect()
    marks = np.array([list(r) for r in rows]).reshape(-1, len(cols))
    d = ((marks[:, None] - marks[None]) ** 2).sum(axis=2)
    spread = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    e, v = np.linalg.eigh(np.exp(-d / spread))
    top = np.argsort(-e)[:dims]
    top = top[e[top] > 1e-9 * max(e.max(initial=0), 1e-300)]
    return LandmarkMap(marks.tolist(), (v[:, top] / np.sqrt(e[top])).tolist(), 1 / spread)


@dataclass
class ClusterModel:
    model: object
    stats: dict
    rank_map: DataFrame  # raw_id -> cluster_id (ranked), cluster_label
    summary: DataFrame
    encoder: DataFrame
    fallback: float
    reducer: LandmarkMap | None = None
    silhouette: float | None = None
    silhouette_plain: float | None = None  # of the same procedure without the reduced space


def _restarted(data: DataFrame, k: int, restarts: int, max_iter: int, seed: int) -> tuple[object, float]:
    """The k-means model of lowest cost over ``restarts`` seeds, and its silhouette (squared Euclidean, no pairs)."""

    def fit(i: int) -> tuple[float, object]:
        # a projection, so that k-means keeps its own vectors: else each pass unpacks the stored columns anew
        m = KMeans(k=k, maxIter=max_iter, seed=seed + i, featuresCol="features", predictionCol="raw_id").fit(data.select("features"))
        return m.summary.trainingCost, m

    best = min(at_once(data.sparkSession, [partial(fit, i) for i in range(restarts)]), key=lambda found: found[0])[1]
    assigned = best.transform(data)
    return best, ClusteringEvaluator(featuresCol="features", predictionCol="raw_id").evaluate(assigned)


def _vectors(z: DataFrame, reducer: LandmarkMap | None) -> DataFrame:
    """Appends ``features``: the standardized columns, or where the reducer maps them."""
    zc = [f"{c}_z" for c in X.CLUSTERING_FEATURES]
    if reducer is None:
        return VectorAssembler(inputCols=zc, outputCol="features").transform(z)
    return z.withColumn("features", array_to_vector(reducer.columns(zc)))


def train_market_clusters(clean_clu: DataFrame, k: int = K.N_CLUSTERS, restarts: int = 50, max_iter: int = 500,
                          seed: int = 42, dims: int | None = REDUCED, key: str = "listing_id") -> ClusterModel:
    """M9: E3 -> reduced space of ``dims`` dimensions (none: the standardized columns themselves) ->
    KMeans(k), best of ``restarts`` seeds by training cost; W1 relabel by median price.

    The plain form is trained beside the reduced one, for its silhouette alone.
    """
    from .analytics import cluster_summary, rank_clusters

    stats = E.fit_standardizer(clean_clu, X.CLUSTERING_FEATURES)
    zc = [f"{c}_z" for c in X.CLUSTERING_FEATURES]
    z = dealt(E.standardize(clean_clu, stats), [key, "harga", "luas_tanah", "luas_bangunan", *zc])
    plain = _vectors(z, None).persist()
    model, silhouette = _restarted(plain, k, restarts, max_iter, seed)
    silhouette_plain, reducer, data = silhouette, None, plain
    if dims:
        z = plain.drop("features")
        reducer = fit_landmarks(z, zc, key, dims)
        data = _vectors(z, reducer).persist()
        model, silhouette = _restarted(data, k, restarts, max_iter, seed)
    assigned = materialize(model.transform(data).select("raw_id", "harga", "luas_tanah", "luas_bangunan"), "cluster-assigned")
    ranks = rank_clusters(assigned, "raw_id").select("raw_id", F.col("rank_id").alias("cluster_id"), "cluster_label")
    ranks = bounded_broadcast(ranks, 1_000)
    labelled = assigned.join(ranks, "raw_id")
    summary = cluster_summary(labelled).join(ranks.select("cluster_id", "cluster_label"), "cluster_id")
    summary = materialize(summary, "cluster-summary")
    enc = E.fit_median_encoder(clean_clu.drop("lokasi_enc"), "lokasi", "log_harga")
    fb = E.median_fallback(enc)
    for d in (plain, data):
        d.unpersist()
    return ClusterModel(model, stats, ranks, summary, enc, fb, reducer, silhouette, silhouette_plain)


def cluster_columns(df: DataFrame, cm: ClusterModel) -> DataFrame:
    """Appends ``cluster_id, cluster_label, imputed_features`` to rows with a price.

    A feature that cannot be computed (zero area, missing number) takes the training mean, and
    its name is listed, so a caller sees which rows were scored on fewer features.
    """
    f = df.withColumns(X.clustering_features())
    f = E.encoder_lookup(f.drop("lokasi_enc") if "lokasi_enc" in f.columns else f, cm.encoder)
    z = E.standardize(f, cm.stats)
    zc = [f"{c}_z" for c in X.CLUSTERING_FEATURES]
    z = z.withColumns({c: X.nullify_inf(F.col(c)) for c in zc})
    z = z.withColumn("imputed_features", F.filter(F.array(*[F.when(F.col(f"{c}_z").isNull(), F.lit(c)) for c in X.CLUSTERING_FEATURES]),
                                                  lambda x: x.isNotNull()))
    z = z.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zc})
    out = cm.model.transform(_vectors(z, cm.reducer)).join(F.broadcast(cm.rank_map), "raw_id", "left")  # one row for each cluster
    return out.select(*df.columns, "cluster_id",
                      F.coalesce(F.col("cluster_label"), X.cluster_name("cluster_id")).alias("cluster_label"),
                      "imputed_features")


def score_clusters(df: DataFrame, cm: ClusterModel, pm: PriceModels | None = None) -> DataFrame:
    """Price missing -> M6; features (F12 + J3) -> KMeans -> W1 map -> label + summary."""
    base = price_or_estimate(df.drop("cluster_id", "cluster_label"), pm)
    out = cluster_columns(base, cm)
    summ = cm.summary.select("cluster_id", F.struct(*[c for c in cm.summary.columns if c != "cluster_id"]).alias("cluster_summary"))
    out = out.join(F.broadcast(summ), "cluster_id", "left")  # one row for each cluster
    keep = [c for c in base.columns if c not in ("harga", "harga_sumber")]
    return out.select(*keep, "cluster_id", "cluster_label", "cluster_summary",
                      F.bround("harga", 0).cast("bigint").alias("harga_digunakan"), "harga_sumber", "imputed_features")


REQUIRED = ["kamar_tidur", "kamar_mandi", "luas_tanah", "luas_bangunan", "lokasi"]


def batch_score(df: DataFrame, pm: PriceModels, sm: SegmentModel, cm: ClusterModel, key: str = "row_index") -> DataFrame:
    """Per row price, error, model, segment, cluster and the original index.

    One pass: each model appends its columns to the same rows.  A row that lacks an input keeps
    its index, null scores and the reason.
    """
    lacks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    rows = df.select(key, *REQUIRED, "garasi", "harga", F.coalesce(*lacks).alias("reason"))
    priced = score_prices(rows, pm).withColumn("harga", F.coalesce("harga", F.col("harga_estimasi").cast("double")))
    out = cluster_columns(segment_columns(priced, sm), cm)
    scores = ["harga_estimasi", "harga_estimasi_format", "model_digunakan", "mape_persen", "kelas_id", "kelas_label",
              "cluster_id", "cluster_label"]
    return out.select(key, *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in scores], "reason")


def feature_importance(model, features: list[str], area_prefix: str = "lokasi") -> DataFrame:
    """Importances sorted desc plus the subtotal of area-derived features."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()  # one value per feature (model metadata)
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    sub = df.filter(F.col("feature").startswith(area_prefix)).agg(F.sum("importance").alias("importance")) \
        .select(F.lit("subtotal_" + area_prefix).alias("feature"), "importance")
    return df.unionByName(sub).orderBy(F.col("importance").desc(), "feature")
