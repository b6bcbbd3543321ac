"""Filters and cleaning pipelines.

Plan shape
----------
Every quantile step is a barrier: its bounds depend on the survivors of the step
before.  Global bounds are one aggregate row (partial ``percentile`` buffers per
task, merged once) fetched as literals, so the next filter is a plain literal
predicate that Catalyst pushes into the parquet scan.  Per-area bounds are an
aggregate with one row per area, joined back through a *checked* broadcast;
full rows are never shuffled by area (areas are few and skewed).

``exact=False`` switches ``percentile`` (exact; its buffer holds the distinct
values) to ``percentile_approx`` with ``accuracy`` for columns with very many
distinct values.  Rows are never sampled or dropped to make a step cheaper.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as K
from ..session import bounded_broadcast, first_row, stored_row_bound

NUMERIC = ["harga", "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan"]

# How exact global quantiles are computed (see ``quantile_bounds``).
QUANTILE_METHOD = "auto"


def _quantiles(c: Column, probs: list[float], exact: bool, accuracy: int) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if exact:
        return F.percentile(c, arr)
    return F.percentile_approx(c, arr, accuracy)


def quantile_bounds(df: DataFrame, cols: list[str] | dict[str, Column], probs: list[float],
                    exact: bool = True, accuracy: int = 100_000, method: str | None = None) -> dict[str, list[float]]:
    """Global quantiles of several columns -> {col: [q...]}.

    ``method``: "percentile" (one exact aggregate job; its buffer holds every distinct
    value), "refine" (exact histogram refinement, bounded memory, see
    ``operators.quantiles``) or "auto" (default): one cheap statistics job first, then
    ``percentile`` for columns with a bounded distinct count and refinement for the
    rest.  ``exact=False`` uses ``percentile_approx`` with ``accuracy``.
    """
    from . import quantiles as Q

    items = list(cols.items()) if isinstance(cols, dict) else [(c, F.col(c)) for c in cols]
    method = method or QUANTILE_METHOD
    if method == "auto":
        # a filter of one small stored table cannot hold more distinct values than rows
        bound = stored_row_bound(df)
        if bound is not None and bound <= Q.MAX_DISTINCT_FOR_PERCENTILE:
            method = "percentile"
    if not exact or method == "percentile":
        row = first_row(df.agg(*[_quantiles(c, probs, exact, accuracy).alias(n) for n, c in items]))
        return {n: (list(row[n]) if row.get(n) is not None else None) for n, _ in items}
    aggs = []
    for n, c in items:
        x = c.cast("double")
        aggs += [F.count(x).alias(f"{n}__n"), F.min(x).alias(f"{n}__lo"), F.max(x).alias(f"{n}__hi"),
                 F.approx_count_distinct(x).alias(f"{n}__d")]
    st = first_row(df.agg(*aggs))
    small = [(n, c) for n, c in items if method == "auto" and st[f"{n}__d"] <= Q.MAX_DISTINCT_FOR_PERCENTILE]
    out: dict[str, list[float] | None] = {}
    if small:
        values = F.inline(F.array(*[F.struct(F.lit(n).alias("k"), c.cast("double").alias("x")) for n, c in small]))
        arr = F.array(*[F.lit(float(p)) for p in probs])
        found = {r["k"]: r["q"] for r in Q.percentiles(df.select(values), arr).collect()}  # a row for each column
        out.update({n: (list(found[n]) if found.get(n) is not None else None) for n, _ in small})
    for n, c in items:
        if n not in out:
            stats = {"n": st[f"{n}__n"], "lo": st[f"{n}__lo"], "hi": st[f"{n}__hi"]}
            out[n] = Q.refine_quantiles(df, c, probs, stats)
    return out


# ---- C1, C2 ------------------------------------------------------------------------

def drop_incomplete(df: DataFrame, cols: list[str] = NUMERIC) -> DataFrame:
    """C1 (+F5): drop rows with a null, NaN or +-inf in any of the columns.

    Same rows as "inf -> null, then dropna", but the columns stay untouched so
    every later predicate on them is still a plain column predicate that the
    parquet scan can take (PushedFilters).
    """
    cond = F.lit(True)
    for c in cols:
        x = F.col(c)
        cond = cond & x.isNotNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            cond = cond & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.filter(cond)


def sanity_filter(df: DataFrame, t: dict = K.REG_SANITY) -> DataFrame:
    """One conjunctive literal filter (pushed to the scan)."""
    lb, lt = F.col("luas_bangunan"), F.col("luas_tanah")
    cond = ((lb > t["lb_min"]) & (lt > t["lt_min"]) & ~((lt > t["big_lt"]) & (lb < t["small_lb"]))
            & (lb <= t["lb_max"]) & (lt <= t["lt_max"]) & (F.col("kamar_tidur") <= t["kt_max"])
            & (F.col("kamar_mandi") <= t["km_max"]) & (F.col("garasi") <= t["garasi_max"])
            & (F.col("harga") >= t["price_min"]))
    return df.filter(cond)


# ---- C3-C6 -------------------------------------------------------------------------

def global_quantile_filter(df: DataFrame, col: str | Column, lo: float, hi: float,
                           exact: bool = True) -> DataFrame:
    """Keep rows whose value lies in the [lo, hi] quantiles (inclusive)."""
    c = F.col(col) if isinstance(col, str) else col
    b = quantile_bounds(df, {"v": c}, [lo, hi], exact)["v"]
    if b is None:  # empty input
        return df
    return df.filter(c.between(F.lit(b[0]), F.lit(b[1])))


def group_quantile_filter(df: DataFrame, key: str, col: str, lo: float, hi: float,
                          min_n: int = 10, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """C4: per-group quantile window; groups with fewer than ``min_n`` rows pass whole.

    Rows with a null key are dropped (grouped filters never see them).
    """
    from . import quantiles as Q

    if exact:
        stats = Q.group_quantiles(df, key, F.col(col), [lo, hi], QUANTILE_METHOD).withColumnsRenamed(
            {"n": "_n", "q": "_q"})
    else:
        stats = (df.groupBy(key)
                 .agg(F.count(F.lit(1)).alias("_n"), _quantiles(F.col(col), [lo, hi], False, accuracy).alias("_q"))
                 .filter(F.col(key).isNotNull()))
    stats = bounded_broadcast(stats)
    joined = df.join(stats, key, "inner")
    keep = (F.col("_n") < min_n) | F.col(col).between(F.col("_q")[0], F.col("_q")[1])
    return joined.filter(keep).drop("_n", "_q")


def ratio_quantile_filter(df: DataFrame, lo: float = 0.05, hi: float = 0.95, exact: bool = True) -> DataFrame:
    """Price per building m2 within [lo, hi] quantiles; helper column not kept."""
    ratio = F.col("harga") / F.col("luas_bangunan")
    return global_quantile_filter(df, ratio, lo, hi, exact)


@dataclass
class StepCounts:
    """Rows left after each step, counted as they pass (``observe``) in the jobs that run anyway."""
    steps: list[tuple[str, Observation]] = field(default_factory=list)
    last: DataFrame | None = None

    def add(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{name}_{uuid.uuid4().hex[:8]}")
        self.last = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        self.steps.append((name, seen))
        return self.last


class _NoCounts(StepCounts):
    """Counts nothing: observed rows would keep filters from the scan."""

    def add(self, name: str, df: DataFrame) -> DataFrame:
        return df


STAGE_ABOVE_ROWS = 1_000_000


def stage(df: DataFrame, name: str, stage_rows: int | None = STAGE_ABOVE_ROWS) -> DataFrame:
    """Cut lineage before a chain of quantile barriers: write the survivors of the
    selective filters once (shared checkpoint folder) so every later barrier scans
    them instead of re-reading and re-filtering the input.  Skipped for inputs known
    to be small (a filter of a stored table with at most ``stage_rows`` rows), where
    the write costs more than the rescans."""
    if stage_rows is None:
        return df
    bound = stored_row_bound(df)
    if bound is not None and bound <= stage_rows:
        return df
    from ..session import materialize
    return materialize(df, name)


def clean_regression(raw: DataFrame, exact: bool = True, report: StepCounts | None = None,
                     stage_rows: int | None = STAGE_ABOVE_ROWS) -> DataFrame:
    """C1 -> C2 -> C3 -> C4 -> C5, each quantile on the survivors of the step before."""
    rep = report or _NoCounts()
    df = rep.add("raw", raw)
    df = rep.add("drop_incomplete", drop_incomplete(df))
    df = rep.add("sanity_filter", stage(sanity_filter(df), "regression_sane", stage_rows))
    df = rep.add("price_quantile", global_quantile_filter(df, "harga", 0.01, 0.99, exact))
    df = rep.add("area_quantile", group_quantile_filter(df, "lokasi", "harga", 0.05, 0.95, 10, exact))
    df = rep.add("ratio_quantile", ratio_quantile_filter(df, 0.05, 0.95, exact))
    return df


# ---- C7, C8 ------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, tuple[float, float]]:
    """Tukey fences [Q1-1.5 IQR, Q3+1.5 IQR] of several columns in one aggregate job."""
    qs = quantile_bounds(df, {c: F.col(c).cast("double") for c in cols}, [0.25, 0.75], exact)
    out = {}
    for c, q in qs.items():
        if q is None:
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - 1.5 * iqr, q[1] + 1.5 * iqr)
    return out


def iqr_clip(df: DataFrame, cols: list[str] = NUMERIC, exact: bool = True) -> DataFrame:
    """Clip each column to its own fences (columns independent, one aggregate)."""
    fences = iqr_bounds(df, cols, exact)
    return df.withColumns({
        c: F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))
        for c, (lo, hi) in fences.items()
    })


def clean_classification(raw: DataFrame, exact: bool = True) -> DataFrame:
    """C1 -> C7 -> F6 on the clipped price; integer columns truncated on write."""
    df = iqr_clip(drop_incomplete(raw), NUMERIC, exact)
    return df.withColumns({
        "kamar_tidur": F.col("kamar_tidur").cast("int"),
        "kamar_mandi": F.col("kamar_mandi").cast("int"),
        "garasi": F.col("garasi").cast("int"),
        "kelas_harga": X.price_segment("harga"),
    })


# ---- C9-C12 ------------------------------------------------------------------------

def price_range_filter(df: DataFrame, lo: float = K.CLUSTER_PRICE_RANGE[0], hi: float = K.CLUSTER_PRICE_RANGE[1]) -> DataFrame:
    """Lo <= price <= hi."""
    return df.filter(F.col("harga").between(F.lit(lo), F.lit(hi)))


def iqr_drop(df: DataFrame, cols: list[str] = ("harga", "luas_tanah", "luas_bangunan"),
             exact: bool = True, report: StepCounts | None = None) -> DataFrame:
    """Drop rows outside the Tukey fences, one column after the other (sequential)."""
    for c in cols:
        fences = iqr_bounds(df, [c], exact)
        if c in fences:
            lo, hi = fences[c]
            df = df.filter(F.col(c).between(F.lit(lo), F.lit(hi)))
        if report is not None:
            df = report.add(f"iqr_{c}", df)
    return df


def clean_clustering(raw: DataFrame, exact: bool = True, report: StepCounts | None = None,
                     stage_rows: int | None = STAGE_ABOVE_ROWS) -> DataFrame:
    """C11: C1 -> C9 -> C10 -> F12 -> E2 (area median of log price); drop rows with a null feature."""
    from .encoding import fit_median_encoder  # local import: encoding imports cleaning helpers

    rep = report or _NoCounts()
    df = rep.add("raw", raw)
    df = rep.add("drop_incomplete", drop_incomplete(df))
    df = rep.add("price_range", stage(price_range_filter(df), "clustering_in_range", stage_rows))
    df = iqr_drop(df, exact=exact, report=rep)
    df = df.withColumns(X.clustering_features())
    enc = fit_median_encoder(df, "lokasi", "log_harga")
    df = df.join(bounded_broadcast(enc), "lokasi", "left")
    df = df.dropna(subset=X.CLUSTERING_FEATURES)
    return rep.add("features", df)


def removal_report(report: StepCounts) -> DataFrame:
    """(step_no, step, rows, removed) for each recorded step.

    One pass over the last step's rows fills the counts that no earlier job has; the driver gets a number a step.
    """
    report.last.write.format("noop").mode("overwrite").save()
    counts = [(name, int(seen.get["rows"])) for name, seen in report.steps]
    rows = [(i, name, n, counts[i - 1][1] - n if i else 0) for i, (name, n) in enumerate(counts)]
    return report.last.sparkSession.createDataFrame(rows, "step_no int, step string, rows long, removed long")


# ---- C13-C15: validation -----------------------------------------------------------

def _validate(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    reasons = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks]),
                       lambda r: r.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def validate_requests(df: DataFrame, b: dict = K.REQUEST_BOUNDS) -> DataFrame:
    """Flag each prediction request valid or not, with the failed rules."""
    kt, km, g = F.col("kamar_tidur"), F.col("kamar_mandi"), F.col("garasi")
    checks = [
        ("kamar_tidur", kt.between(b["room_min"], b["room_max"])),
        ("kamar_mandi", km.between(b["room_min"], b["room_max"])),
        ("garasi", g.between(b["garasi_min"], b["garasi_max"])),
        ("luas_tanah", F.col("luas_tanah") > 0),
        ("luas_bangunan", F.col("luas_bangunan") > 0),
        ("lokasi", F.length("lokasi") >= b["name_min"]),
    ]
    if "top_k" in df.columns:
        # a request without top_k uses the default of 3
        checks.append(("top_k", F.coalesce(F.col("top_k"), F.lit(3)).between(b["top_k_min"], b["top_k_max"])))
    return _validate(df, checks)


def validate_feedback(df: DataFrame, b: dict = K.FEEDBACK_BOUNDS) -> DataFrame:
    """C14: flag each correction valid or not, with the failed rules."""
    kt, km, g = F.col("kamar_tidur"), F.col("kamar_mandi"), F.col("garasi")
    checks = [
        ("kamar_tidur", kt.between(b["room_min"], b["room_max"])),
        ("kamar_mandi", km.between(b["room_min"], b["room_max"])),
        ("garasi", g.between(b["garasi_min"], b["garasi_max"])),
        ("luas_tanah", F.col("luas_tanah") > 0),
        ("luas_bangunan", F.col("luas_bangunan") > 0),
        ("lokasi", F.length("lokasi") >= b["name_min"]),
        ("harga_prediksi", F.col("harga_prediksi").between(b["price_min"], b["price_max"])),
        ("harga_asli", F.col("harga_asli").between(b["price_min"], b["price_max"])),
    ]
    return _validate(df, checks)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine (with reasons)."""
    return df.filter("is_valid").drop("reasons", "is_valid"), df.filter(~F.col("is_valid"))


def unprocessed(feedback: DataFrame) -> DataFrame:
    """Corrections not yet used by a retrain."""
    return feedback.filter(~F.col("processed"))
