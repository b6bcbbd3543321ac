"""Exact global quantiles that never hold all distinct values in one place.

``percentile`` keeps a value -> count map of every distinct value and merges the
global buffer in one task.  That is fine for a few hundred thousand distinct
values and not for a column with 10^8 of them.  ``auto`` measures the column
first (one cheap aggregate: count, min, max, approximate distinct count) and,
above ``max_distinct``, selects the needed order statistics by histogram
refinement instead:

* each pass keeps, per wanted rank, a value interval [lo, hi] and the number of
  values below it; one aggregate job builds a ``buckets``-wide histogram of every
  unresolved interval (rows outside are filtered, literal bounds push down);
* the bucket holding the rank becomes the next interval; once it holds at most
  ``max_collect`` values (or a single value) those values are read and the rank
  is picked exactly;
* a value repeated in a third of all rows is a single-value bucket and resolves
  at once.

Linear interpolation between the two neighbouring order statistics uses the same
arithmetic as ``percentile``, so both paths return the same doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DISTINCT_FOR_PERCENTILE = 1_000_000


def _interpolate(p: float, n: int, vals: dict[int, float]) -> float:
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi:
        return vals[lo]
    return (hi - pos) * vals[lo] + (pos - lo) * vals[hi]


def refine_quantiles(df: DataFrame, col: Column, probs: list[float], stats: dict | None = None,
                     buckets: int = 4096, max_collect: int = 100_000) -> list[float] | None:
    """Exact quantiles (``percentile`` semantics) by histogram refinement."""
    base = df.select(col.cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    if stats is None:
        stats = base.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first().asDict()
    n = int(stats["n"])
    if n == 0:
        return None
    ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    state = {r: (float(stats["lo"]), float(stats["hi"]), 0) for r in ranks}   # lo, hi, rows below lo
    found: dict[int, float] = {}
    while len(found) < len(ranks):
        todo = [r for r in ranks if r not in found]
        for r in list(todo):
            lo, hi, _ = state[r]
            if lo == hi:
                found[r] = lo
        todo = [r for r in ranks if r not in found]
        if not todo:
            break
        # one histogram job for every unresolved rank
        probes = []
        for i, r in enumerate(todo):
            lo, hi, _ = state[r]
            width = (hi - lo) / buckets
            b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(buckets - 1))
            probes.append(F.when(F.col("x").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("p"), b.alias("b"))))
        hist = (base.select("x", F.explode(F.array(*probes)).alias("pb")).filter(F.col("pb").isNotNull())
                .groupBy("pb.p", "pb.b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                .collect())   # at most len(todo) * buckets rows
        by_probe: dict[int, list] = {}
        for h in hist:
            by_probe.setdefault(h["p"], []).append(h)
        for i, r in enumerate(todo):
            lo, hi, below = state[r]
            cum = below
            for h in sorted(by_probe.get(i, []), key=lambda h: h["b"]):
                if cum + h["c"] > r:
                    if h["mn"] == h["mx"]:
                        found[r] = float(h["mn"])
                    elif h["c"] <= max_collect:
                        vals = [v[0] for v in base.filter(F.col("x").between(F.lit(h["mn"]), F.lit(h["mx"])))
                                .orderBy("x").collect()]          # bounded by max_collect
                        found[r] = float(vals[r - cum])
                    else:
                        state[r] = (float(h["mn"]), float(h["mx"]), cum)
                    break
                cum += h["c"]
    return [_interpolate(p, n, found) for p in probs]


def percentiles(values: DataFrame, arr: Column) -> DataFrame:
    """``(k, n, q)`` of ``values (k, x)``: equal values are counted first.

    A buffer of ``percentile`` holds each distinct value, so one from every task would bring the
    task that merges a group as many copies of them as there are tasks.
    """
    counted = values.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("k").agg(F.sum("c").alias("n"), F.percentile("x", arr, F.col("c")).alias("q"))


def quantiles(df: DataFrame, col: Column, probs: list[float], method: str = "auto",
              max_distinct: int = MAX_DISTINCT_FOR_PERCENTILE) -> list[float] | None:
    """Exact quantiles of one column: ``percentile`` when its buffer is bounded
    (``auto`` checks the approximate distinct count first), refinement otherwise."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if method == "percentile":
        r = percentiles(df.select(F.lit(0).alias("k"), col.alias("x")), arr).select("q").first()
        return list(r["q"]) if r and r["q"] is not None else None
    x = col.cast("double")
    stats = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                   F.approx_count_distinct(x).alias("d")).first().asDict()
    if method == "auto" and stats["d"] <= max_distinct:
        return quantiles(df, col, probs, "percentile")
    return refine_quantiles(df, col, probs, stats)


def group_quantiles(df: DataFrame, key: str, col: Column, probs: list[float], method: str = "auto",
                    max_distinct: int = MAX_DISTINCT_FOR_PERCENTILE, buckets: int = 1024,
                    max_collect: int = 100_000) -> DataFrame:
    """Exact per-group quantiles (``percentile`` semantics) -> DataFrame(key, n, q array).

    ``auto``: one statistics aggregate per group (count, min, max, approximate distinct
    count); groups whose distinct count is bounded get one ``percentile`` aggregate,
    hot groups (more distinct values than ``max_distinct``) are refined with
    (group, bucket) histograms — the bucket spreads a hot group over many reducers,
    and no reducer ever merges all of its distinct values.
    """
    spark = df.sparkSession
    base = (df.select(F.col(key).alias("k"), col.cast("double").alias("x"))
            .filter(F.col("k").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x")))
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if method == "auto":
        from ..session import stored_row_bound
        bound = stored_row_bound(df)
        if bound is not None and bound <= max_distinct:
            method = "percentile"
    if method == "percentile":
        return percentiles(base, arr).withColumnRenamed("k", key)
    stats = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                  F.approx_count_distinct("x").alias("d"))
    hot = stats.filter(F.col("d") > max_distinct) if method == "auto" else stats
    hot_rows = hot.collect()   # hot groups are few: each holds more than max_distinct distinct values
    hot_keys = spark.createDataFrame([(r["k"],) for r in hot_rows], base.select("k").schema) if hot_rows else None
    cold = base if hot_keys is None else base.join(F.broadcast(hot_keys), "k", "left_anti")
    out = percentiles(cold, arr)
    if not hot_rows:
        return out.withColumnRenamed("k", key)
    # refinement state per (group, rank): lo, hi, rows below lo
    state, found, ns = {}, {}, {}
    for r in hot_rows:
        n = int(r["n"])
        ns[r["k"]] = n
        for rank in {v for p in probs for v in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}:
            state[(r["k"], rank)] = (float(r["lo"]), float(r["hi"]), 0)
    while len(found) < len(state):
        for sk, (lo, hi, _) in state.items():
            if sk not in found and lo == hi:
                found[sk] = lo
        todo = [sk for sk in state if sk not in found]
        if not todo:
            break
        probes = spark.createDataFrame(
            [(i, sk[0], state[sk][0], state[sk][1], (state[sk][1] - state[sk][0]) / buckets) for i, sk in enumerate(todo)],
            f"pid int, k {base.schema['k'].dataType.simpleString()}, lo double, hi double, w double")
        b = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")).cast("int"), F.lit(buckets - 1))
        hist = (base.join(F.broadcast(probes), "k").filter(F.col("x").between(F.col("lo"), F.col("hi")))
                .groupBy("pid", b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"),
                                                  F.max("x").alias("mx"))
                .collect())   # <= len(todo) * buckets rows
        by_probe: dict[int, list] = {}
        for h in hist:
            by_probe.setdefault(h["pid"], []).append(h)
        for i, sk in enumerate(todo):
            lo, hi, below = state[sk]
            rank = sk[1]
            cum = below
            for h in sorted(by_probe.get(i, []), key=lambda h: h["b"]):
                if cum + h["c"] > rank:
                    if h["mn"] == h["mx"]:
                        found[sk] = float(h["mn"])
                    elif h["c"] <= max_collect:
                        vals = [v[0] for v in base.filter((F.col("k") == F.lit(sk[0]))
                                                          & F.col("x").between(F.lit(h["mn"]), F.lit(h["mx"])))
                                .orderBy("x").select("x").collect()]      # bounded by max_collect
                        found[sk] = float(vals[rank - cum])
                    else:
                        state[sk] = (float(h["mn"]), float(h["mx"]), cum)
                    break
                cum += h["c"]
    hot_out = [(k, ns[k], [_interpolate(p, ns[k], {r: v for (kk, r), v in found.items() if kk == k}) for p in probs])
               for k in ns]
    hot_df = spark.createDataFrame(hot_out, f"k {base.schema['k'].dataType.simpleString()}, n long, q array<double>")
    return out.unionByName(hot_df).withColumnRenamed("k", key)
