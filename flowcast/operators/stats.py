"""Aggregations and descriptive statistics.

Each operator is one or two aggregation jobs. Scalars (edges, bandwidths,
means) are attached as scalar subqueries; small fixed-size spines (bins, grid
points) are generated with ``sequence`` and joined, so empty bins are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.functions.buckets import time_bucket, width_seconds
from flowcast.functions.calendar import day_of_week
from flowcast.functions.columns import clean_double, pearson, with_scalars
from flowcast.operators.sketch import approx_quantiles
from flowcast.session import cut_lineage


# --- D1 resampling ---------------------------------------------------------

def time_spine(spark: SparkSession, lo, hi, width: str, name: str = "ts") -> DataFrame:
    """All bucket starts from ``lo`` to ``hi`` inclusive, generated by ``spark.range``
    so a long spine is spread over many tasks."""
    w = width_seconds(width)
    n = int((hi - lo).total_seconds() // w) + 1
    return spark.range(0, n).select(
        F.expr(f"timestampadd(SECOND, id * {w}, TIMESTAMP_NTZ'{lo.isoformat(sep=' ')}')").alias(name))


def resample_mean(df: DataFrame, width: str, cols: Sequence[str] | None = None, ts: str = "ts",
                  keys: Sequence[str] = (), gap_fill: bool = True) -> DataFrame:
    """Left-closed, left-labelled bucket means; with ``gap_fill`` every empty
    bucket between the first and last one is emitted with NULL values (per key)."""
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in (ts, *keys)]
    agg = (df.groupBy(time_bucket(ts, width).alias(ts), *keys)
             .agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]))
    if not gap_fill:
        return agg
    if keys:
        return _keyed_gap_fill(agg, width, ts, keys)
    bounds = agg.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if bounds["lo"] is None:
        return agg
    spine = time_spine(df.sparkSession, bounds["lo"], bounds["hi"], width, ts)
    # same timestamp type as the data (the collected bounds are session-local wall times)
    spine = spine.select(F.col(ts).cast(agg.schema[ts].dataType).alias(ts))
    return spine.join(agg, on=[ts], how="left")


def _keyed_gap_fill(agg: DataFrame, width: str, ts: str, keys: list[str]) -> DataFrame:
    """Every bucket from each key's first to its last, NULL where it has none. A key's
    spine is exploded in two steps, so a long one is not one array."""
    w, step = width_seconds(width), 1000
    spine = agg.groupBy(*[F.col(f"`{k}`").alias(f"_fc_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(ts).alias("_fc_lo"), F.max(ts).alias("_fc_hi"))
    last = F.expr(f"timestampdiff(SECOND, _fc_lo, _fc_hi) div {w}")
    spine = (spine.withColumn("_fc_n", last)
             .withColumn("_fc_a", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_fc_n div {step}"))))
             .withColumn("_fc_b", F.explode(F.sequence(F.col("_fc_a") * step, F.least(F.col("_fc_a") * step + (step - 1), F.col("_fc_n")))))
             .withColumn("_fc_t", F.expr(f"timestampadd(SECOND, _fc_b * {w}, _fc_lo)")))
    rest = [c for c in agg.columns if c != ts and c not in keys]
    # the spine comes from the same frame: join under names of its own
    have = agg.withColumnsRenamed({ts: "_fc_ts"} | {k: f"_fc_h{i}" for i, k in enumerate(keys)})
    on = F.col("_fc_ts") == F.col("_fc_t")
    for i in range(len(keys)):
        on = on & F.col(f"_fc_h{i}").eqNullSafe(F.col(f"_fc_k{i}"))
    return spine.join(have, on, "left").select(
        F.col("_fc_t").alias(ts), *[F.col(f"_fc_k{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in rest])


# --- D2-D5 profiles ----------------------------------------------------------

def daily_mean(long: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean over sensors per timestamp, then mean per calendar day."""
    per_ts = long.groupBy(ts).agg(F.avg(value).alias("_fc_m"))
    return per_ts.groupBy(F.to_date(ts).alias("day")).agg(F.avg("_fc_m").alias("daily_mean"))


def _profile(long: DataFrame, key: Column, key_name: str, sensor: str, value: str) -> DataFrame:
    per_sensor = long.groupBy(key.alias(key_name), sensor).agg(F.avg(value).alias("_fc_m"))
    return per_sensor.groupBy(key_name).agg(F.avg("_fc_m").alias("mean_value"))


def hourly_profile(long: DataFrame, ts: str = "ts", sensor: str = "sensor_id", value: str = "value") -> DataFrame:
    """D3: hour -> mean of the per-sensor hourly means."""
    return _profile(long, F.hour(ts), "hour", sensor, value)


def weekday_profile(long: DataFrame, ts: str = "ts", sensor: str = "sensor_id", value: str = "value") -> DataFrame:
    """Weekday (Monday=0) -> mean of the per-sensor means."""
    return _profile(long, day_of_week(ts), "day_of_week", sensor, value)


def sensor_grid(long: DataFrame, n_cols: int = 9, sensor: str = "sensor_id", value: str = "value") -> DataFrame:
    """Per-sensor mean placed at (i div n_cols, i mod n_cols), i = sensor ordinal
    (distributed row index over the per-sensor summary)."""
    from flowcast.operators.ordered import with_row_index
    means = long.groupBy(sensor).agg(F.avg(value).alias("mean_value"))
    return with_row_index(means, [sensor], (), "_fc_i").select(
        sensor, "mean_value",
        F.floor(F.col("_fc_i") / n_cols).cast("int").alias("grid_row"),
        (F.col("_fc_i") % n_cols).cast("int").alias("grid_col"))


# --- D6-D9 bins, trend, correlation ----------------------------------------

def quantile_edges(df: DataFrame, col: str, q: int, method: str = "exact") -> DataFrame:
    """One-row frame with ``e``: ARRAY<DOUBLE> of the q+1 quantile edges, exact and linear or
    by a sketch (``method="sketch"``: the first and last edge are exact, the others values of
    the data whose rank is off by no more than the sketch's error)."""
    from flowcast.operators.clean import quantiles
    probs = [k / q for k in range(q + 1)]
    qs = quantiles(df, [col], probs, method)
    return qs.select(F.array(*[F.col(c) for c in qs.columns]).alias("e"))


def quantile_bin_stats(df: DataFrame, by: str, value: str, q: int = 10, method: str = "exact") -> DataFrame:
    """``qcut(by, q)`` then mean, sample std and count of ``value`` per bin.

    Bins are right-closed with the lowest edge included; duplicate edges raise an
    error (as ``qcut`` does). Every bin 1..q is emitted, empty ones with count 0.
    ``method="sketch"`` takes approximate edges (:func:`quantile_edges`) from one aggregation."""
    # the edges are read by two scalar subqueries: a sketch, whose choices are random, is made once
    found = quantile_edges(df, by, q, method)
    if method == "sketch":
        found = cut_lineage(found)
    data, s = with_scalars(df, found, "_fc_e")
    edges = s["e"]
    inner = F.slice(edges, 2, q - 1)
    x = F.col(by)
    bin_no = (F.lit(1) + F.size(F.filter(inner, lambda e: x > e))).cast("int")
    dup = F.exists(F.sequence(F.lit(1), F.lit(q)), lambda k: F.element_at(edges, k) >= F.element_at(edges, k + 1))
    checked = F.when(dup, F.raise_error(F.lit("quantile_bin_stats: bin edges are not unique"))).otherwise(bin_no)
    binned = data.where(x.isNotNull()).select(checked.alias("bin"), F.col(value).alias("_fc_v"))
    stats = binned.groupBy("bin").agg(F.avg("_fc_v").alias("mean_value"),
                                      F.stddev_samp("_fc_v").alias("std_value"),
                                      F.count("_fc_v").alias("n"))
    spine = df.sparkSession.range(1, q + 1).select(F.col("id").cast("int").alias("bin"))
    spine, s2 = with_scalars(spine, found, "_fc_e")
    spine = spine.select("bin", F.element_at(s2["e"], F.col("bin")).alias("lower"),
                         F.element_at(s2["e"], F.col("bin") + 1).alias("upper"))
    return (spine.join(stats, "bin", "left")
                 .select("bin", "lower", "upper", "mean_value", "std_value",
                         F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Degree-1 least squares y = slope * x + intercept."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation, NULL pairs skipped; NULL if either column does not vary."""
    return df.agg(clean_double(pearson(a, b)).alias("corr"))


GRAM_ROWS = 4096  # rows multiplied at a time
_SAME = 1e-12  # a variance below this share of the mean square counts as none


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson for every ordered pair, as (col_a, col_b, corr); NULL
    where a column does not vary over the rows that both have.

    For hundreds of columns the sums of all pairs are matrix products: with X the values
    about their column means (0 where missing) and M the 0/1 mask of values, ``M'M`` counts
    the rows of each pair, ``X'M`` and ``(X*X)'M`` sum each column over the other's rows and
    ``X'X`` sums the products. Every task multiplies blocks of rows and gives one partial sum
    a pair; those are added with map-side combining, so what is shuffled is a task's number
    of pairs, whatever its number of rows."""
    cols = list(cols)
    p = len(cols)
    if not p:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    clean = df.select(*[clean_double(F.col(f"`{c}`").cast("double")).alias(f"_fc_{i}") for i, c in enumerate(cols)])
    means = clean.agg(F.array(*[F.coalesce(F.avg(f"_fc_{i}"), F.lit(0.0)) for i in range(p)]).alias("m"))
    rows, s = with_scalars(clean, means, "_fc_m")
    centred = rows.select(F.zip_with(F.array(*[f"_fc_{i}" for i in range(p)]), s["m"], lambda x, m: x - m).alias("x"))
    upper_a, upper_b = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(upper_a)))
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                flat = batch.column(0).slice(at, GRAM_ROWS).flatten()
                x = flat.to_numpy(zero_copy_only=False).reshape(-1, p)  # NULL comes as NaN
                mask = ~np.isnan(x)
                x, m = np.where(mask, x, 0.0), mask.astype(np.float64)
                first, square = x.T @ m, (x * x).T @ m
                total += np.stack([g[upper_a, upper_b] for g in (m.T @ m, first, first.T, square, square.T, x.T @ x)])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper_a.astype(np.int32)), pa.array(upper_b.astype(np.int32)),
                                              *[pa.array(t) for t in total]], names=["a", "b", *_SUMS])

    partial = centred.mapInArrow(sums, "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS))
    g = partial.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    var_a, var_b = n * F.col("qa") - F.col("sa") * F.col("sa"), n * F.col("qb") - F.col("sb") * F.col("sb")
    varies = (var_a > _SAME * n * F.col("qa")) & (var_b > _SAME * n * F.col("qb"))
    r = (n * F.col("ab") - F.col("sa") * F.col("sb")) / (F.sqrt(var_a) * F.sqrt(var_b))
    corr = F.when(varies, F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))
    names = F.array(*[F.lit(c) for c in cols])
    upper = g.select("a", "b", corr.alias("corr"))
    # pairs come out in both orders; a column with no rows at all still has its pairs
    both = upper.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "corr"))).otherwise(
        F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr")))))
    spine = df.sparkSession.range(p * p).select((F.col("id") / p).cast("int").alias("i"), (F.col("id") % p).cast("int").alias("j"))
    return spine.join(both, (F.col("i") == F.col("a")) & (F.col("j") == F.col("b")), "left").select(
        F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "corr")


_SUMS = ("n", "sa", "sb", "qa", "qb", "ab")  # rows, sums, squares and products of a pair


# --- D10-D12 distributions --------------------------------------------------

def histogram(df: DataFrame, col: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max]; bins are left-closed, the last one
    closed; every bin is emitted. min == max widens the range by 0.5 each side.
    Values exactly on an edge are placed as NumPy places them."""
    x = F.col(col)
    data = df.where(x.isNotNull())
    stats = data.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n"))
    data, s = with_scalars(data, stats, "_fc_h")
    lo = F.when(s["mn"] == s["mx"], s["mn"] - 0.5).otherwise(s["mn"])
    hi = F.when(s["mn"] == s["mx"], s["mx"] + 0.5).otherwise(s["mx"])
    step = (hi - lo) / F.lit(float(bins))

    def edge(k: Column) -> Column:
        return F.when(k >= bins, hi).otherwise(lo + k.cast("double") * step)

    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    idx = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    idx = F.when(x < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((x >= edge(idx + 1)) & (idx != bins - 1), idx + 1).otherwise(idx)
    counts = data.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(0, bins).select(F.col("id").cast("int").alias("bin"))
    spine, s = with_scalars(spine, stats, "_fc_h")
    cnt = F.coalesce("count", F.lit(0).cast("long"))
    extra = [F.try_divide(cnt, s["n"] * step).alias("density")] if density else []
    return (spine.join(counts, "bin", "left")
                 .select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
                         cnt.alias("count"), *extra))


def describe(df: DataFrame, col: str, ddof: int = 1) -> DataFrame:
    """Count, mean, std (ddof=1 sample or 0 population), min, max."""
    x = F.col(col)
    std = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))


KDE_BINS = 64  # bins a bandwidth


def _kde_frame(df: DataFrame, col: str, grid: int, cut: float):
    """The values as ``_fc_x`` with, by scalar subquery, count, bandwidth, first point, step."""
    data = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_fc_x"))
    found = data.agg(F.min("_fc_x").alias("mn"), F.max("_fc_x").alias("mx"), F.count("_fc_x").alias("n"),
                     F.stddev_samp("_fc_x").alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    lo = F.col("mn") - F.lit(cut) * h
    step = (F.col("mx") - F.col("mn") + F.lit(2 * cut) * h) / F.lit(float(grid - 1))
    # a constant column has no bandwidth: NULL density
    return with_scalars(data, found.select("n", F.nullif(h, F.lit(0.0)).alias("h"), lo.alias("lo"), step.alias("step")), "_fc_k")


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, method: str = "binned") -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth h = std * n^(-1/5) on
    ``grid`` points from min - cut*h to max + cut*h.

    ``binned`` (default) is linear in the rows: each falls into one bin of h/64, which keeps
    the count and the first three moments about its middle; the kernel of a bin at a grid
    point is its Taylor series (Hermite polynomials) to third order. A density errs by at
    most 4e-10 / h: the fourth derivative of the kernel is at most 3 times its peak,
    and a row is at most h/128 off the middle. Only occupied bins exist; their number is the
    range over h/64 at most, so it grows with the fifth root of the rows. ``exact`` sums the
    kernel of every row at every point."""
    x = F.col("_fc_x")
    data, s = _kde_frame(df, col, grid, cut)
    point = s["lo"] + F.col("k").cast("double") * s["step"]
    points = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k")
    if method == "exact":
        z = F.try_divide(point - x, s["h"])
        kernel = F.sum(F.exp(F.lit(-0.5) * z * z))
        found = data.select("_fc_x", "_fc_k", points)
    elif method == "binned":
        # places in bandwidths from the first point
        place = F.try_divide(x - s["lo"], s["h"])
        cell = F.floor(place * KDE_BINS)
        v = place - (cell + 0.5) / KDE_BINS
        bins = data.select("_fc_k", cell.alias("cell"), v.alias("v")).groupBy("cell", "_fc_k").agg(
            F.count(F.lit(1)).alias("m0"), F.sum("v").alias("m1"), F.sum(F.col("v") * F.col("v")).alias("m2"),
            F.sum(F.col("v") * F.col("v") * F.col("v")).alias("m3"))
        found = bins.select("*", points)
        t = F.try_divide(point - s["lo"], s["h"]) - (F.col("cell") + 0.5) / KDE_BINS
        series = (F.col("m0") + t * F.col("m1") + (t * t - 1) * F.col("m2") / 2 + (t * t * t - 3 * t) * F.col("m3") / 6)
        kernel = F.sum(F.exp(F.lit(-0.5) * t * t) * series)
    else:
        raise ValueError(f"unknown method {method!r}")
    dens = found.groupBy("k", "_fc_k").agg(kernel.alias("_fc_s"))
    norm = s["n"].cast("double") * s["h"] * F.lit((2 * 3.141592653589793) ** 0.5)
    return dens.select(F.col("k").cast("int").alias("k"), point.alias("x"),
                       F.try_divide(F.col("_fc_s"), norm).alias("density"))


# --- D13-D18 -----------------------------------------------------------------

def box_stats(df: DataFrame, group: str, value: str, whis: float = 1.5, method: str = "exact") -> DataFrame:
    """Per group Q1, median, Q3, whiskers (extreme points within whis*IQR of
    the quartiles) and the number of outliers beyond them. ``method="sketch"`` takes the
    quartiles from one mergeable sketch a group."""
    from flowcast.operators.ordered import exact_quantiles
    if method not in ("exact", "sketch"):
        raise ValueError(f"unknown method {method!r}")
    v = F.col(value)
    data = df.where(v.isNotNull() & F.col(group).isNotNull())
    # exact per-group quartiles without holding a group's values in one task
    quartiles = approx_quantiles if method == "sketch" else exact_quantiles
    q = quartiles(data, value, [0.25, 0.5, 0.75], by=[group], names=["q1", "median", "q3"])
    if method == "sketch":
        q = cut_lineage(q)  # a sketch made again after a lost executor may choose other values
    j = data.join(q, group)
    lo = F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))
    inside = (v >= lo) & (v <= hi)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.count(v).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def quantile_threshold(df: DataFrame, col: str, p: float, method: str = "exact") -> DataFrame:
    """Linear quantile as a one-row frame, exact or by a sketch (``method="sketch"``)."""
    from flowcast.operators.clean import quantiles
    return quantiles(df, [col], [p], method).select(F.col(f"{col}_q{round(p * 100):02d}").alias("threshold"))


def any_true(df: DataFrame, cond: Column, name: str = "any_true") -> DataFrame:
    """Whether any row satisfies ``cond`` (NULL counts as False)."""
    return df.agg(F.coalesce(F.bool_or(F.coalesce(cond, F.lit(False))), F.lit(False)).alias(name))


def residual_moments(df: DataFrame, actual: str = "y_true", pred: str = "y_pred", corrected: bool = True,
                     by: Sequence[str] = ()) -> DataFrame:
    """Residual mean, population std, skewness and excess kurtosis.

    ``corrected=True``: residual = actual - pred with bias-corrected G1/G2
    (pandas ``skew``/``kurtosis``); ``False``: residual = pred - actual with the
    population g1/g2 (SciPy defaults)."""
    r = (F.col(actual) - F.col(pred)) if corrected else (F.col(pred) - F.col(actual))
    by = list(by)
    m = df.select(*by, r.alias("_fc_r")).groupBy(*by).agg(
        F.count("_fc_r").alias("n"), F.avg("_fc_r").alias("mean"), F.stddev_pop("_fc_r").alias("std"),
        F.skewness("_fc_r").alias("g1"), F.kurtosis("_fc_r").alias("g2"))
    n = F.col("n").cast("double")
    if corrected:
        skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    else:
        skew, kurt = F.col("g1"), F.col("g2")
    return m.select(*by, "n", "mean", "std", clean_double(skew).alias("skewness"), clean_double(kurt).alias("kurtosis"))


def scatter_pairs(joined: DataFrame, traffic: str = "avg_speed",
                  weather_cols: Sequence[str] = ("tmax", "prcp", "awnd", "rhav"), ts: str = "ts") -> DataFrame:
    """(ts, feature, weather_value, traffic) pairs for scatter plots of traffic
    against each weather variable, from an aligned frame (C1)."""
    return (joined.select(ts, traffic, *weather_cols)
                  .unpivot([ts, traffic], list(weather_cols), "feature", "weather_value")
                  .select(ts, "feature", "weather_value", F.col(traffic).alias("traffic")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()
