"""Cleaning: row means, completeness, IQR filter/clip, null profile, fills,
projections (B1-B5, B9-B13).

Scalars such as quartiles come from one-row frames and are attached as scalar
subqueries, so no join is planned for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast.functions.columns import clean_double, guarded_clip, pearson, with_scalars
from flowcast.operators import ordered
from flowcast.operators.sketch import quantile_sketches, sketch_quantiles


def row_mean(long: DataFrame, ts: str = "ts", value: str = "value", name: str = "avg_speed") -> DataFrame:
    """B1 (long form): mean over sensors per timestamp, NULLs skipped."""
    return long.groupBy(ts).agg(F.avg(F.col(value)).alias(name))


def row_mean_wide(df: DataFrame, cols: Sequence[str], name: str = "avg_speed") -> DataFrame:
    """B1 (wide form): mean over the given columns, NULLs skipped."""
    cols = list(cols)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return df.withColumn(name, F.when(count > 0, total / count))


def complete_timestamps(long: DataFrame, n_sensors, ts: str = "ts", value: str = "value",
                        name: str = "avg_speed") -> DataFrame:
    """B1 + B2 in long form: timestamps where all ``n_sensors`` have a value, with
    their row mean. ``n_sensors`` is an int or a one-row DataFrame column."""
    agg = long.groupBy(ts).agg(F.avg(F.col(value)).alias(name), F.count(F.col(value)).alias("_fc_k"))
    if isinstance(n_sensors, int):
        return agg.where(F.col("_fc_k") == n_sensors).drop("_fc_k")
    j, s = with_scalars(agg, n_sensors.select(F.col(n_sensors.columns[0]).alias("ns")), "_fc_ns")
    return j.where(F.col("_fc_k") == s["ns"]).drop("_fc_k", "_fc_ns")


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B2: drop rows with any NULL (wide form)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact") -> DataFrame:
    """One-row frame of linearly interpolated quantiles ``<col>_q<p*100>``.

    ``method``: ``"exact"`` (default) -- value counts and a distributed running total
    (:func:`ordered.exact_quantiles`), the same plan at every size, so no task holds
    all distinct values; ``"approx"`` -- ``percentile_approx`` sketches; ``"sketch"`` --
    mergeable sketches with a stated rank error (:mod:`flowcast.operators.sketch`)."""
    labels = lambda c: [f"{c}_q{round(p * 100):02d}" for p in probs]
    cols = list(cols)
    if method == "sketch":
        q = sketch_quantiles(quantile_sketches(df, cols), probs, [f"_fc_p{i}" for i in range(len(probs))])
        return q.agg(*[F.max(F.when(F.col("column") == c, F.col(f"_fc_p{i}"))).alias(label)
                       for c in cols for i, label in enumerate(labels(c))])
    if method == "approx":
        return df.agg(*[F.percentile_approx(F.col(c), p, 10000).alias(label)
                        for c in cols for p, label in zip(probs, labels(c))])
    if len(cols) == 1:
        q = ordered.exact_quantiles(df, cols[0], probs, names=labels(cols[0]))
    else:
        # all columns in one pass: (column, value) long form, quantiles grouped by column
        long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
            [], cols, "_fc_col", "_fc_val")
        q = ordered.exact_quantiles(long, "_fc_val", probs, by=["_fc_col"],
                                    names=[f"_fc_p{i}" for i in range(len(probs))])
        q = q.agg(*[F.max(F.when(F.col("_fc_col") == c, F.col(f"_fc_p{i}"))).alias(label)
                    for c in cols for i, label in enumerate(labels(c))])
    return q


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """One row with ``<c>_lo``/``<c>_hi`` = Q1 - k IQR, Q3 + k IQR for each column."""
    q = quantiles(df, cols, (0.25, 0.75), method)
    out = []
    for c in cols:
        q1, q3 = F.col(f"{c}_q25"), F.col(f"{c}_q75")
        out += [(q1 - F.lit(k) * (q3 - q1)).alias(f"{c}_lo"), (q3 + F.lit(k) * (q3 - q1)).alias(f"{c}_hi")]
    return q.select(*out)


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, method: str = "exact") -> DataFrame:
    """Keep rows with Q1 - k IQR <= x <= Q3 + k IQR (inclusive)."""
    j, b = with_scalars(df, iqr_bounds(df, [col], k, method), "_fc_iqr")
    return j.where((F.col(col) >= b[f"{col}_lo"]) & (F.col(col) <= b[f"{col}_hi"])).drop("_fc_iqr")


def iqr_clip(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """Winsorise each column to its IQR fences (NULLs stay NULL)."""
    cols = list(cols)
    j, b = with_scalars(df, iqr_bounds(df, cols, k, method), "_fc_iqr")
    return j.select(*[
        guarded_clip(c, b[f"{c}_lo"], b[f"{c}_hi"]).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns
    ])


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, total_null, n_remaining) in one pass; ``n_remaining``
    is the number of non-null cells of the column."""
    cols = list(cols) if cols else list(df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_fc_rows"),
                    *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = counts.unpivot(["_fc_rows"], cols, "column", "n_null")
    total = sum((F.col(f"`{c}`") for c in cols), F.lit(0))
    j, s = with_scalars(long, counts.select(total.alias("total_null")), "_fc_tot")
    return j.select("column", "n_null", s["total_null"].alias("total_null"),
                    (F.col("_fc_rows") - F.col("n_null")).alias("n_remaining"))


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and +/-Inf to NULL in floating columns."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = set(cols) if cols else fl
    return df.select(*[clean_double(c).alias(c) if c in cols and c in fl else F.col(f"`{c}`") for c in df.columns])


def fill_policy(df: DataFrame, ts: str = "ts", series=(), index_col: str = "rn", **kw) -> DataFrame:
    """For columns that have NULLs, time interpolation for doubles and forward
    fill for the others, then a backward fill of what is left.

    The set of columns with NULLs is found with one count job (metadata only)."""
    cols = [c for c in df.columns if c not in (ts, index_col, *series)]
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first().asDict()
    having = [c for c in cols if nulls[c] > 0]
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    interp = [c for c in having if c in dbl]
    other = [c for c in having if c not in dbl]
    indexed, added = ordered.ensure_index(df, [ts], series, index_col)
    out = indexed
    if interp:
        out = ordered.interpolate_time(out, interp, ts=ts, series=series, index_col=index_col, **kw)
    if other:
        out = ordered.fill_forward(out, other, [ts], series, index_col, **kw)
    out = ordered.fill_backward(out, having, [ts], series, index_col, **kw)
    return out.drop(index_col) if added else out


def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Projection (pruned down to the scan)."""
    return df.select(*names)


def with_target(df: DataFrame, source: str, name: str = "target") -> DataFrame:
    """Copy the target column (reference: the last column, ``speed_ma30``)."""
    return df.withColumn(name, F.col(source))


def select_by_correlation(df: DataFrame, target: str, features: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """(feature, corr) for features with |corr(feature, target)| >= threshold,
    all correlations in one aggregation. A feature that does not vary has the correlation
    NaN, which counts as above any threshold, as it does in SQL."""
    feats = list(features)
    corrs = df.agg(*[pearson(F.col(f"`{f}`"), F.col(f"`{target}`")).alias(f) for f in feats])
    return (corrs.unpivot([], feats, "feature", "corr")
                 .where(F.abs(F.col("corr")) >= F.lit(threshold)))
