"""Sequence building, decomposition, autocorrelation and encoding.

All ordered work runs over the distributed row index and halo chunks of
:mod:`flowcast.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast.functions.columns import with_scalars
from flowcast.operators import ordered
from flowcast.operators.ordered import RN, CHUNK_ROWS


def sequences(df: DataFrame, features: Sequence[str], target: str, length: int, horizon: int = 1,
              order_by=("ts",), series=(), index_col: str = RN, chunk_rows: int = CHUNK_ROWS,
              partitions: int | None = None) -> DataFrame:
    """E5: windows of ``length`` consecutive rows -> label ``horizon`` rows after the
    window's last row. A feature may be an ARRAY<DOUBLE> column, whose values take its
    place. Output (seq_idx, ts of the label row, y, x ARRAY<ARRAY<DOUBLE>>);
    n - length - horizon + 1 sequences per series, ``seq_idx`` 0-based."""
    feats = list(features)
    indexed, _ = ordered.ensure_index(df, order_by, series, index_col)
    back = length + horizon - 1
    listed = {f.name for f in indexed.schema.fields if isinstance(f.dataType, T.ArrayType)}
    parts = [F.col(f"`{c}`").cast("array<double>") if c in listed else F.array(F.col(f"`{c}`").cast("double")) for c in feats]
    row = F.concat(*parts) if listed & set(feats) else F.array(*[F.col(f"`{c}`").cast("double") for c in feats])

    def build(w):
        frame = w.rowsBetween(-back, -horizon)
        return {"x": F.collect_list(row).over(frame)}

    out = ordered.halo_window(indexed, build, series, index_col, back=back, chunk_rows=chunk_rows, partitions=partitions)
    ser = [F.col(c) for c in ordered._names(series)]
    return (out.where(F.size("x") == length)
               .select(*ser, (F.col(index_col) - back).alias("seq_idx"), F.col(order_by[0]).alias("ts"),
                       F.col(target).cast("double").alias("y"), "x"))


def sequence_vector(seqs: DataFrame, x: str = "x", name: str = "features") -> DataFrame:
    """Flatten the (length x features) window into one ML vector."""
    from pyspark.ml.functions import array_to_vector
    return seqs.withColumn(name, array_to_vector(F.flatten(F.col(x))))


def cumulative_abs_error(preds: DataFrame, series=("model", "variant"), ts: str = "ts",
                         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running sum of |y_pred - y_true| per series in time order."""
    e = preds.withColumn("_fc_ae", F.abs(F.col("y_pred") - F.col("y_true")))
    out = ordered.running_sum(e, "_fc_ae", "cum_abs_error", [ts], series, chunk_rows=chunk_rows)
    return out.drop("_fc_ae")


def seasonal_decompose(df: DataFrame, value: str, period: int, order_by=("ts",), index_col: str = RN,
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Additive decomposition x = trend + seasonal + resid.

    trend: centred moving average (for even ``period`` the 2 x period average, i.e.
    the mean of the two full ``period`` windows around the row); NULL at both ends.
    seasonal: mean of the detrended values per phase (row index mod period) minus
    the mean of those phase means. Needs at least two full cycles and no NULLs."""
    p = period
    indexed, _ = ordered.ensure_index(df, order_by, (), index_col)
    half = p // 2

    def build(w):
        x = F.col(value)
        if p % 2 == 0:
            f1, f2 = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
            full = (F.count(x).over(f1) == p) & (F.count(x).over(f2) == p)
            return {"trend": F.when(full, (F.avg(x).over(f1) + F.avg(x).over(f2)) / 2.0)}
        f = w.rowsBetween(-half, half)
        return {"trend": F.when(F.count(x).over(f) == p, F.avg(x).over(f))}

    indexed, s = with_scalars(indexed, indexed.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(value)).alias("k")),
                              "_fc_chk")
    guard = (F.when(s["k"] != s["n"], F.raise_error(F.lit("seasonal_decompose: series has NULL values")))
              .when(s["n"] < 2 * p, F.raise_error(F.lit("seasonal_decompose: needs two full cycles"))))
    indexed = indexed.withColumn("_fc_guard", guard.cast("double")).drop("_fc_chk")
    t = ordered.halo_window(indexed, build, (), index_col, back=half, ahead=half, chunk_rows=chunk_rows)
    t = t.withColumn("_fc_phase", (F.col(index_col) % p).cast("int")).withColumn(
        "_fc_detr", F.col(value) - F.col("trend"))
    phase = t.groupBy("_fc_phase").agg(F.avg("_fc_detr").alias("_fc_pm"))
    phase, c = with_scalars(phase, phase.agg(F.avg("_fc_pm").alias("c")), "_fc_c")
    phase = phase.select("_fc_phase", (F.col("_fc_pm") - c["c"]).alias("seasonal"))
    # the phase table has exactly ``period`` rows (a parameter), so it is broadcast
    out = t.join(F.broadcast(phase), "_fc_phase", "left")
    out = out.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
    out = out.withColumn("seasonal", F.coalesce(F.col("_fc_guard"), F.col("seasonal")))
    return out.drop("_fc_phase", "_fc_detr", "_fc_guard")


def _lag_sums(df: DataFrame, value: str, nlags: int, order_by, chunk_rows: int) -> DataFrame:
    """One row: ``n`` values and ``p`` ARRAY<DOUBLE>, the sums of products of deviations from
    the mean at lags 0..nlags (NULL values dropped first)."""
    from flowcast.session import cut_lineage
    # read by the mean, the row index and the lag pass: materialise once
    data = cut_lineage(df.where(F.col(value).isNotNull()).select(*order_by, value))
    d, s = with_scalars(data, data.agg(F.avg(value).alias("m")), "_fc_m")
    d = d.withColumn("_fc_d", F.col(value) - s["m"]).drop("_fc_m")
    indexed = ordered.with_row_index(d, order_by, (), RN)
    prods = ordered.halo_window(
        indexed, lambda w: {f"_fc_p{k}": F.col("_fc_d") * F.lag("_fc_d", k).over(w) for k in range(1, nlags + 1)},
        (), RN, back=nlags, chunk_rows=chunk_rows)
    return prods.agg(F.count(F.lit(1)).alias("n"), F.array(
        F.sum(F.col("_fc_d") * F.col("_fc_d")), *[F.sum(f"_fc_p{k}") for k in range(1, nlags + 1)]).alias("p"))


def acf(df: DataFrame, value: str, nlags: int = 48, order_by=("ts",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sample autocorrelation r_k = sum (x_t - m)(x_{t+k} - m) / sum (x_t - m)^2 for
    k = 0..nlags (NULL values dropped first), with the Bartlett 95% band
    1.96 * sqrt((1 + 2 sum_{j<k} r_j^2) / n) (1/n at lag 1, 0 at lag 0)."""
    sums = _lag_sums(df, value, nlags, order_by, chunk_rows)
    long = sums.select(F.posexplode("p").alias("lag", "_fc_p"), F.get("p", F.lit(0)).alias("_fc_p0"), F.col("n").alias("_fc_n")) \
        .withColumn("acf", F.try_divide("_fc_p", "_fc_p0"))
    # the band needs a running sum over at most nlags+1 rows
    w = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    csum = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(w), F.lit(0.0))
    n = F.col("_fc_n").cast("double")
    var = F.when(F.col("lag") == 0, F.lit(0.0)).when(F.col("lag") == 1, 1.0 / n).otherwise((1.0 + 2.0 * csum) / n)
    return long.select("lag", "acf", (F.lit(1.96) * F.sqrt(var)).alias("band"))


def pacf(df: DataFrame, value: str, nlags: int = 48, order_by=("ts",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Partial autocorrelation by the Yule-Walker (Durbin-Levinson) recursion on
    the ACF of E8; band 1.96/sqrt(n). The recursion is a fold over the one array of
    nlags + 1 sums: step k keeps the coefficients of order k and appends the last of them
    to the result. NULL from the first lag at which the recursion has no value."""
    sums = _lag_sums(df, value, nlags, order_by, chunk_rows)
    one = sums.select("n", F.transform("p", lambda x: F.try_divide(x, F.get("p", F.lit(0)))).alias("r"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def step(acc, k):
        phi, r = acc["phi"], F.col("r")
        # r[k-1] .. r[1] against phi, and r[1] .. r[k-1]
        ahead = F.slice(r, F.lit(2), k - 1)
        top = F.get(r, k) - dot(phi, F.reverse(ahead))
        last = F.try_divide(top, F.lit(1.0) - dot(phi, ahead))
        updated = F.zip_with(phi, F.reverse(phi), lambda x, y: x - last * y)
        return F.struct(F.concat(updated, F.array(last)).alias("phi"), F.concat(acc["out"], F.array(last)).alias("out"))

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    lags = F.sequence(F.lit(1), F.lit(nlags)) if nlags else F.array().cast("array<int>")
    folded = one.select("n", F.aggregate(lags, start, step)["out"].alias("out"))
    return folded.select(F.posexplode("out").alias("lag", "pacf"),
                         F.try_divide(F.lit(1.96), F.sqrt(F.col("n").cast("double"))).alias("band"))


def label_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1 (NULL stays NULL). The codes are the
    distributed row index of the distinct values, so even a high-cardinality
    column is ranked without a single-task window."""
    name = name or f"{col}_encoded"
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = ordered.with_row_index(distinct, [col], (), name)
    return df.join(codes, on=col, how="left")
