"""Preparation pipelines (H8-H10): weather preprocessing, feature creation and
the whole traffic(+weather) -> scaled features -> sequences -> split plan.

Plan shape: long readings -> one pivot aggregation (by bucket) -> IQR filter
(scalar subquery) -> bucket join with the weather frame -> distributed row index
-> one halo-window pass for all lags and rolling means -> feature table -> scaler
(scalar subqueries) -> sequences (halo window).

Aggregated intermediates that later steps read several times (the wide traffic
frame, the weather frame before and after preprocessing, the merged series) are
checkpointed into the shared checkpoint folder: later plans start from a small
materialized leaf instead of re-planning and re-running the upstream
aggregations once per reference, and a lost executor only loses work since the
last checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast.functions import weather as wx
from flowcast.functions.calendar import calendar_columns
from flowcast.functions.columns import with_scalars
from flowcast.operators import ordered
from flowcast.operators.clean import drop_incomplete, iqr_filter, quantiles, row_mean_wide
from flowcast.operators.join import align_merge, holiday_flag
from flowcast.operators.ordered import CHUNK_ROWS, RN, full_avg
from flowcast.operators.reshape import sensor_values, to_array, to_wide
from flowcast.operators.scale import zscore_population, zscore_population_array, zscore_sample
from flowcast.operators.timeseries import label_encode, sequences
from flowcast.session import cut_lineage

# Fixed values that must equal the reference for identical results.
# Weather features kept for the enhanced variant, in this order:
WEATHER_FEATURES = ("tmax", "tmin", "prcp", "awnd", "rhav", "temp_range", "feels_like", "wind_chill",
                    "severe_weather", "rush_hour_rain")
# Lags and trailing moving-average windows of avg_speed:
LAGS = (1, 2, 3)
MOVING_AVERAGES = (5, 10, 15, 30)
# Weather change and trend columns (trend window 12 rows):
WEATHER_DIFFS = {"temp_change": "tmax", "precip_change": "prcp", "wind_change": "awnd"}
WEATHER_TRENDS = {"temp_trend": "tmax", "precip_trend": "prcp", "wind_trend": "awnd"}
TREND_WINDOW = 12
# Chronological split ratios:
TRAIN_RATIO, VAL_RATIO = 0.7, 0.15


def preprocess_weather(weather: DataFrame, ts: str = "ts", rush_hours: Sequence[int] = wx.PIPELINE_RUSH_HOURS,
                       fill_cols: Sequence[str] | None = None, chunk_rows: int = CHUNK_ROWS, with_changes: bool = True) -> DataFrame:
    """H8: derived weather columns (G2-G4, G6-G8), changes (E3) and 12-row trends
    (E4), then forward and backward fill. Quantile thresholds are taken before
    the fills, over all rows. ``with_changes=False`` skips the change/trend
    columns (the enhanced pipeline discards them)."""
    # one row index for all that follows; the frame under it is read by the thresholds and the fill
    idx = cut_lineage(ordered.with_row_index(weather, [ts], (), RN))
    w, q = with_scalars(idx, quantiles(idx, ["prcp", "awnd"], [0.95]).select(
        F.col("prcp_q95").alias("p"), F.col("awnd_q95").alias("a")), "_fc_q")
    w = w.withColumns({
        "temp_range": wx.temp_range(),
        "feels_like": wx.feels_like(),
        "wind_chill": wx.wind_chill(),
        "severe_weather": wx.severe_weather("prcp", "awnd", q["p"], q["a"]),
        "hour": F.hour(ts),
        "is_rush_hour": wx.is_rush_hour(ts, rush_hours),
        "rush_hour_rain": wx.rush_hour_rain(ts, "prcp", rush_hours),
    }).drop("_fc_q")

    def build(win):
        cols = {k: F.col(v) - F.lag(F.col(v), 1).over(win) for k, v in WEATHER_DIFFS.items()}
        cols.update({k: full_avg(v, win, TREND_WINDOW) for k, v in WEATHER_TRENDS.items()})
        return cols

    if with_changes:
        w = ordered.halo_window(w, build, (), RN, back=TREND_WINDOW - 1, chunk_rows=chunk_rows)
    fill = list(fill_cols) if fill_cols is not None else [c for c in w.columns if c not in (ts, RN)]
    w = ordered.fill_both(w, fill, [ts], (), RN, chunk_rows)
    return w.drop(RN)


def weather_block(weather: DataFrame, ts: str = "ts", on_constant: str = "error", **kw) -> DataFrame:
    """Weather side of the enhanced variant: H8, the 10 selected features, then
    sample z-scores (ddof=1) fitted on all weather rows (``on_constant``: see
    :func:`zscore_sample`; with daily buckets ``rush_hour_rain`` is constant)."""
    # the statistics and the scaled rows both read the filled frame
    w = cut_lineage(preprocess_weather(weather, ts, fill_cols=WEATHER_FEATURES, with_changes=False,
                                       **kw).select(ts, *WEATHER_FEATURES))
    return zscore_sample(w, WEATHER_FEATURES, on_constant=on_constant)


def traffic_block(readings: DataFrame, sensors: Sequence[str] | None = None, ts: str = "ts",
                  layout: str = "wide") -> DataFrame:
    """Traffic side: wide frame, row mean ``avg_speed`` (NULLs skipped), rows with any
    missing sensor dropped, then the inclusive 1.5 IQR filter on ``avg_speed``.

    ``layout="array"`` keeps the sensors in one column ``values`` (all sensors that occur, in
    order), for numbers of sensors that no frame has columns for; it gives the same rows."""
    if layout == "array":
        rows = to_array(readings, ts=ts).where(F.col("n_present") == F.col("n_sensors"))
        total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
        wide = rows.select(ts, "values", (total / F.col("n_sensors")).alias("avg_speed"))
        return iqr_filter(cut_lineage(wide), "avg_speed")
    sensors = list(sensors) if sensors is not None else sensor_values(readings)
    wide = to_wide(readings, sensors, ts)
    wide = row_mean_wide(wide, sensors, "avg_speed")
    wide = drop_incomplete(wide, [*sensors, "avg_speed"])
    return iqr_filter(cut_lineage(wide), "avg_speed")


def create_features(data: DataFrame, ts: str = "ts", target_source: str = "avg_speed",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """H9: calendar columns, holiday flag, lags 1-3 and full-window moving averages
    5/10/15/30 of ``avg_speed`` (row-based), label encoding of
    ``weather_description`` when present, then drop rows with any NULL."""
    idx = ordered.with_row_index(data, [ts], (), RN)

    def build(win):
        cols = {f"speed_lag{k}": F.lag(F.col(target_source), k).over(win) for k in LAGS}
        cols.update({f"speed_ma{m}": full_avg(target_source, win, m) for m in MOVING_AVERAGES})
        return cols

    out = idx.withColumns(calendar_columns(ts))
    out = holiday_flag(out, ts)
    out = ordered.halo_window(out, build, (), RN, back=max(MOVING_AVERAGES) - 1, chunk_rows=chunk_rows)
    if "weather_description" in data.columns:
        out = label_encode(out, "weather_description", "weather_encoded").drop("weather_description")
    out = out.drop(RN).na.drop("any")
    lead = [c for c in data.columns if c != ts and c != "weather_description"]
    tail = ["hour", "day_of_week", "month", "is_holiday", *[f"speed_lag{k}" for k in LAGS],
            *[f"speed_ma{m}" for m in MOVING_AVERAGES]]
    if "weather_description" in data.columns:
        tail.append("weather_encoded")
    return out.select(ts, *lead, *tail)


def feature_table(readings: DataFrame, weather: DataFrame | None = None, width: str = "5 minutes",
                  sensors: Sequence[str] | None = None, ts: str = "ts", checkpoint: bool = False,
                  chunk_rows: int = CHUNK_ROWS,
                  on_constant: str = "error", layout: str = "wide") -> DataFrame:
    """Unscaled feature table (baseline without ``weather``, enhanced with it)."""
    traffic = traffic_block(readings, sensors, ts, layout)
    if weather is not None:
        w = weather_block(weather, ts, on_constant, chunk_rows=chunk_rows)
        data = align_merge(traffic, w, width, ts)
    else:
        data = traffic
    feats = create_features(data, ts, chunk_rows=chunk_rows)
    return cut_lineage(feats) if checkpoint else feats


def scaled_features(features: DataFrame, target_col: str = "speed_ma30", ts: str = "ts",
                    fit: DataFrame | None = None) -> DataFrame:
    """prepare_data: ``target`` = copy of ``target_col``, then population z-scores of
    every column (target included), fitted on ``fit`` (default: all rows).

    The reference also replaces +/-Inf and forward/backward fills here; the
    feature table has no NULL or non-finite value at this point (sources map
    NaN/Inf to NULL and ``create_features`` drops NULL rows), so those steps are
    identities and are not planned."""
    data = features.withColumn("target", F.col(target_col))
    keep = [c for c in (ts, RN) if c in data.columns]
    cols = [c for c in data.columns if c not in keep]
    arrays = [f.name for f in data.schema.fields if isinstance(f.dataType, T.ArrayType)]
    plain = [F.col(c) if c in arrays else F.col(c).cast("double").alias(c) for c in cols]
    data = data.select(*keep, *plain)
    if fit is not None:
        fit = fit.withColumn("target", F.col(target_col)).select(*plain)
    for c in arrays:
        data = zscore_population_array(data, c, fit=data if fit is None else fit)
    return zscore_population(data, [c for c in cols if c not in arrays], fit=fit)


def prepare_dataset(readings: DataFrame, weather: DataFrame | None = None, length: int = 24, horizon: int = 1,
                    width: str = "5 minutes", sensors: Sequence[str] | None = None, target_col: str = "speed_ma30",
                    fit_on: str = "all", ts: str = "ts", checkpoint: bool = True,
                    chunk_rows: int = CHUNK_ROWS,
                    on_constant: str = "error", layout: str = "wide", task_rows: int | None = None) -> DataFrame:
    """The whole preparation. Returns (seq_idx, ts, y, x, split) where ``x`` is
    the (length x features) window before the label row, ``y`` the scaled target
    ``horizon`` rows after the window, and ``split`` the chronological
    train/val/test label (int(n*0.7), int(n*0.15), rest).

    ``fit_on='all'`` fits the scaler on every row (reference behaviour);
    ``fit_on='train'`` fits it on the rows before the first validation label.
    ``layout='array'`` (see :func:`traffic_block`) gives the same windows for any number of
    sensors. With ``task_rows``, more than that many windows are spread over as many tasks of
    about that size (a window is ``length`` times a row, so what fits one task as rows is too
    much as windows); the feature table, checkpointed, is counted for it."""
    feats = feature_table(readings, weather, width, sensors, ts, checkpoint, chunk_rows,
                          on_constant, layout)
    idx = ordered.with_row_index(feats, [ts], (), RN, count_col="_fc_rows")
    if fit_on == "train":
        n_seq = F.col("_fc_rows") - length - horizon + 1
        last_train_label = F.floor(n_seq.cast("double") * F.lit(TRAIN_RATIO)) + length + horizon - 1
        fit = idx.where(F.col(RN) < last_train_label).drop("_fc_rows")
    else:
        # statistics over all rows straight from the (checkpointed) feature table,
        # not from the indexed frame, so the row index is not recomputed for them
        fit = feats
    scaled = scaled_features(idx.drop("_fc_rows"), target_col, ts, fit=fit.drop(RN) if RN in fit.columns else fit)
    features = [c for c in scaled.columns if c not in (ts, "target", RN)]
    tasks = -(-feats.count() // task_rows) if task_rows else 1
    if tasks > 1:
        # several chunks a task even out what their hashes make of them
        chunk_rows = max(min(chunk_rows, task_rows // 8), length + horizon)
    seqs = sequences(scaled, features, "target", length, horizon, [ts], (), RN, chunk_rows, tasks if tasks > 1 else None)
    # the number of sequences follows from the row count: n - length - horizon + 1
    n_seq_df = feats.agg(F.greatest(F.count(F.lit(1)) - (length + horizon - 1), F.lit(0)).alias("n"))
    seqs, s = with_scalars(seqs, n_seq_df, "_fc_n")
    n = s["n"].cast("double")
    a = F.floor(n * F.lit(TRAIN_RATIO))
    b = F.floor(n * F.lit(VAL_RATIO))
    i = F.col("seq_idx")
    return (seqs.withColumn("split", F.when(i < a, "train").when(i < a + b, "val").otherwise("test"))
                .drop("_fc_n"))
