"""The registered queries (one per SURVEY section 2 operator or operator group).

Fixtures: B1 ``readings_orders`` / B2 ``weather_ship`` daily for the pipeline,
B3 ``readings_events`` for sub-daily profiles, B4 ``readings_users`` for many
series, B6 ``predictions`` and B7 ``history_events`` for evaluation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowcast.functions import weather as WX
from flowcast.functions.buckets import time_bucket
from flowcast.operators import clean as CL
from flowcast.operators import evaluate as EV_
from flowcast.operators import join as JN
from flowcast.operators import ordered as OR
from flowcast.operators import reshape as RS
from flowcast.operators import sketch as SK
from flowcast.operators import stats as ST
from flowcast.operators import timeseries as TS
from flowcast.operators.scale import zscore_population
from flowcast.plans import experiment as XP
from flowcast.plans import forecaster as FC
from flowcast.plans import sqlparts as S
from flowcast.plans.catalog import register, wrap
from flowcast.plans.prepare import (LAGS, MOVING_AVERAGES, TREND_WINDOW, WEATHER_DIFFS, WEATHER_FEATURES, WEATHER_TRENDS,
                                    feature_table, scaled_features)
from flowcast.session import cut_lineage, scratch_path
from flowcast.sources import csv as CSV
from flowcast.sources.fixtures import (EVENT_SENSORS, ORDER_SENSORS, WEATHER_COLUMNS, history_events, predictions,
                                       predictions_of, readings_events, readings_orders, readings_users, weather_events,
                                       weather_ship)
from flowcast.sources.tables import read_table

SENS = ORDER_SENSORS
SENS_COLS = " ".join(SENS)
FEAT_DOUBLES = ("avg_speed " + " ".join(f"speed_lag{k}" for k in LAGS) + " "
                + " ".join(f"speed_ma{m}" for m in MOVING_AVERAGES))
CAL_INTS = "hour day_of_week month is_holiday"


def _year_bounds(src: str) -> tuple[str, str]:
    return f"(SELECT min(year(ts)) FROM {src})", f"(SELECT max(year(ts)) FROM {src})"


def _pipeline_sql(width: str, weather: bool) -> str:
    lo, hi = _year_bounds("mg")
    ctes = [f"ro AS ({S.readings_orders(width)})", S.traffic_block(SENS)]
    if weather:
        ctes += [f"ws AS ({S.weather_ship(width)})", S.weather_block("ws")]
        nn = " AND ".join(f"wz.{c} IS NOT NULL" for c in WEATHER_FEATURES)
        ctes.append(f"mg AS (SELECT trf.*, {', '.join('wz.' + c for c in WEATHER_FEATURES)} "
                    f"FROM trf JOIN wz ON trf.ts = wz.ts WHERE {nn})")
    else:
        ctes.append("mg AS (SELECT * FROM trf)")
    ctes += [S.holidays(lo, hi), S.features_block("mg")]
    cols = _feature_cols(weather) + ["target"]
    ctes.append("fx AS (SELECT *, speed_ma30 AS target FROM ft)")
    ctes.append(S.zscore_pop("fx", cols))
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM zp"


def _feature_cols(weather: bool) -> list[str]:
    cols = [*SENS, "avg_speed"] + (list(WEATHER_FEATURES) if weather else [])
    cols += ["hour", "day_of_week", "month", "is_holiday"]
    cols += [f"speed_lag{k}" for k in LAGS] + [f"speed_ma{m}" for m in MOVING_AVERAGES]
    return cols


# --- H9/H10 feature table (flagship) ---------------------------------------

@register("features_enhanced_daily",
          wrap(_pipeline_sql("1 day", True), " ".join(_feature_cols(True) + ["target"]), "", "ts"),
          ids="A3 B1 B2 B3 B11 B12 C1 C3 C4 G1-G8 H1 H2 H8 H9 H10(feature table) E1 E2")
def features_enhanced_daily(spark, sf):
    """Scaled enhanced feature table: orders traffic + shipping weather, daily buckets."""
    return scaled_features(feature_table(readings_orders(spark, sf, "1 day"), weather_ship(spark, sf, "1 day"),
                                         width="1 day", sensors=SENS, on_constant="zero", checkpoint=True))


@register("features_baseline_daily",
          wrap(_pipeline_sql("1 day", False), " ".join(_feature_cols(False) + ["target"]), "", "ts"),
          ids="A3 B1 B2 B3 B12 C3 C4 G1 H1 H9 E1 E2")
def features_baseline_daily(spark, sf):
    """Scaled baseline feature table (traffic only), daily buckets."""
    return scaled_features(feature_table(readings_orders(spark, sf, "1 day"), None, width="1 day", sensors=SENS,
                                         checkpoint=True))


@register("features_enhanced_weekly",
          wrap(_pipeline_sql("7 days", True), " ".join(_feature_cols(True) + ["target"]), "", "ts"),
          ids="H9 H10 C1 (7-day buckets)")
def features_enhanced_weekly(spark, sf):
    """Scaled enhanced feature table on 7-day buckets (the smoke-test query)."""
    return scaled_features(feature_table(readings_orders(spark, sf, "7 days"), weather_ship(spark, sf, "7 days"),
                                         width="7 days", sensors=SENS, on_constant="zero", checkpoint=True))



def _hourly_pipeline_sql() -> tuple[str, list[str]]:
    lo, hi = _year_bounds("mg")
    cols = [*EVENT_SENSORS, "avg_speed", *WEATHER_FEATURES, "hour", "day_of_week", "month", "is_holiday",
            *[f"speed_lag{k}" for k in LAGS], *[f"speed_ma{m}" for m in MOVING_AVERAGES], "target"]
    ctes = [f"re AS ({S.readings_events('6 hours')})", S.traffic_block(EVENT_SENSORS, "re"),
            f"ws AS ({S.weather_events('6 hours')})", S.weather_block("ws"),
            "mg AS (SELECT trf.*, wz.* EXCLUDE (ts) FROM trf JOIN wz ON trf.ts = wz.ts)",
            S.holidays(lo, hi), S.features_block("mg"), "fx AS (SELECT *, speed_ma30 AS target FROM ft)",
            S.zscore_pop("fx", cols)]
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM zp", cols


_HOURLY_SQL, _HOURLY_COLS = _hourly_pipeline_sql()


@register("features_enhanced_6h", wrap(_HOURLY_SQL, " ".join(_HOURLY_COLS), "", "ts", digits=4), digits=4,
          ids="H8 H9 H10 G7 G8 (sub-daily)")
def features_enhanced_6h(spark, sf):
    """Scaled enhanced feature table of the event series and sub-daily weather, six-hour
    buckets; a column that does not vary (the least value, where events are many) becomes 0."""
    return scaled_features(feature_table(readings_events(spark, sf, "6 hours"), weather_events(spark, sf, "6 hours"),
                                         width="6 hours", sensors=EVENT_SENSORS, on_constant="zero", checkpoint=True))


# =============================================================================
# Shared Spark inputs
# =============================================================================


EV = EVENT_SENSORS
WCOLS = " ".join(WEATHER_COLUMNS)


def _orders_wide(spark, sf):
    return RS.to_wide(readings_orders(spark, sf, "1 day"), SENS)


def _events_wide(spark, sf, width="5 minutes"):
    return RS.to_wide(readings_events(spark, sf, width), EV)


def _weather(spark, sf):
    return weather_ship(spark, sf, "1 day")


SQL_RO = f"ro AS ({S.readings_orders('1 day')})"
SQL_WS = f"ws AS ({S.weather_ship('1 day')})"


def _wide_sql(src: str, sensors, name: str) -> str:
    piv = ", ".join(f"max(CASE WHEN sensor_id = '{s}' THEN value END) AS \"{s}\"" for s in sensors)
    return f"{name} AS (SELECT ts, {piv} FROM {src} GROUP BY ts)"


SQL_OW = _wide_sql("ro", SENS, "ow")


def _ev_sql(width: str) -> str:
    return f"re AS ({S.readings_events(width)}), {_wide_sql('re', EV, 'ew')}"


# =============================================================================
# A: sources, reshaping, profiling
# =============================================================================

@register("to_wide_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM ow", SENS_COLS, "", "ts"), ids="A3")
def to_wide_orders(spark, sf):
    """Long readings -> wide (one column per sensor), missing cells NULL."""
    return _orders_wide(spark, sf)


@register("to_long_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM (UNPIVOT ow ON {', '.join(chr(34) + s + chr(34) for s in SENS)} "
                                 f"INTO NAME sensor_id VALUE value) u", "value", "", "ts sensor_id"), ids="A3")
def to_long_orders(spark, sf):
    """Wide -> long round trip (NULL cells of the wide frame dropped, as the source had none)."""
    return RS.to_long(_orders_wide(spark, sf), SENS).where(F.col("value").isNotNull())


_DAILY = "time_bucket(INTERVAL '1 day', o_orderdate)"


@register("to_wide_duplicates", wrap(
    "SELECT ts, " + ", ".join(f"max(CASE WHEN s = '{s}' THEN v END) AS \"{s}\"" for s in SENS)
    + f" FROM (SELECT {_DAILY} AS ts, o_orderstatus AS s, o_totalprice AS v FROM orders) r GROUP BY ts", SENS_COLS, "", "ts"), ids="A3")
def to_wide_duplicates(spark, sf):
    """Raw readings, many a day and sensor, to wide: the largest of each cell."""
    o = read_table(spark, sf, "orders", ["o_orderdate", "o_orderstatus", "o_totalprice"])
    long = o.select(time_bucket("o_orderdate", "1 day").alias("ts"), F.col("o_orderstatus").alias("sensor_id"),
                    F.col("o_totalprice").cast("double").alias("value"))
    return RS.to_wide(long, SENS, duplicates="max")


@register("to_array_events", wrap(f"""WITH re AS ({S.readings_events('1 hour')}),
i AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS pos FROM (SELECT DISTINCT sensor_id FROM re) d),
t AS (SELECT ts, count(value) AS n_present FROM re GROUP BY ts)
SELECT t.ts, i.pos, re.value, t.n_present, (SELECT count(*) FROM i) AS n_sensors
FROM t CROSS JOIN i LEFT JOIN re ON re.ts = t.ts AND re.sensor_id = i.sensor_id""", "value", "pos n_present n_sensors", "ts"), ids="A3")
def to_array_events(spark, sf):
    """Long -> one array a timestamp by dense sensor index, listed cell by cell."""
    wide = RS.to_array(readings_events(spark, sf, "1 hour"))
    return wide.select("ts", F.posexplode("values").alias("pos", "value"), "n_present", "n_sensors")


@register("profile_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT count(*) AS n_rows, 4 AS n_columns, "
                                 f"min(ts) AS ts_min, max(ts) AS ts_max FROM ow", "", "n_rows n_columns", "ts_min ts_max"),
          ids="A6")
def profile_orders(spark, sf):
    """Row count, column count and time range of the wide traffic frame."""
    return RS.profile(_orders_wide(spark, sf))


# =============================================================================
# B: cleaning
# =============================================================================

@register("row_mean_events", wrap(f"WITH re AS ({S.readings_events('1 hour')}) "
                                  f"SELECT ts, avg(value) AS avg_speed FROM re GROUP BY ts", "avg_speed", "", "ts"),
          ids="B1")
def row_mean_events(spark, sf):
    """Mean over sensors per hourly bucket (NULLs skipped)."""
    return CL.row_mean(readings_events(spark, sf, "1 hour"))


@register("complete_rows_events", wrap(f"WITH {_ev_sql('1 hour')} SELECT * FROM ew WHERE "
                                       + " AND ".join(f'"{s}" IS NOT NULL' for s in EV),
                                       " ".join(EV), "", "ts"), ids="B2")
def complete_rows_events(spark, sf):
    """Hourly buckets where every event type has a value."""
    return CL.drop_incomplete(_events_wide(spark, sf, "1 hour"))


@register("iqr_filter_orders", wrap(f"WITH {SQL_RO}, {S.traffic_block(SENS)} SELECT * FROM trf",
                                    SENS_COLS + " avg_speed", "", "ts", digits=2), digits=2, ids="B1 B2 B3")
def iqr_filter_orders(spark, sf):
    """Traffic cleaning: row mean, complete rows, inclusive 1.5 IQR filter."""
    from flowcast.plans.prepare import traffic_block
    return traffic_block(readings_orders(spark, sf, "1 day"), SENS)


def _clip_sql(cols):
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    sel = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), "
                    f"q3_{c} + 1.5 * (q3_{c} - q1_{c})) END AS {c}" for c in cols)
    return f"WITH {SQL_WS}, b AS (SELECT {q} FROM ws) SELECT ts, {sel} FROM ws, b"


@register("iqr_clip_weather", wrap(_clip_sql(WEATHER_COLUMNS), WCOLS, "", "ts"), ids="B4")
def iqr_clip_weather(spark, sf):
    """Winsorise every weather column to its 1.5 IQR fences."""
    return CL.iqr_clip(_weather(spark, sf), WEATHER_COLUMNS)


@register("null_profile_events",
          wrap(f"WITH {_ev_sql('5 minutes')}, l AS ("
               + " UNION ALL ".join(f"SELECT '{s}' AS \"column\", count_if(\"{s}\" IS NULL) AS n_null, count(*) AS n FROM ew"
                                    for s in EV)
               + ") SELECT \"column\", n_null, sum(n_null) OVER () AS total_null, n - n_null AS n_remaining FROM l",
               "", "n_null total_null n_remaining", "column"), ids="B5")
def null_profile_events(spark, sf):
    """Missing cells per event-type column of the 5-minute wide frame."""
    return CL.null_profile(_events_wide(spark, sf), list(EV))


def _interp_sql(cols, src="ew"):
    parts = []
    for c in cols:
        pv = f"last_value(CASE WHEN \"{c}\" IS NOT NULL THEN \"{c}\" END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        pt = f"last_value(CASE WHEN \"{c}\" IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        nv = f"first_value(CASE WHEN \"{c}\" IS NOT NULL THEN \"{c}\" END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        nt = f"first_value(CASE WHEN \"{c}\" IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        parts.append(f"CASE WHEN \"{c}\" IS NOT NULL THEN \"{c}\" WHEN ({pv}) IS NOT NULL AND ({nv}) IS NOT NULL "
                     f"THEN ({pv}) + (({nv}) - ({pv})) * CAST(epoch_us(ts) - ({pt}) AS DOUBLE) / CAST(({nt}) - ({pt}) AS DOUBLE) "
                     f"WHEN ({pv}) IS NOT NULL THEN ({pv}) END AS \"{c}\"")
    return f"SELECT ts, {', '.join(parts)} FROM {src}"


def _fill_sql(cols, src, forward=True):
    fn, frame = (("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW") if forward
                 else ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    sel = ", ".join(f"{fn}(\"{c}\" IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN {frame}) AS \"{c}\"" for c in cols)
    return f"SELECT ts, {sel} FROM {src}"


EVC = " ".join(EV)


@register("interpolate_events", wrap(f"WITH {_ev_sql('5 minutes')} {_interp_sql(EV)}", EVC, "", "ts"), ids="B6")
def interpolate_events(spark, sf):
    """Time-linear interpolation of gaps in the 5-minute wide frame."""
    return OR.interpolate_time(_events_wide(spark, sf), list(EV))


@register("ffill_events", wrap(f"WITH {_ev_sql('5 minutes')} {_fill_sql(EV, 'ew')}", EVC, "", "ts"), ids="B7")
def ffill_events(spark, sf):
    """Forward fill of the 5-minute wide frame."""
    return OR.fill_forward(_events_wide(spark, sf), list(EV))


@register("bfill_events", wrap(f"WITH {_ev_sql('5 minutes')} {_fill_sql(EV, 'ew', False)}", EVC, "", "ts"), ids="B8")
def bfill_events(spark, sf):
    """Backward fill of the 5-minute wide frame."""
    return OR.fill_backward(_events_wide(spark, sf), list(EV))


@register("fill_policy_events", wrap(f"WITH {_ev_sql('5 minutes')}, ip AS ({_interp_sql(EV)}) {_fill_sql(EV, 'ip', False)}",
                                     EVC, "", "ts"), ids="B9")
def fill_policy_events(spark, sf):
    """Interpolate doubles, then backward fill what is left (leading gaps)."""
    return CL.fill_policy(_events_wide(spark, sf))


@register("inf_to_null_lineitem",
          wrap("SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(pow(l_discount, -1.0)) THEN pow(l_discount, -1.0) END AS inv_discount "
               "FROM lineitem", "inv_discount", "l_orderkey l_linenumber"), ids="B10")
def inf_to_null_lineitem(spark, sf):
    """1/discount is +Inf for zero discounts; Inf becomes NULL."""
    from flowcast.sources.tables import read_table
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount"])
    return CL.inf_to_null(li.select("l_orderkey", "l_linenumber", F.pow("l_discount", F.lit(-1.0)).alias("inv_discount")))


@register("select_features_weather", wrap(f"WITH {SQL_WS} SELECT ts, tmax, prcp, awnd FROM ws", "tmax prcp awnd", "", "ts"),
          ids="B11")
def select_features_weather(spark, sf):
    """Projection pruned to the scan."""
    return CL.select_features(_weather(spark, sf), ["ts", "tmax", "prcp", "awnd"])


@register("target_copy_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT ts, \"P\", \"P\" AS target FROM ow", "P target", "", "ts"),
          ids="B12")
def target_copy_orders(spark, sf):
    """The target column as a copy of the last column."""
    return CL.with_target(_orders_wide(spark, sf).select("ts", "P"), "P")


@register("select_by_correlation_weather",
          wrap(f"WITH {SQL_WS}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, tmax) AS corr FROM ws"
                                                             for c in WEATHER_COLUMNS if c != "tmax")
               + ") SELECT feature, corr FROM c WHERE abs(corr) >= 0.1", "corr", "", "feature"), ids="B13")
def select_by_correlation_weather(spark, sf):
    """Weather features with |corr(feature, tmax)| >= 0.1."""
    return CL.select_by_correlation(_weather(spark, sf), "tmax", [c for c in WEATHER_COLUMNS if c != "tmax"], 0.1)


# =============================================================================
# C: joins
# =============================================================================

@register("concat_time_orders_weather",
          wrap(f"WITH {SQL_RO}, {SQL_OW}, {SQL_WS} SELECT coalesce(ow.ts, ws.ts) AS ts, ow.\"F\", ow.\"O\", ow.\"P\", ws.tmax, ws.prcp "
               f"FROM ow FULL OUTER JOIN ws ON ow.ts = ws.ts", "F O P tmax prcp", "", "ts"), ids="C2")
def concat_time_orders_weather(spark, sf):
    """Full outer join of traffic and weather on the timestamp."""
    return JN.concat_time(_orders_wide(spark, sf), _weather(spark, sf).select("ts", "tmax", "prcp"))


_HOL_ORDERS = S.holidays("(SELECT min(year(ts)) FROM ow)", "(SELECT max(year(ts)) FROM ow)")


@register("holiday_calendar_orders",
          wrap(f"WITH {SQL_RO}, {SQL_OW}, {_HOL_ORDERS} SELECT CAST(d AS TIMESTAMP) AS date FROM hol", "", "", "date"),
          ids="C4")
def holiday_calendar_orders(spark, sf):
    """US federal holidays (with observed days) for the years of the traffic data."""
    return JN.holiday_calendar(_orders_wide(spark, sf))


@register("holiday_flag_orders",
          wrap(f"WITH {SQL_RO}, {SQL_OW}, {_HOL_ORDERS} SELECT ts, CASE WHEN CAST(ts AS DATE) IN (SELECT d FROM hol) "
               f"THEN 1 ELSE 0 END AS is_holiday FROM ow", "", "is_holiday", "ts"), ids="C3")
def holiday_flag_orders(spark, sf):
    """Holiday flag per traffic bucket by a broadcast calendar join."""
    return JN.holiday_flag(_orders_wide(spark, sf).select("ts"))


@register("align_merge_orders_weather",
          wrap(f"WITH {SQL_RO}, {SQL_OW}, {SQL_WS} SELECT ow.*, ws.tmax, ws.prcp, ws.awnd FROM ow JOIN ws ON ow.ts = ws.ts "
               f"WHERE ow.\"F\" IS NOT NULL AND ow.\"O\" IS NOT NULL AND ow.\"P\" IS NOT NULL", "F O P tmax prcp awnd", "", "ts",
               digits=4), digits=4, ids="C1")
def align_merge_orders_weather(spark, sf):
    """Resample both frames to days, inner join on the bucket, drop incomplete rows."""
    return JN.align_merge(_orders_wide(spark, sf), _weather(spark, sf).select("ts", "tmax", "prcp", "awnd"), "1 day")


_PRED = S.predictions()


@register("join_predictions",
          wrap(f"WITH p AS ({_PRED}) SELECT b.ts, b.model, b.y_true, b.y_pred AS y_base, e.y_pred AS y_enh FROM p b JOIN p e "
               f"ON b.ts = e.ts AND b.model = e.model AND b.variant = 'baseline' AND e.variant = 'enhanced'",
               "y_true y_base y_enh", "", "ts model", digits=4), digits=4, ids="C5")
def join_predictions(spark, sf):
    """Align truth, baseline and enhanced forecasts on (ts, model)."""
    return JN.join_predictions(predictions(spark, sf))


@register("common_times_orders_weather",
          wrap(f"WITH {SQL_RO}, {SQL_OW}, {SQL_WS} SELECT ts FROM ow INTERSECT SELECT ts FROM ws", "", "", "ts"), ids="F6")
def common_times_orders_weather(spark, sf):
    """Timestamps present in both traffic and weather."""
    return JN.common_times(_orders_wide(spark, sf), _weather(spark, sf))


@register("union_all_predictions",
          wrap(f"WITH p AS ({_PRED}) SELECT * FROM p WHERE variant = 'baseline' UNION ALL SELECT * FROM p WHERE variant = 'enhanced'",
               "y_true y_pred", "", "ts model variant", digits=4), digits=4, ids="F5")
def union_all_predictions(spark, sf):
    """Row-wise union of the per-variant prediction sets."""
    p = predictions(spark, sf)
    return JN.union_all([p.where(F.col("variant") == "baseline"), p.where(F.col("variant") == "enhanced")])


# =============================================================================
# D: aggregations and statistics
# =============================================================================

@register("resample_events_hourly",
          wrap(f"WITH {_ev_sql('5 minutes')}, eh AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, "
               + ", ".join(f'avg("{s}") AS "{s}"' for s in EV) + " FROM ew GROUP BY 1), "
               "sp AS (SELECT unnest(generate_series((SELECT min(ts) FROM eh), (SELECT max(ts) FROM eh), "
               "INTERVAL 1 HOUR)) AS ts) SELECT sp.ts, " + ", ".join(f'eh."{s}"' for s in EV)
               + " FROM sp LEFT JOIN eh ON sp.ts = eh.ts", EVC, "", "ts"), ids="D1")
def resample_events_hourly(spark, sf):
    """Hourly means of the 5-minute frame, empty hours emitted as NULL rows."""
    return ST.resample_mean(_events_wide(spark, sf), "1 hour")


@register("resample_events_hourly_keyed",
          wrap(f"""WITH a AS ({S.readings_events('1 hour')}),
sp AS (SELECT sensor_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM a GROUP BY sensor_id)
SELECT sp.ts, sp.sensor_id, a.value FROM sp LEFT JOIN a ON a.ts = sp.ts AND a.sensor_id = sp.sensor_id""", "value", "",
               "ts sensor_id"), ids="D1")
def resample_events_hourly_keyed(spark, sf):
    """Hourly means of the long readings per sensor, each sensor's empty hours as NULL rows."""
    from flowcast.sources.tables import read_table
    ev = read_table(spark, sf, "events", ["ts", "event_type", "value"]).withColumnRenamed("event_type", "sensor_id")
    return ST.resample_mean(ev, "1 hour", ["value"], keys=["sensor_id"])


@register("daily_mean_events",
          wrap(f"WITH re AS ({S.readings_events('5 minutes')}), t AS (SELECT ts, avg(value) AS m FROM re GROUP BY ts) "
               f"SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, avg(m) AS daily_mean FROM t GROUP BY 1", "daily_mean", "", "day"),
          ids="D2")
def daily_mean_events(spark, sf):
    """Mean over sensors per 5-minute bucket, then per day."""
    return ST.daily_mean(readings_events(spark, sf))


@register("hourly_profile_events",
          wrap(f"WITH re AS ({S.readings_events('5 minutes')}), s AS (SELECT hour(ts) AS hour, sensor_id, avg(value) AS m "
               f"FROM re GROUP BY 1, 2) SELECT hour, avg(m) AS mean_value FROM s GROUP BY 1", "mean_value", "hour"), ids="D3")
def hourly_profile_events(spark, sf):
    """Hour of day -> mean of the per-sensor means."""
    return ST.hourly_profile(readings_events(spark, sf))


@register("weekday_profile_orders",
          wrap(f"WITH {SQL_RO}, s AS (SELECT isodow(ts) - 1 AS day_of_week, sensor_id, avg(value) AS m FROM ro GROUP BY 1, 2) "
               f"SELECT day_of_week, avg(m) AS mean_value FROM s GROUP BY 1", "mean_value", "day_of_week", digits=4),
          digits=4, ids="D4")
def weekday_profile_orders(spark, sf):
    """Weekday (Monday=0) -> mean of the per-sensor means."""
    return ST.weekday_profile(readings_orders(spark, sf, "1 day"))


@register("sensor_grid_users",
          wrap("WITH s AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, avg(value) AS mean_value FROM events GROUP BY 1), "
               "o AS (SELECT *, row_number() OVER (ORDER BY sensor_id) - 1 AS i FROM s) "
               "SELECT sensor_id, mean_value, i // 9 AS grid_row, i % 9 AS grid_col FROM o", "mean_value", "grid_row grid_col",
               "sensor_id"), ids="D5")
def sensor_grid_users(spark, sf):
    """Per-sensor means placed on a 9-column grid (one sensor per user)."""
    return ST.sensor_grid(readings_users(spark, sf))


def _qbin_sql(by, value, q=10):
    probs = ", ".join(str(k / q) for k in range(q + 1))
    return f"""WITH {SQL_WS}, e AS (SELECT quantile_cont({by}, [{probs}]) AS e FROM ws),
b AS (SELECT 1 + len(list_filter(e[2:{q}], lambda x: {by} > x)) AS bin, {value} AS v FROM ws, e WHERE {by} IS NOT NULL),
g AS (SELECT bin, avg(v) AS mean_value, stddev_samp(v) AS std_value, count(v) AS n FROM b GROUP BY bin),
sp AS (SELECT range AS bin FROM range(1, {q + 1}))
SELECT sp.bin, e.e[sp.bin] AS lower, e.e[sp.bin + 1] AS upper, g.mean_value, g.std_value, coalesce(g.n, 0) AS n
FROM sp CROSS JOIN e LEFT JOIN g ON sp.bin = g.bin"""


@register("quantile_bins_rhav_prcp", wrap(_qbin_sql("rhav", "prcp"), "lower upper mean_value std_value", "bin n"), ids="D6")
def quantile_bins_rhav_prcp(spark, sf):
    """Precipitation mean/std/count per humidity decile (qcut semantics)."""
    return ST.quantile_bin_stats(_weather(spark, sf), "rhav", "prcp", 10)


@register("trend_line_bins",
          wrap(f"WITH q AS ({_qbin_sql('rhav', 'prcp')}) SELECT regr_slope(mean_value, bin - 1) AS slope, "
               f"regr_intercept(mean_value, bin - 1) AS intercept FROM q", "slope intercept"), ids="D7")
def trend_line_bins(spark, sf):
    """Least-squares line through the decile means (x = bin index from 0)."""
    q = ST.quantile_bin_stats(_weather(spark, sf), "rhav", "prcp", 10)
    return ST.trend_line(q.withColumn("x", (F.col("bin") - 1).cast("double")), "x", "mean_value")


@register("corr_traffic_tmax",
          wrap(f"WITH {SQL_RO}, t AS (SELECT ts, avg(value) AS avg_speed FROM ro GROUP BY ts), {SQL_WS} "
               f"SELECT corr(t.avg_speed, ws.tmax) AS corr FROM t JOIN ws ON t.ts = ws.ts", "corr"), ids="D8")
def corr_traffic_tmax(spark, sf):
    """Pearson correlation of daily traffic with TMAX."""
    t = CL.row_mean(readings_orders(spark, sf, "1 day"))
    return ST.corr_pair(t.join(_weather(spark, sf), "ts"), "avg_speed", "tmax")


_CM = ("tmax", "tmin", "prcp", "awnd", "rhav", "rhmn", "rhmx")


@register("corr_matrix_weather",
          wrap(f"WITH {SQL_WS} " + " UNION ALL ".join(
              f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END AS corr FROM ws"
              for a in _CM for b in _CM), "corr", "", "col_a col_b"), ids="D9")
def corr_matrix_weather(spark, sf):
    """Pairwise Pearson matrix of the weather columns (one aggregation), long form."""
    return ST.corr_matrix(_weather(spark, sf), _CM)


_HOURS = [f"{e}_{h:02d}" for e in EV for h in range(24)]


def _hour_cells_sql() -> str:
    cells = ", ".join(f"avg(CASE WHEN event_type = '{n[:-3]}' AND hour(ts) = {int(n[-2:])} THEN value END) AS \"{n}\"" for n in _HOURS)
    return f"hw AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, {cells} FROM events GROUP BY 1)"


@register("corr_matrix_hours", f"""WITH {_hour_cells_sql()}, l AS (UNPIVOT hw ON {', '.join(chr(34) + n + chr(34) for n in _HOURS)} INTO NAME c VALUE v),
q AS (SELECT a.c AS col_a, b.c AS col_b, count(*) AS n, corr(a.v, b.v) AS r, stddev_pop(a.v) AS sa, stddev_pop(b.v) AS sb
      FROM l a JOIN l b ON a.day = b.day GROUP BY 1, 2),
n AS (SELECT unnest([{', '.join(repr(x) for x in _HOURS)}]) AS c)
SELECT x.c AS col_a, y.c AS col_b, round(CASE WHEN sa > 1e-9 AND sb > 1e-9 AND isfinite(r) THEN r END * (1 + 1e-12), 4) + 0.0::DOUBLE AS corr
FROM n x CROSS JOIN n y LEFT JOIN q ON q.col_a = x.c AND q.col_b = y.c""", digits=4, ids="D9")
def corr_matrix_hours(spark, sf):
    """120 columns (event type and hour of the day, one row a day, many cells missing):
    14,400 pairs by blocks of rows."""
    ev = read_table(spark, sf, "events", ["ts", "event_type", "value"])
    cell = F.concat_ws("_", "event_type", F.lpad(F.hour("ts").cast("string"), 2, "0"))
    long = ev.groupBy(time_bucket("ts", "1 day").alias("ts"), cell.alias("sensor_id")).agg(F.avg("value").alias("value"))
    return ST.corr_matrix(RS.to_wide(long, _HOURS), _HOURS)


def _hist_sql(col, bins, density=False):
    dens = ", coalesce(c.count, 0) * 1.0 / (n * ((hi - lo) / {b})) AS density".format(b=float(bins)) if density else ""
    return f"""WITH {SQL_WS}, d AS (SELECT {col} AS x FROM ws WHERE {col} IS NOT NULL),
s AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, count(x) AS n FROM d),
i0 AS (SELECT x, least(greatest(CAST(floor((x - lo) * ({float(bins)} / (hi - lo))) AS INT), 0), {bins - 1}) AS i, lo, hi FROM d, s),
i1 AS (SELECT x, CASE WHEN x < lo + i * ((hi - lo) / {float(bins)}) THEN i - 1 ELSE i END AS i, lo, hi FROM i0),
i2 AS (SELECT CASE WHEN i != {bins - 1} AND x >= (CASE WHEN i + 1 >= {bins} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {float(bins)}) END)
             THEN i + 1 ELSE i END AS bin FROM i1),
c AS (SELECT bin, count(*) AS count FROM i2 GROUP BY bin),
sp AS (SELECT range AS bin FROM range(0, {bins}))
SELECT sp.bin, lo + sp.bin * ((hi - lo) / {float(bins)}) AS lower,
       CASE WHEN sp.bin + 1 >= {bins} THEN hi ELSE lo + (sp.bin + 1) * ((hi - lo) / {float(bins)}) END AS upper,
       coalesce(c.count, 0) AS count{dens}
FROM sp CROSS JOIN s LEFT JOIN c ON sp.bin = c.bin"""


@register("histogram_prcp", wrap(_hist_sql("prcp", 30), "lower upper", "bin count"), ids="D10")
def histogram_prcp(spark, sf):
    """30-bin equal-width histogram of precipitation, empty bins kept."""
    return ST.histogram(_weather(spark, sf), "prcp", 30)


@register("histogram_density_awnd", wrap(_hist_sql("awnd", 50, True), "lower upper density", "bin count"), ids="D10")
def histogram_density_awnd(spark, sf):
    """50-bin density histogram of wind speed."""
    return ST.histogram(_weather(spark, sf), "awnd", 50, density=True)


@register("describe_tmax",
          wrap(f"WITH {SQL_WS} SELECT count(tmax) AS n, avg(tmax) AS mean, stddev_samp(tmax) AS std, min(tmax) AS min, "
               f"max(tmax) AS max FROM ws", "mean std min max", "n"), ids="D11")
def describe_tmax(spark, sf):
    """Count, mean, sample std, min, max of TMAX."""
    return ST.describe(_weather(spark, sf), "tmax", ddof=1)


_KDE_SQL = wrap(f"""WITH {SQL_WS}, d AS (SELECT tmax AS x FROM ws WHERE tmax IS NOT NULL),
s AS (SELECT min(x) AS mn, max(x) AS mx, count(x) AS n, stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2) AS h FROM d),
g AS (SELECT range AS k FROM range(0, 200)),
p AS (SELECT g.k, s.mn - 3.0 * s.h + g.k * ((s.mx - s.mn + 6.0 * s.h) / 199.0) AS gx, s.h, s.n FROM g, s)
SELECT CAST(p.k AS INT) AS k, p.gx AS x, sum(exp(-0.5 * ((p.gx - d.x) / p.h) * ((p.gx - d.x) / p.h))) / (p.n * p.h * sqrt(2 * pi())) AS density
FROM p, d GROUP BY p.k, p.gx, p.h, p.n""", "x density", "k")


@register("kde_tmax", _KDE_SQL, ids="D12")
def kde_tmax(spark, sf):
    """Gaussian KDE of TMAX on 200 grid points (Scott bandwidth), by binned moments."""
    return ST.kde(_weather(spark, sf), "tmax", 200)


@register("kde_prcp_exact", _KDE_SQL.replace("SELECT tmax AS x FROM ws WHERE tmax", "SELECT prcp AS x FROM ws WHERE prcp"), ids="D12")
def kde_prcp_exact(spark, sf):
    """KDE of the precipitation, every row at every point."""
    return ST.kde(_weather(spark, sf), "prcp", 200, method="exact")


@register("kde_prcp", _KDE_SQL.replace("SELECT tmax AS x FROM ws WHERE tmax", "SELECT prcp AS x FROM ws WHERE prcp"), ids="D12")
def kde_prcp(spark, sf):
    """KDE of the precipitation, a skewed column with many equal values, by binned moments."""
    return ST.kde(_weather(spark, sf), "prcp", 200)


def _traffic_weather(spark, sf):
    t = CL.row_mean(readings_orders(spark, sf, "1 day"))
    return t.join(_weather(spark, sf), "ts")


SQL_TW = (f"{SQL_RO}, t AS (SELECT ts, avg(value) AS avg_speed FROM ro GROUP BY ts), {SQL_WS}, "
          f"tw AS (SELECT t.avg_speed, ws.* FROM t JOIN ws ON t.ts = ws.ts)")
_RAIN_SQL = ("CASE WHEN prcp IS NULL THEN NULL WHEN prcp <= 0.0 THEN 'No Rain' WHEN prcp <= 0.1 THEN 'Light' "
             "WHEN prcp <= 1.0 THEN 'Moderate' ELSE 'Heavy' END")


@register("box_stats_rain",
          wrap(f"""WITH {SQL_TW}, d AS (SELECT {_RAIN_SQL} AS rain_category, avg_speed AS v FROM tw),
q AS (SELECT rain_category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM d WHERE v IS NOT NULL AND rain_category IS NOT NULL GROUP BY 1)
SELECT d.rain_category, q1, median, q3, count(v) AS n,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
  count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM d JOIN q ON d.rain_category = q.rain_category WHERE v IS NOT NULL GROUP BY d.rain_category, q1, median, q3""",
               "q1 median q3 whisker_lo whisker_hi", "n n_outliers", "rain_category", digits=4), digits=4, ids="D13 G9")
def box_stats_rain(spark, sf):
    """Box statistics of daily traffic per rain category."""
    tw = _traffic_weather(spark, sf).withColumn("rain_category", WX.rain_category())
    return ST.box_stats(tw, "rain_category", "avg_speed")


@register("quantile_threshold_prcp",
          wrap(f"WITH {SQL_WS} SELECT quantile_cont(prcp, 0.95) AS threshold FROM ws", "threshold"), ids="D14")
def quantile_threshold_prcp(spark, sf):
    """Exact 95th percentile of precipitation."""
    return ST.quantile_threshold(_weather(spark, sf), "prcp", 0.95)


_SKETCH_P = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@register("sketch_ranks_prices", wrap(f"""WITH p AS (SELECT unnest({list(_SKETCH_P)}) AS p)
SELECT l_returnflag, p, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS greatest, true AS within
FROM lineitem, p GROUP BY 1, 2""", "p least greatest", "n", "l_returnflag within"), ids="D13 D14")
def sketch_ranks_prices(spark, sf):
    """Price quantiles by return flag from sketches of (flag, line status), rolled up: count,
    least and greatest price, and whether the true rank of each quantile is off by no more
    than twice the sketch's 99 % error."""
    rows = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    fine = SK.quantile_sketches(rows, ["l_extendedprice"], ["l_returnflag", "l_linestatus"])
    # read twice, and random: made once
    sketches = cut_lineage(SK.merge_sketches(fine, ["l_returnflag"]))
    names = [f"q{i}" for i in range(len(_SKETCH_P))]
    found = SK.sketch_quantiles(sketches.withColumn("n", SK.sketch_count()), _SKETCH_P, names)
    # one row a flag goes to the rows; by a shuffle, all rows of a flag would meet in one task
    placed = rows.join(F.broadcast(found.withColumnRenamed("l_returnflag", "flag")),
                       F.col("l_returnflag").eqNullSafe(F.col("flag")))
    x = F.col("l_extendedprice")
    ranks = placed.groupBy("l_returnflag", "n", *names).agg(*[
        F.array(F.count_if(x < F.col(q)), F.count_if(x <= F.col(q))).alias(f"r{q}") for q in names])
    bound = 2 * SK.rank_error()

    def row(p, q):
        lo, hi = F.get(f"r{q}", F.lit(0)) / F.col("n"), F.get(f"r{q}", F.lit(1)) / F.col("n")
        return F.struct(F.lit(p).alias("p"), ((lo <= p + bound) & (hi >= p - bound)).alias("within"))

    return ranks.select("l_returnflag", "n", F.col("q0").alias("least"), F.col(names[-1]).alias("greatest"),
                        F.inline(F.array(*[row(p, q) for p, q in zip(_SKETCH_P, names)])))


@register("box_stats_rain_sketch",
          wrap(f"""WITH {SQL_TW}, d AS (SELECT {_RAIN_SQL} AS rain_category, avg_speed AS v FROM tw),
q AS (SELECT rain_category, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.75) AS q3
      FROM d WHERE v IS NOT NULL AND rain_category IS NOT NULL GROUP BY 1),
w AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT d.rain_category, q1, median, q3, count(v) AS n, min(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_lo,
  max(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_hi, count_if(NOT (v >= lo AND v <= hi)) AS n_outliers
FROM d JOIN w ON d.rain_category = w.rain_category WHERE v IS NOT NULL GROUP BY d.rain_category, q1, median, q3""",
               "q1 median q3 whisker_lo whisker_hi", "n n_outliers", "rain_category", digits=4), digits=4, ids="D13 G9")
def box_stats_rain_sketch(spark, sf):
    """Box statistics with quartiles from sketches; these groups of days are small enough for
    a sketch to hold every value, so the quartiles are the exact discrete ones."""
    tw = _traffic_weather(spark, sf).withColumn("rain_category", WX.rain_category())
    return ST.box_stats(tw, "rain_category", "avg_speed", method="sketch")


@register("any_rush_hour_rain",
          wrap(f"WITH {SQL_WS} SELECT coalesce(bool_or(coalesce(hour(ts) IN (7, 8, 9, 17, 18, 19) AND prcp > 0, false)), false) "
               f"AS any_true FROM ws", "", "", "any_true"), ids="D15")
def any_rush_hour_rain(spark, sf):
    """Whether any rush-hour bucket had rain."""
    return ST.any_true(_weather(spark, sf), F.hour("ts").isin(list(WX.REPORT_RUSH_HOURS)) & (F.col("prcp") > 0))


@register("any_rush_hour_rain_hourly",
          wrap(f"WITH ws AS ({S.weather_events('1 hour')}) SELECT coalesce(bool_or(coalesce(hour(ts) IN (7, 8, 9, 17, 18, 19) "
               f"AND prcp > 0, false)), false) AS any_true FROM ws", "", "", "any_true"), ids="D15")
def any_rush_hour_rain_hourly(spark, sf):
    """Whether any rush-hour bucket of the hourly weather had rain."""
    return ST.any_true(weather_events(spark, sf), F.hour("ts").isin(list(WX.REPORT_RUSH_HOURS)) & (F.col("prcp") > 0))


def _moments_sql(corrected: bool):
    r = "y_true - y_pred" if corrected else "y_pred - y_true"
    sk = "skewness(r)" if corrected else "skewness(r) * (n - 2) / sqrt(n * (n - 1))"
    ku = "kurtosis(r)" if corrected else "(kurtosis(r) * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)"
    return f"""WITH p AS ({_PRED}), d AS (SELECT model, variant, {r} AS r FROM p),
m AS (SELECT model, variant, count(r) AS n, avg(r) AS mean, stddev_pop(r) AS std, skewness(r), kurtosis(r) FROM d GROUP BY 1, 2)
SELECT model, variant, n, mean, std, {sk.replace('skewness(r)', '"skewness(r)"')} AS skewness,
  {ku.replace('kurtosis(r)', '"kurtosis(r)"')} AS kurtosis FROM m"""


@register("residual_moments_corrected", wrap(_moments_sql(True), "mean std skewness kurtosis", "n", "model variant", digits=4),
          digits=4, ids="D16 K2")
def residual_moments_corrected(spark, sf):
    """Residual (actual - pred) mean, population std, bias-corrected skew/excess kurtosis per run."""
    return ST.residual_moments(predictions(spark, sf), corrected=True, by=["model", "variant"])


@register("residual_moments_population", wrap(_moments_sql(False), "mean std skewness kurtosis", "n", "model variant", digits=4),
          digits=4, ids="D16")
def residual_moments_population(spark, sf):
    """Residual (pred - actual) moments with population skew/excess kurtosis per run."""
    return ST.residual_moments(predictions(spark, sf), corrected=False, by=["model", "variant"])


@register("scatter_pairs_traffic_weather",
          wrap(f"WITH {SQL_TW} SELECT ts, feature, weather_value, avg_speed AS traffic FROM (UNPIVOT (SELECT ts, avg_speed, tmax, prcp, awnd, rhav FROM tw) "
               f"ON tmax, prcp, awnd, rhav INTO NAME feature VALUE weather_value) u", "weather_value traffic", "", "ts feature", digits=4),
          digits=4, ids="D17")
def scatter_pairs_traffic_weather(spark, sf):
    """(ts, weather feature, value, traffic) pairs for the four scatter plots."""
    return ST.scatter_pairs(_traffic_weather(spark, sf))


@register("distinct_descriptions",
          wrap(f"WITH d AS ({S.weather_ship('1 day', True)}) SELECT DISTINCT weather_description FROM d", "", "", "weather_description"),
          ids="D18")
def distinct_descriptions(spark, sf):
    """Distinct weather descriptions (B5 fixture)."""
    return ST.distinct_values(weather_ship(spark, sf, "1 day", with_description=True), "weather_description")


# =============================================================================
# G: weather flags and levels
# =============================================================================

def _flags_sql(ws: str) -> str:
    return f"""WITH {ws}, q AS (SELECT quantile_cont(prcp, 0.95) AS p95, quantile_cont(prcp, 0.9) AS p90,
  quantile_cont(awnd, 0.9) AS a90, quantile_cont(tmax, 0.9) AS t90, quantile_cont(tmin, 0.1) AS n10, avg(awnd) AS am,
  min(tmax) AS lo, max(tmax) AS hi FROM ws)
SELECT ts, CASE WHEN prcp > 0 THEN 1 ELSE 0 END AS is_raining, {_RAIN_SQL} AS rain_category,
  CASE WHEN tmax IS NULL THEN NULL WHEN tmax <= lo + (hi - lo) / 5.0 * 1.0 THEN 1 WHEN tmax <= lo + (hi - lo) / 5.0 * 2.0 THEN 2
       WHEN tmax <= lo + (hi - lo) / 5.0 * 3.0 THEN 3 WHEN tmax <= lo + (hi - lo) / 5.0 * 4.0 THEN 4 ELSE 5 END AS temp_level,
  CASE WHEN coalesce(prcp > 0, false) AND coalesce(awnd > am, false) THEN 1 ELSE 0 END AS rainy_and_windy,
  CASE WHEN coalesce(prcp > p95, false) THEN 1 ELSE 0 END AS heavy_rain,
  CASE WHEN coalesce(prcp > p90, false) OR coalesce(awnd > a90, false) OR coalesce(tmax > t90, false) OR coalesce(tmin < n10, false)
       THEN 1 ELSE 0 END AS extreme_weather,
  CASE WHEN hour(ts) IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS is_rush_hour
FROM ws, q"""


_FLAG_INTS = "is_raining temp_level rainy_and_windy heavy_rain extreme_weather is_rush_hour"


def _flags(w):
    from flowcast.functions.columns import with_scalars
    w, t = with_scalars(w, CL.quantiles(w, ["prcp", "awnd", "tmax", "tmin"], [0.1, 0.9, 0.95]), "_t")
    w, q = with_scalars(w, w.agg(F.avg("awnd").alias("am"), F.min("tmax").alias("lo"), F.max("tmax").alias("hi")), "_q")
    return w.select(
        "ts", WX.is_raining().alias("is_raining"), WX.rain_category().alias("rain_category"),
        WX.equal_width_level("tmax", q["lo"], q["hi"], 5).alias("temp_level"),
        WX.rainy_and_windy("prcp", "awnd", q["am"]).alias("rainy_and_windy"),
        WX.heavy_rain("prcp", t["prcp_q95"]).alias("heavy_rain"),
        WX.extreme_weather("prcp", "awnd", "tmax", "tmin", t["prcp_q90"], t["awnd_q90"], t["tmax_q90"],
                           t["tmin_q10"]).alias("extreme_weather"),
        WX.is_rush_hour("ts").alias("is_rush_hour"))


@register("weather_flags", wrap(_flags_sql(SQL_WS), "", _FLAG_INTS, "ts rain_category"), ids="G5 G9 G10 G11 G12 G13")
def weather_flags(spark, sf):
    """Rain flag, rain category, 5 equal-width TMAX levels, rainy-and-windy, heavy rain
    and extreme weather; exact thresholds from one distributed pass."""
    return _flags(_weather(spark, sf))


SQL_WE = f"ws AS ({S.weather_events('1 hour')})"


@register("weather_flags_hourly", wrap(_flags_sql(SQL_WE), "", _FLAG_INTS, "ts rain_category"), ids="G5 G7 G9-G13")
def weather_flags_hourly(spark, sf):
    """The flags on hourly weather, where the rush-hour flag varies."""
    return _flags(weather_events(spark, sf))


def _derived(w):
    from flowcast.functions.columns import with_scalars
    w, q = with_scalars(w, CL.quantiles(w, ["prcp", "awnd"], [0.95]), "_q")
    return w.select("ts", "tmax", WX.temp_range().alias("temp_range"), WX.feels_like().alias("feels_like"),
                    WX.wind_chill().alias("wind_chill"),
                    WX.severe_weather("prcp", "awnd", q["prcp_q95"], q["awnd_q95"]).alias("severe_weather"),
                    WX.rush_hour_rain("ts").alias("rush_hour_rain"))


@register("weather_derived",
          wrap(f"WITH {SQL_WS}, {S.weather_block('ws')} SELECT * EXCLUDE (tmin, prcp, awnd, rhav) FROM wf",
               "tmax temp_range feels_like wind_chill", "severe_weather rush_hour_rain", "ts"), ids="G2 G3 G4 G6")
def weather_derived(spark, sf):
    """Temperature range, feels-like, wind chill and severe weather."""
    return _derived(_weather(spark, sf))


@register("weather_derived_hourly",
          wrap(f"WITH {SQL_WE}, {S.weather_block('ws')} SELECT * EXCLUDE (tmin, prcp, awnd, rhav) FROM wf",
               "tmax temp_range feels_like wind_chill", "severe_weather rush_hour_rain", "ts"), ids="G2 G3 G4 G6 G8")
def weather_derived_hourly(spark, sf):
    """The derived columns on hourly weather, where rush-hour rain varies."""
    return _derived(weather_events(spark, sf))


@register("calendar_events",
          wrap("SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month FROM events", "",
               "event_id hour day_of_week month"), ids="G1")
def calendar_events(spark, sf):
    """Hour, weekday (Monday=0) and month per event."""
    from flowcast.functions.calendar import calendar_columns
    from flowcast.sources.tables import read_table
    ev = read_table(spark, sf, "events", ["event_id", "ts"])
    return ev.select("event_id", *[c.alias(k) for k, c in calendar_columns("ts").items()])


# =============================================================================
# E: window and time-series operators
# =============================================================================

_USR = "SELECT ts, CAST(user_id AS VARCHAR) AS sensor_id, value, event_id FROM events"
_UW = "OVER (PARTITION BY sensor_id ORDER BY ts, event_id"


@register("time_index_events",
          wrap("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events", "", "event_id rn"), ids="E11")
def time_index_events(spark, sf):
    """Global 0-based position of every event in (ts, event_id) order, without a
    single-partition window."""
    from flowcast.sources.tables import read_table
    ev = read_table(spark, sf, "events", ["event_id", "ts"])
    return OR.with_row_index(ev, ["ts", "event_id"]).select("event_id", "rn")


@register("row_index_customers",
          wrap("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS rn FROM customer", "", "c_custkey rn"),
          ids="E11")
def row_index_customers(spark, sf):
    """Position of every customer by name (strings with one long shared prefix)."""
    from flowcast.sources.tables import read_table
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    return OR.with_row_index(c, ["c_name", "c_custkey"]).select("c_custkey", "rn")


@register("lags_users",
          wrap(f"WITH u AS ({_USR}) SELECT event_id, sensor_id, " + ", ".join(f"lag(value, {k}) {_UW}) AS value_lag{k}" for k in LAGS)
               + " FROM u", " ".join(f"value_lag{k}" for k in LAGS), "event_id", "sensor_id"), ids="E1")
def lags_users(spark, sf):
    """Per-series row lags 1-3 (one series per user)."""
    out = OR.lag_columns(readings_users(spark, sf), "value", LAGS, ["ts", "event_id"], ["sensor_id"])
    return out.select("event_id", "sensor_id", *[f"value_lag{k}" for k in LAGS])


def _full_ma_sql(x, m, part=_UW):
    frame = f"{part} ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {m} THEN avg({x}) {frame} END"


@register("rolling_means_users",
          wrap(f"WITH u AS ({_USR}) SELECT event_id, sensor_id, " + ", ".join(f"{_full_ma_sql('value', m)} AS value_ma{m}"
                                                                            for m in MOVING_AVERAGES) + " FROM u",
               " ".join(f"value_ma{m}" for m in MOVING_AVERAGES), "event_id", "sensor_id"), ids="E2")
def rolling_means_users(spark, sf):
    """Per-series full-window trailing means 5/10/15/30."""
    out = OR.rolling_means(readings_users(spark, sf), "value", MOVING_AVERAGES, ["ts", "event_id"], ["sensor_id"])
    return out.select("event_id", "sensor_id", *[f"value_ma{m}" for m in MOVING_AVERAGES])


@register("diffs_trends_weather",
          wrap(f"WITH {SQL_WS} SELECT ts, tmax - lag(tmax) OVER (ORDER BY ts) AS temp_change, "
               f"prcp - lag(prcp) OVER (ORDER BY ts) AS precip_change, awnd - lag(awnd) OVER (ORDER BY ts) AS wind_change, "
               + ", ".join(f"{_full_ma_sql(c, 12, 'OVER (ORDER BY ts')} AS {n}" for n, c in
                           (("temp_trend", "tmax"), ("precip_trend", "prcp"), ("wind_trend", "awnd"))) + " FROM ws",
               "temp_change precip_change wind_change temp_trend precip_trend wind_trend", "", "ts"), ids="E3 E4")
def diffs_trends_weather(spark, sf):
    """Day-over-day changes and 12-row trends of TMAX, PRCP and AWND."""
    def build(win):  # one window pass for both
        cols = {k: F.col(v) - F.lag(v, 1).over(win) for k, v in WEATHER_DIFFS.items()}
        return cols | {k: OR.full_avg(v, win, TREND_WINDOW) for k, v in WEATHER_TRENDS.items()}
    w = OR.halo_window(OR.with_row_index(_weather(spark, sf), ["ts"]), build, back=TREND_WINDOW - 1)
    return w.select("ts", "temp_change", "precip_change", "wind_change", "temp_trend", "precip_trend", "wind_trend")


_PW_CH = ("temp_change", "precip_change", "wind_change", "temp_trend", "precip_trend", "wind_trend")


def _pw_sql():
    trend = lambda c: _full_ma_sql(c, 12, "OVER (ORDER BY ts")
    bf = ", ".join(f"first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
                   for c in _PW_CH)
    return f"""WITH {SQL_WS}, {S.weather_block('ws')},
pw AS (SELECT *, hour(ts) AS hour, CASE WHEN hour(ts) IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END AS is_rush_hour,
  tmax - lag(tmax) OVER (ORDER BY ts) AS temp_change, prcp - lag(prcp) OVER (ORDER BY ts) AS precip_change,
  awnd - lag(awnd) OVER (ORDER BY ts) AS wind_change,
  {trend('tmax')} AS temp_trend, {trend('prcp')} AS precip_trend, {trend('awnd')} AS wind_trend FROM wf)
SELECT * EXCLUDE ({', '.join(_PW_CH)}), {bf} FROM pw"""


@register("preprocess_weather_daily",
          wrap(_pw_sql(), "tmax tmin prcp awnd rhav temp_range feels_like wind_chill " + " ".join(_PW_CH),
               "severe_weather rush_hour_rain hour is_rush_hour", "ts"), ids="H8 B7 B8")
def preprocess_weather_daily(spark, sf):
    """Weather preprocessing before selection: derived columns, changes, trends, then
    forward and backward fill (leading change/trend NULLs take the first value)."""
    from flowcast.plans.prepare import preprocess_weather
    w = _weather(spark, sf).select("ts", "tmax", "tmin", "prcp", "awnd", "rhav")
    return preprocess_weather(w)


def _seq_sql(length=24):
    cols = _feature_cols(False)
    rowsum = " + ".join(f'"{c}"' for c in cols)
    base = _pipeline_sql("1 day", False)
    return f"""WITH sc AS ({base}),
r AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn, {rowsum} AS rs FROM sc),
s AS (SELECT rn - {length} AS seq_idx, ts, target AS y,
        sum(rs) OVER (ORDER BY ts ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING) AS x_sum,
        lag("{cols[0]}", {length}) OVER (ORDER BY ts) AS x_first, lag("{cols[-1]}", 1) OVER (ORDER BY ts) AS x_last FROM r),
k AS (SELECT * FROM s WHERE seq_idx >= 0), n AS (SELECT count(*) AS n FROM k)
SELECT seq_idx, ts, y, x_sum, x_first, x_last,
  CASE WHEN seq_idx < floor(n * 0.7::DOUBLE) THEN 'train'
       WHEN seq_idx < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM k, n"""


@register("sequences_baseline_daily", wrap(_seq_sql(), "y x_sum x_first x_last", "seq_idx", "ts split"),
          ids="E5 H3 H10")
def sequences_baseline_daily(spark, sf):
    """Whole preparation to 24-row sequences with the chronological split; each
    sequence summarised by the sum, first and last element of its window."""
    from flowcast.plans.prepare import prepare_dataset
    p = prepare_dataset(readings_orders(spark, sf, "1 day"), None, length=24, width="1 day", sensors=SENS)
    flat = F.flatten("x")
    return p.select("seq_idx", "ts", "y", F.aggregate(flat, F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    F.col("x")[0][0].alias("x_first"), F.element_at(F.element_at("x", -1), -1).alias("x_last"), "split")


@register("split_sizes_daily",
          wrap(f"WITH q AS ({_seq_sql()}) SELECT split, count(*) AS n FROM q GROUP BY split", "", "n", "split"), ids="H3")
def split_sizes_daily(spark, sf):
    """Sizes of the chronological train/val/test split (int(n*0.7), int(n*0.15), rest)."""
    from flowcast.plans.prepare import prepare_dataset
    p = prepare_dataset(readings_orders(spark, sf, "1 day"), None, length=24, width="1 day", sensors=SENS)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("random_split_orders",
          wrap(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) - 1 AS r,
  count(*) OVER () AS n FROM orders),
h AS (SELECT *, ceil(n * {1.0 - 0.7!r}::DOUBLE) AS held FROM r)
SELECT o_orderkey, CASE WHEN r < ceil(held * {0.15 / 0.3!r}::DOUBLE) THEN 'test' WHEN r < held THEN 'val' ELSE 'train' END AS split
FROM h""", "", "o_orderkey", "split"), ids="H4")
def random_split_orders(spark, sf):
    """Exact-size seeded shuffle split of the orders (30% held out, half of it test)."""
    from flowcast.operators.scale import random_split
    from flowcast.sources.tables import read_table
    o = read_table(spark, sf, "orders", ["o_orderkey"])
    return random_split(o, "o_orderkey", seed=42).select("o_orderkey", "split")


def _hourly_series_sql():
    return f"WITH re AS ({S.readings_events('1 hour')}), s AS (SELECT ts, avg(value) AS x FROM re GROUP BY ts)"


def _hourly_series(spark, sf):
    return CL.row_mean(readings_events(spark, sf, "1 hour"), name="x")


@register("seasonal_decompose_hourly",
          wrap(f"""{_hourly_series_sql()},
r AS (SELECT ts, x, row_number() OVER (ORDER BY ts) - 1 AS rn,
  CASE WHEN count(x) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) = 24
        AND count(x) OVER (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) = 24
       THEN (avg(x) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)
           + avg(x) OVER (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 2.0 END AS trend FROM s),
p AS (SELECT rn % 24 AS ph, avg(x - trend) AS pm FROM r GROUP BY 1),
c AS (SELECT ph, pm - (SELECT avg(pm) FROM p) AS seasonal FROM p)
SELECT ts, x, trend, seasonal, x - trend - seasonal AS resid FROM r JOIN c ON r.rn % 24 = c.ph""",
               "x trend seasonal resid", "", "ts"), ids="E7")
def seasonal_decompose_hourly(spark, sf):
    """Additive decomposition of the hourly event series, period 24."""
    out = TS.seasonal_decompose(_hourly_series(spark, sf), "x", 24)
    return out.select("ts", "x", "trend", "seasonal", "resid")


def _acf_sql(nlags=48):
    lags = ", ".join(f"lag(d, {k}) OVER (ORDER BY ts) AS l{k}" for k in range(1, nlags + 1))
    sums = " UNION ALL ".join(["SELECT 0 AS lag, sum(d * d) AS num FROM l"]
                              + [f"SELECT {k} AS lag, sum(d * l{k}) AS num FROM l" for k in range(1, nlags + 1)])
    return f"""{_hourly_series_sql()},
d AS (SELECT ts, x - (SELECT avg(x) FROM s WHERE x IS NOT NULL) AS d FROM s WHERE x IS NOT NULL),
l AS (SELECT ts, d, {lags} FROM d),
a AS ({sums}),
r AS (SELECT lag, num / (SELECT sum(d * d) FROM l) AS acf FROM a),
n AS (SELECT count(*) AS n FROM d)
SELECT lag, acf, 1.96 * sqrt(CASE WHEN lag = 0 THEN 0.0 WHEN lag = 1 THEN 1.0 / n
  ELSE (1.0 + 2.0 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / n END) AS band
FROM r, n"""


@register("acf_hourly", wrap(_acf_sql(), "acf band", "lag"), ids="E8")
def acf_hourly(spark, sf):
    """Autocorrelation of the hourly event series up to lag 48 with the Bartlett band."""
    return TS.acf(_hourly_series(spark, sf), "x", 48)


def _pacf_sql(nlags: int = 48) -> str:
    """Durbin-Levinson over the ACF list as a recursive CTE (phi_kk is the PACF at lag k)."""
    return f"""WITH RECURSIVE a AS ({_acf_sql(nlags)}),
rl AS (SELECT list(acf ORDER BY lag) AS r FROM a),
dl(k, phi) AS (
  SELECT 1, [r[2]] FROM rl
  UNION ALL
  SELECT k + 1, list_transform(phi, lambda x, j: x - pkk * phi[k + 1 - j]) || [pkk]
  FROM (SELECT dl.k, dl.phi,
               (rl.r[dl.k + 2] - list_sum(list_transform(dl.phi, lambda x, j: x * rl.r[dl.k + 2 - j])))
             / (1.0 - list_sum(list_transform(dl.phi, lambda x, j: x * rl.r[j + 1]))) AS pkk
        FROM dl, rl WHERE dl.k < {nlags}) s),
n AS ({_hourly_series_sql()} SELECT count(x) AS n FROM s)
SELECT lag, pacf, 1.96 / sqrt(n) AS band FROM (SELECT 0 AS lag, 1.0 AS pacf UNION ALL SELECT k, phi[k] FROM dl) p, n"""


@register("pacf_hourly", wrap(_pacf_sql(), "pacf band", "lag"), ids="E9")
def pacf_hourly(spark, sf):
    """Partial autocorrelation (Durbin-Levinson on the distributed ACF)."""
    return TS.pacf(_hourly_series(spark, sf), "x", 48)


@register("label_encode_descriptions",
          wrap(f"WITH d AS ({S.weather_ship('1 day', True)}) SELECT ts, weather_description, "
               f"dense_rank() OVER (ORDER BY weather_description) - 1 AS weather_encoded FROM d", "", "weather_encoded",
               "ts weather_description"), ids="E10")
def label_encode_descriptions(spark, sf):
    """Sorted distinct descriptions -> 0..k-1."""
    w = weather_ship(spark, sf, "1 day", with_description=True).select("ts", "weather_description")
    return TS.label_encode(w, "weather_description", "weather_encoded")


@register("cumulative_abs_error",
          wrap(f"WITH p AS ({_PRED}) SELECT ts, model, variant, sum(abs(y_pred - y_true)) OVER (PARTITION BY model, variant "
               f"ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_abs_error FROM p", "cum_abs_error", "",
               "ts model variant", digits=2), digits=2, ids="E6")
def cumulative_abs_error(spark, sf):
    """Running sum of absolute errors per (model, variant) in time order."""
    out = TS.cumulative_abs_error(predictions(spark, sf))
    return out.select("ts", "model", "variant", "cum_abs_error")


# =============================================================================
# F: sort, limit, top-k
# =============================================================================

@register("sort_events", wrap("SELECT event_id, ts, value FROM events ORDER BY ts, event_id", "value", "event_id", "ts"), ids="F1")
def sort_events(spark, sf):
    """Range-partitioned global sort by (ts, event_id)."""
    from flowcast.operators.sort import sort_time
    from flowcast.sources.tables import read_table
    return sort_time(read_table(spark, sf, "events", ["event_id", "ts", "value"]), "ts", ["event_id"])


@register("top_features_tmax",
          wrap(f"WITH {SQL_WS}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, tmax)) AS importance FROM ws"
                                                             for c in _CM if c != "tmax")
               + ") SELECT * FROM c ORDER BY importance DESC, feature LIMIT 3", "importance", "", "feature"), ids="F2")
def top_features_tmax(spark, sf):
    """The 3 weather features most correlated (in absolute value) with TMAX."""
    from flowcast.operators.sort import top_features
    cm = ST.corr_matrix(_weather(spark, sf), _CM)
    imp = cm.where((F.col("col_b") == "tmax") & (F.col("col_a") != "tmax")).select(
        F.col("col_a").alias("feature"), F.abs("corr").alias("importance"))
    return top_features(imp, 3)


@register("head_rows_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM ow ORDER BY ts LIMIT 100", SENS_COLS, "", "ts", digits=4),
          digits=4, ids="F3")
def head_rows_orders(spark, sf):
    """First 100 traffic buckets in time order."""
    from flowcast.operators.sort import head_rows
    return head_rows(_orders_wide(spark, sf), 100)


@register("tail_rows_orders", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM ow ORDER BY ts DESC LIMIT 100", SENS_COLS, "", "ts", digits=4),
          digits=4, ids="F4")
def tail_rows_orders(spark, sf):
    """Last 100 traffic buckets in time order."""
    from flowcast.operators.sort import tail_rows
    return tail_rows(_orders_wide(spark, sf), 100)


# =============================================================================
# K: forecast evaluation and reporting (B6 predictions, B7 history)
# =============================================================================



def _met_sql(src="p", by="model, variant", extra=""):
    e = "(y_pred - y_true)"
    return f"""SELECT {by}, count({e}) AS n, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae,
  CASE WHEN var_pop(y_true) * count({e}) > 0 THEN 1.0 - sum({e} * {e}) / (var_pop(y_true) * count({e}))
       WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  avg(abs(CASE WHEN y_true <> 0 THEN {e} / y_true END)) * 100.0 AS mape,
  count_if(y_true = 0) AS n_zero_actual FROM {src} {extra} GROUP BY {by}"""


_MET_D = "rmse mae r2 mape"
_MET = f"p AS ({_PRED}), m AS ({_met_sql()})"


def _metrics(spark, sf):
    return EV_.regression_metrics(predictions(spark, sf))


def _imp_sql():
    rel = lambda c: f"CASE WHEN b.{c} <> 0 THEN (b.{c} - e.{c}) / b.{c} * 100.0 END"
    return (f"imp AS (SELECT b.model, {rel('rmse')} AS rmse_improvement, {rel('mae')} AS mae_improvement, "
            f"(e.r2 - b.r2) * 100.0 AS r2_improvement, {rel('mape')} AS mape_improvement FROM m b JOIN m e "
            f"ON b.model = e.model AND b.variant = 'baseline' AND e.variant = 'enhanced')")


_IMP_D = "rmse_improvement mae_improvement r2_improvement mape_improvement"


@register("regression_metrics", wrap(f"WITH {_MET} SELECT * FROM m", _MET_D, "n n_zero_actual", "model variant"), ids="K1 K2")
def regression_metrics(spark, sf):
    """RMSE, MAE, R2 and MAPE (zero actuals skipped and counted) per (model, variant)."""
    return _metrics(spark, sf)


@register("metrics_original_units", wrap(f"WITH {_MET} SELECT * FROM m", _MET_D, "n n_zero_actual", "model variant"),
          ids="H1 K1")
def metrics_original_units(spark, sf):
    """Forecasts scaled per variant by the truth's z-score, as a model emits them, brought
    back to original units and scored: the metrics of the unscaled forecasts."""
    p = predictions(spark, sf)
    fits = {v: p.where(F.col("variant") == v) for v in XP.VARIANTS}
    parts = [zscore_population(f, ["y_true", "y_pred"], f, of="y_true") for f in fits.values()]
    return EV_.regression_metrics(XP.original_units(parts[0].unionByName(parts[1]), fits, "y_true"))


@register("combined_loss",
          wrap(f"""WITH p AS ({_PRED}), g AS (SELECT model, variant, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  avg(abs(y_true - y_pred)) AS mae, avg(abs((y_true - y_pred) / (y_true + 1e-7))) * 100.0 AS mape_eps,
  1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true) + 1e-7) AS r2_eps FROM p GROUP BY 1, 2)
SELECT *, 0.3 * rmse + 0.3 * mae + 0.2 * mape_eps * 0.01 + 0.2 * (1.0 - r2_eps) AS combined_loss FROM g""",
               "rmse mae mape_eps r2_eps combined_loss", "", "model variant"), ids="K3 K4")
def combined_loss(spark, sf):
    """The combined training loss and its epsilon-stabilised parts per run."""
    return EV_.combined_loss(predictions(spark, sf))


@register("improvements", wrap(f"WITH {_MET}, {_imp_sql()} SELECT * FROM imp", _IMP_D, "", "model"), ids="K5")
def improvements(spark, sf):
    """Relative improvements (RMSE, MAE, MAPE) and R2 gain in points per model."""
    return EV_.improvements(_metrics(spark, sf))


@register("best_model",
          wrap(f"WITH {_MET}, {_imp_sql()} SELECT model, (rmse_improvement + mae_improvement + r2_improvement) / 3.0 AS score "
               f"FROM imp ORDER BY score DESC, model LIMIT 1", "score", "", "model"), ids="K6")
def best_model(spark, sf):
    """Model with the highest mean of RMSE, MAE and R2 improvement."""
    return EV_.best_model(EV_.improvements(_metrics(spark, sf)))


def _condition_sql(pred: str, ws: str) -> str:
    return f"""WITH p AS ({pred}), {ws},
q AS (SELECT quantile_cont(prcp, 0.9) AS p90, quantile_cont(awnd, 0.9) AS a90, quantile_cont(tmax, 0.9) AS t90,
             quantile_cont(tmin, 0.1) AS n10 FROM ws),
x AS (SELECT ts, CASE WHEN coalesce(prcp > p90, false) OR coalesce(awnd > a90, false) OR coalesce(tmax > t90, false)
                        OR coalesce(tmin < n10, false) THEN 1 ELSE 0 END AS ext FROM ws, q),
j AS (SELECT p.*, x.ext FROM p LEFT JOIN x ON p.ts = x.ts),
t AS (SELECT *, 'overall' AS condition FROM j
      UNION ALL SELECT *, 'extreme' FROM j WHERE ext = 1
      UNION ALL SELECT *, 'normal' FROM j WHERE coalesce(ext, 0) = 0
      UNION ALL SELECT *, 'rush_hour' FROM j WHERE hour(ts) IN (7, 8, 9, 17, 18, 19))
{_met_sql('t', 'model, variant, condition')}"""


@register("metrics_by_condition", wrap(_condition_sql(_PRED, SQL_WS), _MET_D, "n n_zero_actual", "model variant condition"),
          ids="K7")
def metrics_by_condition(spark, sf):
    """Metrics overall, under extreme weather and in normal weather (daily: no rush hour)."""
    return EV_.metrics_by_condition(predictions(spark, sf), _weather(spark, sf))


@register("metrics_by_condition_hourly",
          wrap(_condition_sql(S.predictions(S.readings_events("1 hour"), S.weather_events("1 hour")), SQL_WE),
               _MET_D, "n n_zero_actual", "model variant condition", digits=4), digits=4, ids="K7")
def metrics_by_condition_hourly(spark, sf):
    """The same on hourly series, with the rush-hour rows."""
    w = weather_events(spark, sf)
    return EV_.metrics_by_condition(predictions_of(readings_events(spark, sf, "1 hour"), w), w)


@register("performance_table",
          wrap(f"""WITH {_MET}, {_imp_sql()},
t AS (SELECT model, """ + ", ".join(f"printf('%.4f', max(CASE WHEN variant = '{v}' THEN {m} END)) AS {v}_{m}"
                                    for m in ("rmse", "mae", "r2") for v in ("baseline", "enhanced")) + """ FROM m GROUP BY model)
SELECT t.*, """ + ", ".join(f"printf('%.2f%%', imp.{m}_improvement) AS {m}_improvement" for m in ("rmse", "mae", "r2"))
               + " FROM t JOIN imp ON t.model = imp.model", "", "",
               "model " + " ".join(f"{v}_{m}" for m in ("rmse", "mae", "r2") for v in ("baseline", "enhanced"))
               + " rmse_improvement mae_improvement r2_improvement"), ids="K8 G14")
def performance_table(spark, sf):
    """Formatted baseline/enhanced metrics and improvements per model."""
    m = _metrics(spark, sf)
    return EV_.performance_table(m, EV_.improvements(m))


@register("improvement_matrix",
          wrap(f"WITH {_MET}, {_imp_sql()} SELECT model, rmse_improvement AS RMSE, mae_improvement AS MAE, r2_improvement AS R2, "
               f"mape_improvement AS MAPE FROM imp", "RMSE MAE R2 MAPE", "", "model"), ids="K9")
def improvement_matrix(spark, sf):
    """Model x metric matrix of improvements."""
    return EV_.improvement_matrix(EV_.improvements(_metrics(spark, sf)))


@register("radar_ratios",
          wrap(f"WITH {_MET} SELECT b.model, e.rmse / b.rmse AS rmse_ratio, e.mae / b.mae AS mae_ratio, b.r2 / e.r2 AS r2_ratio, "
               f"e.mape / b.mape AS mape_ratio FROM m b JOIN m e ON b.model = e.model AND b.variant = 'baseline' AND e.variant = 'enhanced'",
               "rmse_ratio mae_ratio r2_ratio mape_ratio", "", "model"), ids="K10")
def radar_ratios(spark, sf):
    """Enhanced/baseline ratio per metric (baseline/enhanced for R2)."""
    return EV_.radar_ratios(_metrics(spark, sf))


_PAIRED = (f"p AS ({_PRED}), pr AS (SELECT b.ts, b.model, b.y_true, b.y_pred AS y_base, e.y_pred AS y_enh FROM p b JOIN p e "
           f"ON b.ts = e.ts AND b.model = e.model AND b.variant = 'baseline' AND e.variant = 'enhanced')")


def _t_test_sql(pairs: str) -> str:
    """K11 over CTE ``pairs`` (model, y_true, y_base, y_enh). The p-value is the finite
    trigonometric series of Student's t for whole degrees of freedom: with cos and sin of
    atan(t / sqrt(dof)), a product of ratios of odd and even numbers a term."""
    return f"""WITH {pairs}, d AS (SELECT model, abs(y_base - y_true) - abs(y_enh - y_true) AS d FROM pr),
g AS (SELECT model, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff FROM d GROUP BY model),
t AS (SELECT model, n, mean_diff, sd_diff, mean_diff / nullif(sd_diff / sqrt(n), 0) AS t_stat, n - 1 AS dof FROM g),
a AS (SELECT *, atan(abs(t_stat) / sqrt(dof)) AS th FROM t WHERE t_stat IS NOT NULL AND dof >= 1),
k AS (SELECT model, th, dof, dof % 2 AS odd, unnest(range(CAST(greatest((dof - 2 - dof % 2) // 2 + 1, 0) AS BIGINT))) AS j FROM a),
c AS (SELECT model, exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln((2.0::DOUBLE * j - 1 + odd) / (2.0::DOUBLE * j + odd)) END
        + CASE WHEN j = 0 THEN odd * ln(cos(th)) ELSE 2 * ln(cos(th)) END) OVER (PARTITION BY model ORDER BY j)) AS term FROM k),
s AS (SELECT model, sum(term) AS total FROM c GROUP BY model)
SELECT t.model, t.n, t.mean_diff, t.sd_diff, t.t_stat, t.dof AS dof,
  CASE WHEN th IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - CASE WHEN t.dof % 2 = 0 THEN sin(th) * coalesce(total, 0)
       ELSE 2 / pi() * (th + sin(th) * coalesce(total, 0)) END) END AS p_value
FROM t LEFT JOIN a USING (model) LEFT JOIN s USING (model)"""


@register("paired_error_test", wrap(_t_test_sql(_PAIRED),
                                    "mean_diff sd_diff t_stat p_value", "n dof", "model", digits=4), digits=4, ids="K11")
def paired_error_test(spark, sf):
    """Paired t statistic of absolute errors and its p-value, baseline vs enhanced, per model."""
    return EV_.paired_error_test(JN.join_predictions(predictions(spark, sf)))


_TWO_MODELS = (f"p AS ({_PRED}), pr AS (SELECT strftime(b.ts, '%Y-%m') AS model, b.y_true, b.y_pred AS y_base, e.y_pred AS y_enh "
               f"FROM p b JOIN p e ON b.ts = e.ts AND b.model = 'linear' AND e.model = 'forest' "
               f"AND b.variant = 'baseline' AND e.variant = 'baseline')")


@register("paired_error_test_monthly", wrap(_t_test_sql(_TWO_MODELS),
                                            "mean_diff sd_diff t_stat p_value", "n dof", "model", digits=4), digits=4, ids="K11")
def paired_error_test_monthly(spark, sf):
    """The same test of two models' baseline forecasts, month by month: few degrees of
    freedom and p-values of all sizes."""
    p = predictions(spark, sf).where("variant = 'baseline'")
    base = p.where("model = 'linear'").select("ts", "y_true", F.col("y_pred").alias("y_base"))
    other = p.where("model = 'forest'").select("ts", F.col("y_pred").alias("y_enh"))
    return EV_.paired_error_test(base.join(other, "ts").withColumn("model", F.date_format("ts", "yyyy-MM")))


@register("prediction_series",
          wrap(f"WITH {_PAIRED}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts) AS k FROM pr) "
               f"SELECT ts, model, y_true, y_base, y_enh FROM r WHERE k <= 100", "y_true y_base y_enh", "", "ts model", digits=4),
          digits=4, ids="K14")
def prediction_series(spark, sf):
    """First 100 aligned (truth, baseline, enhanced) rows per model."""
    return EV_.prediction_series(JN.join_predictions(predictions(spark, sf)), 100)


def _hist_src_sql(width: str = "1 day"):
    v = "value"
    return f"""h0 AS (SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'enhanced' END AS variant,
  time_bucket({S.interval(width)}, ts) AS day, avg({v}) / 10.0 AS loss, avg(abs({v} - 25.0)) / 10.0 AS val_loss, min({v}) / 10.0 AS mae,
  max({v}) / 10.0 AS val_mae, CAST(count({v}) AS DOUBLE) AS mape, CAST(count(DISTINCT user_id) AS DOUBLE) AS val_mape,
  avg({v} * {v}) / 100.0 AS mse, avg(abs({v} - 25.0) * abs({v} - 25.0)) / 100.0 AS val_mse, 1.0 - avg({v}) / 50.0 AS r2,
  1.0 - avg(abs({v} - 25.0)) / 25.0 AS val_r2, 1e-4 AS lr FROM events GROUP BY 1, 2, 3),
h AS (SELECT * EXCLUDE (day), row_number() OVER (PARTITION BY model, variant ORDER BY day) AS epoch FROM h0)"""


@register("history_long",
          wrap(f"""WITH {_hist_src_sql()},
u AS (UNPIVOT (SELECT model, variant, epoch, loss, mae, mape, mse, r2, val_loss, val_mae, val_mape, val_mse, val_r2 FROM h)
      ON loss, mae, mape, mse, r2, val_loss, val_mae, val_mape, val_mse, val_r2 INTO NAME nm VALUE value)
SELECT model, variant, epoch, regexp_replace(nm, '^val_', '') AS metric,
  CASE WHEN starts_with(nm, 'val_') THEN 'val' ELSE 'train' END AS split, value FROM u""",
               "value", "epoch", "model variant metric split"), ids="K13")
def history_long(spark, sf):
    """Training-history-shaped table (B7 on events) as (run, epoch, metric, split, value)."""
    return EV_.history_long(history_events(spark, sf))


def _best_epoch_sql(width: str) -> str:
    return f"""WITH RECURSIVE {_hist_src_sql(width)},
r AS (SELECT model, variant, epoch, CASE WHEN val_loss < 'inf'::DOUBLE - 1e-5 THEN val_loss ELSE 'inf'::DOUBLE END AS best,
             CASE WHEN val_loss < 'inf'::DOUBLE - 1e-5 THEN epoch END AS best_epoch,
             CASE WHEN val_loss < 'inf'::DOUBLE - 1e-5 THEN 0 ELSE 1 END AS wait, NULL::BIGINT AS stop FROM h WHERE epoch = 1
      UNION ALL
      SELECT h.model, h.variant, h.epoch,
             CASE WHEN h.val_loss < r.best - 1e-5 THEN h.val_loss ELSE r.best END,
             CASE WHEN h.val_loss < r.best - 1e-5 THEN h.epoch ELSE r.best_epoch END,
             CASE WHEN h.val_loss < r.best - 1e-5 THEN 0 ELSE r.wait + 1 END,
             CASE WHEN (CASE WHEN h.val_loss < r.best - 1e-5 THEN 0 ELSE r.wait + 1 END) >= 30 THEN h.epoch END
      FROM r JOIN h ON h.model = r.model AND h.variant = r.variant AND h.epoch = r.epoch + 1 WHERE r.stop IS NULL),
f AS (SELECT model, variant, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best, epoch) AS best_value,
             max(stop) AS stop, max(epoch) AS last_epoch FROM r GROUP BY 1, 2),
e AS (SELECT model, variant, max(epoch) AS last_epoch FROM h GROUP BY 1, 2)
SELECT f.model, f.variant, f.best_epoch, f.best_value, coalesce(f.stop, e.last_epoch) AS stop_epoch, f.stop IS NOT NULL AS stopped
FROM f JOIN e ON f.model = e.model AND f.variant = e.variant"""


@register("best_epoch", wrap(_best_epoch_sql("1 day"), "best_value", "best_epoch stop_epoch", "model variant stopped"), ids="K12")
def best_epoch(spark, sf):
    """Early-stopping replay (patience 30, min_delta 1e-5) per run: best and stop epoch."""
    return EV_.best_epoch(history_events(spark, sf))


@register("best_epoch_long_runs", wrap(_best_epoch_sql("6 hours"), "best_value", "best_epoch stop_epoch", "model variant stopped"),
          ids="K12")
def best_epoch_long_runs(spark, sf):
    """The same over runs of some 120 epochs (six-hour buckets), where the rule stops runs."""
    return EV_.best_epoch(history_events(spark, sf, "6 hours"))


# =============================================================================
# A: CSV sources and sinks (written into the shared checkpoint folder)
# =============================================================================



@register("read_traffic_csv", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM ow", SENS_COLS, "", "ts"), ids="A1 A3")
def read_traffic_csv(spark, sf):
    """Wide traffic frame written as CSV and read back with the declared-schema reader."""
    path = scratch_path(spark, "traffic-csv")
    CSV.write_wide_csv(_orders_wide(spark, sf), path)
    return CSV.read_traffic(spark, path)


@register("read_weather_csv", wrap(f"WITH {SQL_WS} SELECT * FROM ws", WCOLS, "", "ts"), ids="A2")
def read_weather_csv(spark, sf):
    """Weather frame written as CSV and read back (schema from the header, values DOUBLE)."""
    path = scratch_path(spark, "weather-csv")
    CSV.write_wide_csv(_weather(spark, sf), path)
    return CSV.read_weather(spark, path)


def _mixed(spark, wide, name, swapped, named):
    """Two folders: odd days with the columns as they are, even days in another order and,
    unless ``named``, without a name for the time column."""
    even = F.dayofmonth("ts") % 2 == 0
    paths = [scratch_path(spark, f"{name}-{k}") for k in ("odd", "even")]
    CSV.write_wide_csv(wide.where(~even), paths[0])
    other = wide.where(even).select("ts", *swapped)
    CSV.write_wide_csv(other if named else other.withColumnRenamed("ts", ""), paths[1])
    return paths


@register("read_traffic_mixed_headers", wrap(f"WITH {SQL_RO}, {SQL_OW} SELECT * FROM ow", SENS_COLS, "", "ts"), ids="A1")
def read_traffic_mixed_headers(spark, sf):
    """Files whose columns differ in order, one kind with an unnamed time column."""
    return CSV.read_traffic(spark, _mixed(spark, _orders_wide(spark, sf), "traffic-mixed", SENS[::-1], False))


_LACKING = [c for c in WEATHER_COLUMNS[::-1] if c != "awnd"]


@register("read_weather_mixed_headers", wrap(
    f"WITH {SQL_WS} SELECT * REPLACE (CASE WHEN day(ts) % 2 = 1 THEN awnd END AS awnd) FROM ws", WCOLS, "", "ts"), ids="A2")
def read_weather_mixed_headers(spark, sf):
    """Weather files in two column orders, one kind without the wind column."""
    return CSV.read_weather(spark, _mixed(spark, _weather(spark, sf), "weather-mixed", _LACKING, True))


@register("csv_bad_cells", wrap(f"""WITH {SQL_RO}, {SQL_OW}
SELECT 'ts' AS "column", count(*) AS n_rows, 0 AS n_missing, 0 AS n_bad FROM ow
""" + "".join(f"""UNION ALL SELECT '{c}', count(*), count_if("{c}" IS NULL OR (day(ts) % 2 = 0 AND {c == 'F'})),
  count_if("{c}" IS NOT NULL AND "{c}" > 150000 AND NOT (day(ts) % 2 = 0 AND {c == 'F'})) FROM ow
""" for c in SENS), "", "n_rows n_missing n_bad", "column"), ids="A1")
def csv_bad_cells(spark, sf):
    """Missing and wrong cells by column, in files of two layouts: prices above 150,000 are
    written as words, and one layout lacks a sensor."""
    odd = _orders_wide(spark, sf).select("ts", *[
        F.when(F.col(c) > 150_000, F.concat(F.lit("about "), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c)
        for c in SENS])
    return CSV.bad_cells(spark, _mixed(spark, odd, "traffic-bad", [c for c in SENS[::-1] if c != "F"], False))


_HIST_COLS = "loss val_loss mae val_mae mape val_mape mse val_mse r2 val_r2 lr"


@register("history_csv_roundtrip",
          wrap(f"WITH {_hist_src_sql()} SELECT * FROM h", _HIST_COLS, "epoch", "model variant"), ids="A4 A7")
def history_csv_roundtrip(spark, sf):
    """History written as one CSV folder per run and read back, run names from the path."""
    path = scratch_path(spark, "history-csv")
    CSV.write_history(history_events(spark, sf), path)
    return CSV.read_history(spark, path)


@register("summary_sink", wrap(f"WITH {_MET}, {_imp_sql()} SELECT * FROM imp", _IMP_D, "", "model"), ids="A5")
def summary_sink(spark, sf):
    """Improvement summary written as JSON and read back."""
    path = scratch_path(spark, "summary-json")
    CSV.write_summary(EV_.improvements(_metrics(spark, sf)), path, "json")
    return spark.read.schema("model string, rmse_improvement double, mae_improvement double, r2_improvement double, "
                             "mape_improvement double").json(path)


# =============================================================================
# J: forecast experiment on distributed regressors (no SQL twin: model fits)
# =============================================================================


_EXP_CACHE: dict = {}


def _experiment(spark, sf):
    """One experiment per (session, tables): daily orders traffic + shipping weather,
    24-row windows, three model families on both variants."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EXP_CACHE:
        preds, fitted, data = XP.run_experiment(readings_orders(spark, sf, "1 day"), weather_ship(spark, sf, "1 day"),
                                                "1 day", SENS, 24, on_constant="zero")
        _EXP_CACHE[key] = (preds, fitted, data)
    return _EXP_CACHE[key]


@register("experiment_predictions", None, ids="J1 J2 J3 J4")
def experiment_predictions(spark, sf):
    """Test-set forecasts of linear / forest / boosted models, baseline and enhanced."""
    return _experiment(spark, sf)[0]


def _experiment_rows_sql() -> str:
    """Test rows of both variants: their labels are the scaled targets, row by row."""
    parts = []
    for variant, weather in (("baseline", False), ("enhanced", True)):
        parts.append(f"""SELECT ts, '{variant}' AS variant, target AS y_true FROM (
  SELECT ts, target, row_number() OVER (ORDER BY ts) - 1 - 24 AS i, count(*) OVER () - 24 AS n
  FROM ({_pipeline_sql('1 day', weather)}) f) r
WHERE i >= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE)""")
    models = "(SELECT unnest(['linear', 'forest', 'boosted']) AS model)"
    return f"SELECT t.*, m.model, true AS finite FROM ({' UNION ALL '.join(parts)}) t, {models} m"


@register("experiment_rows", wrap(_experiment_rows_sql(), "y_true", "", "ts variant model finite", digits=4), digits=4,
          ids="J1 J2 J3 J4")
def experiment_rows(spark, sf):
    """Which rows are forecast, with which truth, and that every forecast is a number."""
    p = _experiment(spark, sf)[0]
    pred = F.col("y_pred")
    finite = F.coalesce((pred > float("-inf")) & (pred < float("inf")), F.lit(False))
    return p.select("ts", "variant", "model", "y_true", finite.alias("finite"))


@register("experiment_invariants", None, ids="J5 J6 J9")
def experiment_invariants(spark, sf):
    """What must hold for any data: boosting never raises the training loss, a forest's
    importances sum to 1, and the last iteration kept is the best that was seen on the
    validation rows up to it."""
    from pyspark.sql import Window
    _, fitted, data = _experiment(spark, sf)
    it = XP.iteration_metrics(fitted[("boosted", "enhanced")], data["enhanced"])
    # a few dozen rows: the iterations of one model
    w = Window.orderBy("iteration")
    falls = it.where("split = 'train'").select((F.col("loss") <= F.lag("loss").over(w) + 1e-9).alias("ok"))
    imp = XP.weight_importance(fitted[("forest", "enhanced")], _feature_cols(True), 24, "forest")
    kept = it.where("split = 'val'").agg((F.max_by("loss", "iteration") <= F.min("loss") + XP.MIN_DELTA).alias("holds"))
    rows = [falls.agg(F.coalesce(F.every("ok"), F.lit(True)).alias("holds")).select(F.lit("gbt_train_loss_never_rises").alias("name"), "holds"),
            imp.agg((F.abs(F.sum("importance") * 24 - 1) < 1e-6).alias("holds")).select(F.lit("importances_sum_to_one").alias("name"), "holds"),
            kept.select(F.lit("best_iteration_is_kept").alias("name"), "holds")]
    return JN.union_all(rows)


# A linear model small enough for SQL to fit: one series from two others, six-hour buckets.
_CASE_X = ("click", "purchase")


def _linear_case(spark, sf):
    """(windows of one step, fitted model)."""
    from flowcast.operators.scale import chronological_split
    wide = CL.drop_incomplete(RS.to_wide(readings_events(spark, sf, "6 hours"), EV))
    rows = chronological_split(wide).select(
        F.col("rn").alias("seq_idx"), "ts", "split", F.col("view").alias("y"), F.array(F.array(*_CASE_X)).alias("x"))
    data = XP.vectorised(rows)
    return data, XP.fit("linear", data, reg=0.0)


_CASE_SQL = f"""{_ev_sql('6 hours')},
r AS (SELECT ts, view AS y, click AS a, purchase AS b, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n
      FROM ew WHERE {' AND '.join(f'{e} IS NOT NULL' for e in EV)}),
l AS (SELECT *, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN rn < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r),
f AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM l WHERE split = 'train'),
w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM f),
s AS (SELECT rn, ts, split, y, wa * a AS ca, wb * b AS cb, my - wa * ma - wb * mb + wa * a + wb * b AS p0 FROM l, w)"""


@register("linear_fit_predictions", wrap(f"""WITH {_CASE_SQL}
SELECT ts, 'linear' AS model, 'case' AS variant, y AS y_true, p0 AS y_pred FROM s WHERE split = 'test'""",
                                         "y_true y_pred", "", "ts model variant"), ids="J1 J3")
def linear_fit_predictions(spark, sf):
    """Least squares fitted on the training rows, scored on the test rows."""
    data, model = _linear_case(spark, sf)
    return XP.predict(model, data, "linear", "case")


def _saved(spark, model, kind):
    """``model`` written below the checkpoint folder and read again."""
    path = scratch_path(spark, kind.__name__)
    model.write().save(path)
    return kind.load(path)


@register("scaler_saved_events", wrap(f"""WITH {_CASE_SQL}
SELECT ts, split, (a - ma) / sqrt(aa) AS click, (b - mb) / sqrt(bb) AS purchase FROM l, f""", "click purchase", "", "ts split"),
          ids="H1 H3")
def scaler_saved_events(spark, sf):
    """All rows scaled by a scaler that was fitted on the training rows, saved and loaded."""
    from flowcast.operators.scale import chronological_split
    rows = chronological_split(CL.drop_incomplete(RS.to_wide(readings_events(spark, sf, "6 hours"), EV)))
    scaler = FC.PopulationScaler(cols=list(_CASE_X)).fit(rows.where("split = 'train'"))
    return _saved(spark, scaler, FC.PopulationScalerModel).transform(rows).select("ts", "split", *_CASE_X)


_AHEAD_SQL = f"""{_CASE_SQL},
g AS (SELECT rn, ts, split, y, lag(a) OVER (ORDER BY rn) AS a, lag(b) OVER (ORDER BY rn) AS b FROM l),
h AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM g WHERE split = 'train' AND a IS NOT NULL),
u AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM h)"""


@register("saved_pipeline_forecast", wrap(f"""WITH {_AHEAD_SQL}
SELECT ts, y AS y_true, my + wa * (a - ma) + wb * (b - mb) AS y_pred FROM g, u WHERE split = 'test'""", "y_true y_pred", "", "ts"),
          ids="H1 E5 J1 J3")
def saved_pipeline_forecast(spark, sf):
    """One step ahead by a scaler, window and least-squares pipeline that was fitted on the
    training rows, saved and loaded; labels and forecasts in original units."""
    from flowcast.operators.scale import chronological_split
    rows = cut_lineage(chronological_split(CL.drop_incomplete(RS.to_wide(readings_events(spark, sf, "6 hours"), EV))))
    pipeline = FC.forecaster(_CASE_X, "view", length=1, name="linear", reg=0.0)
    model = _saved(spark, pipeline.fit(rows.where("split = 'train'")), FC.PipelineModel)
    scored = FC.unscaled(model, model.transform(rows), ["y", "prediction"])
    test = rows.where("split = 'test'").select(F.col("ts").alias("_fc_ts"))
    return scored.join(test, F.col("ts") == F.col("_fc_ts"), "left_semi").select(
        "ts", F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))


@register("linear_weight_importance", wrap(f"""WITH {_CASE_SQL}
SELECT 'click' AS feature, abs(wa) AS importance FROM w UNION ALL SELECT 'purchase', abs(wb) FROM w""",
                                           "importance", "", "feature"), ids="J9")
def linear_weight_importance(spark, sf):
    """Sizes of the fitted weights."""
    return XP.weight_importance(_linear_case(spark, sf)[1], _CASE_X, 1, "linear")


def _swap_sql(value: str) -> str:
    return f"""WITH {_CASE_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY rn) AS pos FROM s WHERE split = 'test'),
h AS (SELECT rn, ca, cb, k, row_number() OVER (PARTITION BY k ORDER BY md5(rn || ':42:' || k), rn) AS pos
      FROM t, (SELECT unnest(range(10)) AS k) u),
d AS (SELECT t.y, t.p0, h.k, unnest(['click', 'purchase']) AS feature, unnest([h.ca - t.ca, h.cb - t.cb]) AS d FROM t JOIN h USING (pos)),
v AS (SELECT feature, k, {value} AS v FROM d GROUP BY 1, 2)
SELECT feature, avg(v) AS importance, stddev_samp(v) AS importance_std FROM v GROUP BY 1"""


@register("linear_permutation_importance", wrap(_swap_sql(
    "(sum((y - p0 - d) * (y - p0 - d)) - sum((y - p0) * (y - p0))) / (var_pop(y) * count(*))"),
    "importance importance_std", "", "feature"), ids="J7")
def linear_permutation_importance(spark, sf):
    """R2 lost by permuted features of the fitted linear model, rescored by feature block."""
    data, model = _linear_case(spark, sf)
    return XP.permutation_importance(model, data, _CASE_X)


@register("linear_perturbation_importance", wrap(_swap_sql("avg(d * d)"), "importance importance_std", "", "feature"), ids="J8")
def linear_perturbation_importance(spark, sf):
    """Mean squared change of the linear model's predictions by permuted features."""
    data, model = _linear_case(spark, sf)
    return XP.permutation_importance(model, data, _CASE_X, score="perturbation")


@register("constant_iteration_metrics", wrap(f"""WITH {_CASE_SQL}, i AS (SELECT unnest(range(1, 4)) AS iteration),
p AS (SELECT iteration, split, y, (SELECT my FROM f) AS q FROM l, i WHERE split IN ('train', 'val')),
m AS (SELECT split, avg(y) AS mean FROM p GROUP BY split)
SELECT iteration, split, avg((q - y) * (q - y)) AS loss, sqrt(avg((q - y) * (q - y))) AS rmse, avg(abs(q - y)) AS mae,
       avg(CASE WHEN y <> 0 THEN abs((q - y) / y) END) * 100 AS mape,
       1 - sum((q - y) * (q - y)) / sum((y - mean) * (y - mean)) AS r2
FROM p JOIN m USING (split) GROUP BY iteration, split""", "loss rmse mae mape r2", "iteration", "split"), ids="J6")
def constant_iteration_metrics(spark, sf):
    """The curve of an ensemble of three trees without a split: the first predicts the mean of
    the training labels, the others what is left of it, nothing."""
    data, _ = _linear_case(spark, sf)
    train = data.where("split = 'train'")
    model = None if train.isEmpty() else XP.estimator("boosted", rounds=3, boosted_depth=0).fit(train)
    return XP.iteration_metrics(model, data)


@register("experiment_metrics", None, ids="J4 K1 K5")
def experiment_metrics(spark, sf):
    """Metrics of the experiment's forecasts joined with the per-model improvements."""
    m = EV_.regression_metrics(_experiment(spark, sf)[0])
    return m.join(EV_.improvements(m), "model")


@register("gbt_iteration_metrics", None, ids="J5 J6")
def gbt_iteration_metrics(spark, sf):
    """Per-iteration loss, RMSE, MAE, MAPE and R2 on train and validation rows (boosted, enhanced)."""
    _, fitted, data = _experiment(spark, sf)
    return XP.iteration_metrics(fitted[("boosted", "enhanced")], data["enhanced"])


@register("permutation_importance", None, ids="J7")
def permutation_importance(spark, sf):
    """R2 drop per permuted feature sequence (forest, enhanced, 10 repeats)."""
    _, fitted, data = _experiment(spark, sf)
    return XP.permutation_importance(fitted[("forest", "enhanced")], data["enhanced"], _feature_cols(True), repeats=10)


@register("perturbation_importance", None, ids="J8")
def perturbation_importance(spark, sf):
    """Mean squared prediction change per permuted feature sequence (linear, enhanced)."""
    _, fitted, data = _experiment(spark, sf)
    return XP.permutation_importance(fitted[("linear", "enhanced")], data["enhanced"], _feature_cols(True),
                                     repeats=10, score="perturbation")


@register("weight_importance", None, ids="J9 F2")
def weight_importance(spark, sf):
    """Mean |coefficient| / tree importance per base feature, top 20 per model (enhanced)."""
    from flowcast.operators.sort import top_features
    _, fitted, _ = _experiment(spark, sf)
    parts = [top_features(XP.weight_importance(fitted[(n, "enhanced")], _feature_cols(True), 24, n), 20)
             .withColumn("model", F.lit(n)) for n in XP.MODELS]
    return JN.union_all(parts)


@register("weather_impact_summary", None, ids="K15 K7")
def weather_impact_summary(spark, sf):
    """Improvement, per-condition RMSE ratios and weather-feature importance per model."""
    preds, fitted, _ = _experiment(spark, sf)
    m = EV_.regression_metrics(preds)
    cond = EV_.metrics_by_condition(preds, _weather(spark, sf))
    imp = XP.weight_importance(fitted[("forest", "enhanced")], _feature_cols(True), 24, "forest")
    return XP.weather_impact_summary(m, cond, imp, WEATHER_FEATURES)


def _impact_sql(pred: str, ws: str) -> str:
    conditions = ("overall", "normal", "extreme", "rush_hour")
    ratios = ", ".join(f"max(CASE WHEN condition = '{c}' AND variant = 'enhanced' THEN rmse END) / "
                       f"nullif(max(CASE WHEN condition = '{c}' AND variant = 'baseline' THEN rmse END), 0) AS {c}" for c in conditions)
    weights = " + ".join(f"coalesce(abs(corr({c}, v)), 0)" for c in _IMPACT)
    return f"""WITH c AS ({_condition_sql(pred, ws)}), m AS (SELECT * FROM c WHERE condition = 'overall'), {_imp_sql()},
k AS (SELECT model, {ratios} FROM c GROUP BY model), {ws},
rd AS (SELECT ts, avg(value) AS v FROM ({S.readings_events('1 hour')}) q GROUP BY ts),
g AS (SELECT {weights} AS weather_importance FROM ws JOIN rd USING (ts))
SELECT imp.*, k.* EXCLUDE (model), weather_importance FROM imp JOIN k USING (model), g"""


_IMPACT = ("tmax", "prcp", "awnd")


@register("weather_impact_hourly", wrap(_impact_sql(S.predictions(S.readings_events("1 hour"), S.weather_events("1 hour")), SQL_WE),
                                        _IMP_D + " overall normal extreme rush_hour weather_importance", "", "model", digits=4),
          digits=4, ids="K15 K7")
def weather_impact_hourly(spark, sf):
    """The impact summary on hourly series, rush hour included; a weather feature's importance
    is the size of its correlation with the traffic."""
    w = weather_events(spark, sf)
    readings = readings_events(spark, sf, "1 hour")
    preds = predictions_of(readings, w)
    joined = w.join(CL.row_mean(readings, name="v"), "ts")
    imp = ST.corr_matrix(joined, [*_IMPACT, "v"]).where("col_b = 'v' and col_a <> 'v'").select(
        F.col("col_a").alias("feature"), F.abs("corr").alias("importance"))
    return XP.weather_impact_summary(EV_.regression_metrics(preds), EV_.metrics_by_condition(preds, w), imp, _IMPACT)


def _augment_sql() -> str:
    def u(c, tag):
        h = f"substr(md5(CAST(epoch_us(ts) AS VARCHAR) || ':{c}:{tag}'), 1, 12)"
        return f"((CAST('0x' || {h} AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE)"
    noise = ", ".join(f"{c} + sqrt(-2.0::DOUBLE * ln({u(c, '42:u')})) * cos(6.283185307179586::DOUBLE * {u(c, '42:v')}) * 0.01::DOUBLE AS {c}"
                      for c in WEATHER_COLUMNS)
    scale = ", ".join(f"{c} * (0.95::DOUBLE + {u(c, '43:s')} * {1.05 - 0.95!r}::DOUBLE) AS {c}" for c in WEATHER_COLUMNS)
    cols = ", ".join(WEATHER_COLUMNS)
    return (f"WITH {SQL_WS} SELECT ts, 'original' AS copy, {cols} FROM ws UNION ALL SELECT ts, 'noise', {noise} FROM ws "
            f"UNION ALL SELECT ts, 'scale', {scale} FROM ws")


@register("augment_weather", wrap(_augment_sql(), WCOLS, "", "ts copy"), ids="H5 H6 H7")
def augment_weather(spark, sf):
    """Original + Gaussian-noise + random-scale copies of the weather rows (3n rows)."""
    from flowcast.operators.scale import augment
    key = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return augment(_weather(spark, sf), list(WEATHER_COLUMNS), key)


# =============================================================================
# Streaming extension: the 5-minute resample as a Structured Streaming job
# =============================================================================

@register("stream_resample_events", wrap(S.readings_events("5 minutes"), "value", "", "ts sensor_id"), ids="D1 (stream)")
def stream_resample_events(spark, sf):
    """5-minute per-event-type means, partial sums per micro-batch merged afterwards."""
    from flowcast.streaming.resample import EVENTS_SCHEMA, stream_resample
    return stream_resample(spark, sf, EVENTS_SCHEMA, "5 minutes", file_glob="events.parquet")



# =============================================================================
# 5-minute multi-sensor preparation (events as five sensors)
# =============================================================================

def _events_pipeline_sql(length: int = 24, width: str = "5 minutes", sensors: tuple = EV, readings: str | None = None) -> str:
    lo, hi = _year_bounds("mg")
    cols = [*sensors, "avg_speed", "hour", "day_of_week", "month", "is_holiday",
            *[f"speed_lag{k}" for k in LAGS], *[f"speed_ma{m}" for m in MOVING_AVERAGES]]
    ctes = [f"re AS ({readings or S.readings_events(width)})", S.traffic_block(sensors, "re"), "mg AS (SELECT * FROM trf)",
            S.holidays(lo, hi), S.features_block("mg"), "fx AS (SELECT *, speed_ma30 AS target FROM ft)",
            S.zscore_pop("fx", cols + ["target"])]
    rowsum = " + ".join(f'"{c}"' for c in cols)
    return ("WITH " + ",\n".join(ctes) + f""",
r AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn, {rowsum} AS rs FROM zp),
s AS (SELECT rn - {length} AS seq_idx, ts, target AS y,
        sum(rs) OVER (ORDER BY ts ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING) AS x_sum FROM r),
k AS (SELECT * FROM s WHERE seq_idx >= 0), n AS (SELECT count(*) AS n FROM k)
SELECT seq_idx, ts, y, x_sum,
  CASE WHEN seq_idx < floor(n * 0.7::DOUBLE) THEN 'train'
       WHEN seq_idx < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM k, n""")


@register("sequences_events_5min", wrap(_events_pipeline_sql(), "y x_sum", "seq_idx", "ts split"), ids="H10 E5 H3 B1-B3 E1 E2")
def sequences_events_5min(spark, sf):
    """Whole baseline preparation on the 5-minute, five-sensor event series:
    complete buckets, IQR filter, features, scaling, 24-step sequences, split."""
    from flowcast.plans.prepare import prepare_dataset
    p = prepare_dataset(readings_events(spark, sf, "5 minutes"), None, length=24, width="5 minutes", sensors=EV)
    return p.select("seq_idx", "ts", "y", F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    "split")


@register("sequences_events_5min_mean", wrap(_events_pipeline_sql(
    sensors=("all",), readings=f"SELECT ts, 'all' AS sensor_id, avg(value) AS value FROM ({S.readings_events('5 minutes')}) q GROUP BY ts"),
    "y x_sum", "seq_idx", "ts split"), ids="H10 E5 H3")
def sequences_events_5min_mean(spark, sf):
    """The 5-minute preparation of one series, the mean over the event types."""
    from flowcast.plans.prepare import prepare_dataset
    readings = CL.row_mean(readings_events(spark, sf, "5 minutes"), name="value").withColumn("sensor_id", F.lit("all"))
    p = prepare_dataset(readings, None, length=24, width="5 minutes", sensors=["all"])
    return p.select("seq_idx", "ts", "y", F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    "split")


@register("sequences_events_hourly", wrap(_events_pipeline_sql(24, "1 hour"), "y x_sum", "seq_idx", "ts split"),
          ids="H10 E5 H3")
def sequences_events_hourly(spark, sf):
    """The same preparation on hourly buckets of the five-sensor event series."""
    from flowcast.plans.prepare import prepare_dataset
    p = prepare_dataset(readings_events(spark, sf, "1 hour"), None, length=24, width="1 hour", sensors=EV)
    return p.select("seq_idx", "ts", "y", F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    "split")


@register("sequences_events_hourly_array", wrap(_events_pipeline_sql(24, "1 hour"), "y x_sum", "seq_idx", "ts split"),
          ids="H10 E5 A3")
def sequences_events_hourly_array(spark, sf):
    """The hourly preparation in the array layout, which takes any number of sensors."""
    from flowcast.plans.prepare import prepare_dataset
    p = prepare_dataset(readings_events(spark, sf, "1 hour"), None, length=24, width="1 hour", layout="array")
    return p.select("seq_idx", "ts", "y", F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
                    "split")


@register("prediction_errors",
          wrap(f"WITH p AS ({_PRED}) SELECT ts, model, variant, y_pred - y_true AS error FROM p", "error", "",
               "ts model variant", digits=4), digits=4, ids="K2")
def prediction_errors(spark, sf):
    """Error = prediction - truth per forecast row."""
    return EV_.errors(predictions(spark, sf)).select("ts", "model", "variant", "error")


@register("chronological_split_orders",
          wrap(f"""WITH {SQL_RO}, {SQL_OW}, r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM ow)
SELECT ts, rn, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train'
                    WHEN rn < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
               "", "rn", "ts split"), ids="H3 E11")
def chronological_split_orders(spark, sf):
    """Chronological train/val/test labels over the daily traffic buckets."""
    from flowcast.operators.scale import chronological_split
    return chronological_split(_orders_wide(spark, sf).select("ts"))
