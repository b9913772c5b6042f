"""SQL building blocks for the DuckDB twins of the registered queries.

These are independent formulations of the same fixtures and operators in plain
SQL (global windows, ``quantile_cont``, ``time_bucket``), used only as the
correctness oracle.
"""

from __future__ import annotations

from flowcast.plans.prepare import LAGS, MOVING_AVERAGES, WEATHER_FEATURES


def interval(width: str) -> str:
    return f"INTERVAL '{width}'"


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"


def readings_orders(width: str = "1 day") -> str:
    return (f"SELECT time_bucket({interval(width)}, o_orderdate) AS ts, o_orderstatus AS sensor_id, "
            f"avg(o_totalprice) AS value FROM orders GROUP BY 1, 2")


def weather_ship(width: str = "1 day", with_description: bool = False) -> str:
    desc = (", first(l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS weather_description"
            if with_description else "")
    return f"""SELECT time_bucket({interval(width)}, l_shipdate) AS ts,
  max(l_extendedprice) / 2500.0 AS tmax, min(l_extendedprice) / 2500.0 AS tmin,
  sum(CASE WHEN l_discount >= 0.1::DOUBLE THEN l_quantity ELSE 0.0::DOUBLE END) / 100.0 AS prcp,
  avg(l_quantity) AS awnd, avg(l_tax) * 1000.0 AS rhav, min(l_tax) * 1000.0 AS rhmn,
  max(l_tax) * 1000.0 AS rhmx, avg(l_extendedprice) / 1000.0 AS aslp,
  CAST(avg(l_suppkey) % 360 AS DOUBLE) AS wdf2{desc}
FROM lineitem GROUP BY 1"""


def readings_events(width: str = "5 minutes") -> str:
    return (f"SELECT time_bucket({interval(width)}, ts) AS ts, event_type AS sensor_id, avg(value) AS value "
            f"FROM events GROUP BY 1, 2")


def weather_events(width: str = "1 hour") -> str:
    return f"""SELECT time_bucket({interval(width)}, ts) AS ts, max(value) / 4.0 AS tmax, min(value) / 4.0 AS tmin,
  sum(CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN value ELSE 0.0::DOUBLE END) / 100.0 AS prcp,
  avg(value) / 5.0 AS awnd, avg(CAST(user_id % 100 AS DOUBLE)) AS rhav FROM events GROUP BY 1"""


def holidays(year_lo: str, year_hi: str) -> str:
    """US federal holidays and observed days for years year_lo..year_hi."""
    def nth(m: int, isodow: int, n: int) -> str:
        d1 = f"make_date(y::INT, {m}, 1)"
        return f"({d1} + INTERVAL (((({isodow} - isodow({d1})) + 7) % 7) + 7 * {n - 1}) DAY)::DATE"

    def last(m: int, day: int, isodow: int) -> str:
        d = f"make_date(y::INT, {m}, {day})"
        return f"({d} - INTERVAL (((isodow({d}) - {isodow}) + 7) % 7) DAY)::DATE"

    fixed = lambda m, d: f"make_date(y::INT, {m}, {d})"
    rules = [
        (fixed(1, 1), True, None),
        (nth(1, 1, 3), False, "y >= 1986"),
        (nth(2, 1, 3), False, None),
        (last(5, 31, 1), False, None),
        (fixed(6, 19), True, "y >= 2021"),
        (fixed(7, 4), True, None),
        (nth(9, 1, 1), False, None),
        (nth(10, 1, 2), False, None),
        (f"CASE WHEN y BETWEEN 1971 AND 1977 THEN {nth(10, 1, 4)} ELSE {fixed(11, 11)} END", True, None),
        (nth(11, 4, 4), False, None),
        (fixed(12, 25), True, None),
    ]
    parts = []
    for d, observed, cond in rules:
        where = f" WHERE {cond}" if cond else ""
        parts.append(f"SELECT {d} AS d FROM yrs{where}")
        if observed:
            obs = (f"CASE isodow({d}) WHEN 6 THEN ({d} - INTERVAL 1 DAY)::DATE "
                   f"WHEN 7 THEN ({d} + INTERVAL 1 DAY)::DATE END")
            parts.append(f"SELECT {obs} AS d FROM yrs{where}")
    union = "\n  UNION ALL ".join(parts)
    return (f"yrs AS (SELECT range AS y FROM range(({year_lo}) - 1, ({year_hi}) + 2)),\n"
            f"hol AS (SELECT DISTINCT d FROM ({union}) h WHERE d IS NOT NULL)")


def traffic_block(sensors: tuple[str, ...], source: str = "ro") -> str:
    """CTEs trw (wide), trc (complete rows), trf (IQR filtered) over readings CTE ``source``."""
    piv = ", ".join(f"max(CASE WHEN sensor_id = '{s}' THEN value END) AS \"{s}\"" for s in sensors)
    cnt = " + ".join(f"(\"{s}\" IS NOT NULL)::INT" for s in sensors)
    tot = " + ".join(f"coalesce(\"{s}\", 0.0)" for s in sensors)
    nn = " AND ".join(f"\"{s}\" IS NOT NULL" for s in sensors)
    return f"""trw AS (SELECT ts, {piv} FROM {source} GROUP BY ts),
trm AS (SELECT *, CASE WHEN ({cnt}) > 0 THEN (0.0 + {tot}) / ({cnt}) END AS avg_speed FROM trw),
trc AS (SELECT * FROM trm WHERE {nn} AND avg_speed IS NOT NULL),
tq AS (SELECT quantile_cont(avg_speed, 0.25) AS q1, quantile_cont(avg_speed, 0.75) AS q3 FROM trc),
trf AS (SELECT trc.* FROM trc, tq
        WHERE avg_speed >= q1 - 1.5 * (q3 - q1) AND avg_speed <= q3 + 1.5 * (q3 - q1))"""


def weather_block(source: str = "ws") -> str:
    """CTEs wq, wf (derived columns) and wz (sample z-scores of the 10 features)."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in WEATHER_FEATURES)
    z = ", ".join(f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} WHEN s_{c} = 0 THEN 0.0 END AS {c}"
                  for c in WEATHER_FEATURES)
    return f"""wq AS (SELECT quantile_cont(prcp, 0.95) AS p95, quantile_cont(awnd, 0.95) AS a95 FROM {source}),
wf AS (SELECT ts, tmax, tmin, prcp, awnd, rhav,
  tmax - tmin AS temp_range,
  tmax - 0.55::DOUBLE * (1.0::DOUBLE - rhav / 100.0::DOUBLE) * (tmax - 14.5::DOUBLE) AS feels_like,
  CASE WHEN isfinite(13.12::DOUBLE + 0.6215::DOUBLE * tmax - 11.37::DOUBLE * pow(awnd, 0.16::DOUBLE)
                     + 0.3965::DOUBLE * tmax * pow(awnd, 0.16::DOUBLE))
       THEN 13.12::DOUBLE + 0.6215::DOUBLE * tmax - 11.37::DOUBLE * pow(awnd, 0.16::DOUBLE)
                     + 0.3965::DOUBLE * tmax * pow(awnd, 0.16::DOUBLE) END AS wind_chill,
  CASE WHEN coalesce(prcp > p95, false) OR coalesce(awnd > a95, false) THEN 1 ELSE 0 END AS severe_weather,
  (CASE WHEN hour(ts) IN (7, 8, 9, 16, 17, 18) THEN 1 ELSE 0 END) * (CASE WHEN prcp > 0 THEN 1 ELSE 0 END)
    AS rush_hour_rain
  FROM {source}, wq),
wst AS (SELECT {stats} FROM wf),
wz AS (SELECT ts, {z} FROM wf, wst)"""


def features_block(source: str = "mg") -> str:
    """CTE ft: calendar, holiday, lags, full-window moving averages; NULL rows dropped.
    Needs a ``hol`` CTE."""
    lags = ", ".join(f"lag(avg_speed, {k}) OVER (ORDER BY ts) AS speed_lag{k}" for k in LAGS)
    mas = ", ".join(
        f"CASE WHEN count(avg_speed) OVER (ORDER BY ts ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) = {m} "
        f"THEN avg(avg_speed) OVER (ORDER BY ts ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) END AS speed_ma{m}"
        for m in MOVING_AVERAGES)
    return f"""fa AS (SELECT {source}.*, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
  CASE WHEN CAST(ts AS DATE) IN (SELECT d FROM hol) THEN 1 ELSE 0 END AS is_holiday,
  {lags}, {mas}
  FROM {source}),
ft AS (SELECT * FROM fa WHERE speed_lag{max(LAGS)} IS NOT NULL AND speed_ma{max(MOVING_AVERAGES)} IS NOT NULL)"""


def zscore_pop(src: str, cols: list[str], name: str = "zp", keep: str = "ts") -> str:
    """CTE ``name``: population z-scores of ``cols`` (tiny std divides by 1)."""
    stats = ", ".join(f"avg(\"{c}\") AS \"m_{c}\", stddev_pop(\"{c}\") AS \"s_{c}\"" for c in cols)
    z = ", ".join(f"(\"{c}\" - \"m_{c}\") / CASE WHEN \"s_{c}\" < 2.220446049250313e-15 THEN 1.0 "
                  f"ELSE \"s_{c}\" END AS \"{c}\"" for c in cols)
    return f"{name}_st AS (SELECT {stats} FROM {src}),\n{name} AS (SELECT {keep}, {z} FROM {src}, {name}_st)"


def predictions(readings: str | None = None, weather: str | None = None) -> str:
    """B6 predictions fixture (ts, model, variant, y_true, y_pred)."""
    readings, weather = readings or readings_orders("1 day"), weather or weather_ship("1 day")
    def prev_mean(k):
        frame = f"OVER (ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count(y_true) {frame} = {k} THEN avg(y_true) {frame} END"
    return f"""WITH ro AS ({readings}),
y AS (SELECT ts, avg(value) AS y_true FROM ro GROUP BY ts),
b AS (SELECT ts, y_true, lag(y_true, 1) OVER (ORDER BY ts) AS linear, {prev_mean(5)} AS forest,
             {prev_mean(15)} AS boosted FROM y),
l AS (UNPIVOT b ON linear, forest, boosted INTO NAME model VALUE base_pred),
ws AS ({weather}),
j AS (SELECT l.*, ws.awnd FROM l LEFT JOIN ws ON l.ts = ws.ts),
p AS (SELECT ts, model, 'baseline' AS variant, y_true, base_pred AS y_pred FROM j
      UNION ALL
      SELECT ts, model, 'enhanced' AS variant, y_true, 0.5 * (base_pred + y_true) + 0.001 * awnd AS y_pred FROM j)
SELECT * FROM p WHERE y_pred IS NOT NULL"""
