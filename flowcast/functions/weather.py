"""Weather feature formulas (G2-G13). Thresholds (quantiles, means) are passed in
as columns so callers can attach them with a one-row broadcast join and keep the
plan a single lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast.functions.columns import clean_double, col, flag, truthy

# Fixed values that must equal the reference for identical results.
# Rush hours of the weather pipeline: 07-09 and 16-18 inclusive.
PIPELINE_RUSH_HOURS = (7, 8, 9, 16, 17, 18)
# Rush hours of the per-condition report: 7, 8, 9, 17, 18, 19.
REPORT_RUSH_HOURS = (7, 8, 9, 17, 18, 19)
# Rain categories: (-inf, 0] No Rain, (0, 0.1] Light, (0.1, 1] Moderate, (1, inf) Heavy.
RAIN_EDGES = (0.0, 0.1, 1.0)
RAIN_LABELS = ("No Rain", "Light", "Moderate", "Heavy")


def temp_range(tmax="tmax", tmin="tmin") -> Column:
    """TMAX - TMIN."""
    return col(tmax) - col(tmin)


def feels_like(tmax="tmax", rhav="rhav") -> Column:
    """TMAX - 0.55 * (1 - RHAV/100) * (TMAX - 14.5)."""
    t = col(tmax)
    return t - F.lit(0.55) * (F.lit(1.0) - col(rhav) / F.lit(100.0)) * (t - F.lit(14.5))


def wind_chill(tmax="tmax", awnd="awnd") -> Column:
    """13.12 + 0.6215 T - 11.37 V^0.16 + 0.3965 T V^0.16 (NaN for V<0 becomes NULL)."""
    t = col(tmax)
    v16 = F.pow(col(awnd), F.lit(0.16))
    return clean_double(F.lit(13.12) + F.lit(0.6215) * t - F.lit(11.37) * v16 + F.lit(0.3965) * t * v16)


def is_raining(prcp="prcp") -> Column:
    """PRCP > 0 as 0/1 (NULL counts as 0)."""
    return flag(col(prcp) > 0)


def severe_weather(prcp="prcp", awnd="awnd", prcp_q95="prcp_q95", awnd_q95="awnd_q95") -> Column:
    """PRCP > q95(PRCP) or AWND > q95(AWND), strict."""
    return flag(truthy(col(prcp) > col(prcp_q95)) | truthy(col(awnd) > col(awnd_q95)))


def is_rush_hour(ts="ts", hours: Iterable[int] = PIPELINE_RUSH_HOURS) -> Column:
    """Hour of ``ts`` in the given set."""
    return flag(F.hour(col(ts)).isin(list(hours)))


def rush_hour_rain(ts="ts", prcp="prcp", hours: Iterable[int] = PIPELINE_RUSH_HOURS) -> Column:
    """Rush hour times raining."""
    return is_rush_hour(ts, hours) * is_raining(prcp)


def rain_category(prcp="prcp") -> Column:
    """Right-closed rain categories; NULL stays NULL."""
    p = col(prcp)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p <= RAIN_EDGES[0], RAIN_LABELS[0])
        .when(p <= RAIN_EDGES[1], RAIN_LABELS[1])
        .when(p <= RAIN_EDGES[2], RAIN_LABELS[2])
        .otherwise(RAIN_LABELS[3])
    )


def equal_width_level(x, lo, hi, n: int = 5) -> Column:
    """Equal-width level 1..n, right-closed, the minimum falls in level 1.

    Edges are ``lo + k*(hi-lo)/n``; a value belongs to the first level whose right
    edge it does not exceed (pandas ``cut`` with the lowest edge extended).
    """
    x, lo, hi = col(x), col(lo), col(hi)
    width = (hi - lo) / F.lit(float(n))
    expr = F.lit(n)
    for k in range(n - 1, 0, -1):
        expr = F.when(x <= lo + width * F.lit(float(k)), F.lit(k)).otherwise(expr)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(expr)


def rainy_and_windy(prcp="prcp", awnd="awnd", awnd_mean="awnd_mean") -> Column:
    """PRCP > 0 and AWND > mean(AWND)."""
    return flag(truthy(col(prcp) > 0) & truthy(col(awnd) > col(awnd_mean)))


def heavy_rain(prcp="prcp", prcp_q95="prcp_q95") -> Column:
    """PRCP > q95(PRCP)."""
    return flag(col(prcp) > col(prcp_q95))


def extreme_weather(prcp="prcp", awnd="awnd", tmax="tmax", tmin="tmin",
                    prcp_q90="prcp_q90", awnd_q90="awnd_q90", tmax_q90="tmax_q90", tmin_q10="tmin_q10") -> Column:
    """PRCP > q90 or AWND > q90 or TMAX > q90 or TMIN < q10."""
    return flag(
        truthy(col(prcp) > col(prcp_q90))
        | truthy(col(awnd) > col(awnd_q90))
        | truthy(col(tmax) > col(tmax_q90))
        | truthy(col(tmin) < col(tmin_q10))
    )
