"""Joins (C1-C3, C5) and the time-set operators.

Every join is an equi-join on a time key (or key + model). The only broadcast is
the holiday calendar, whose size is bounded by the year span of the data (at most
22 rows per year; Spark timestamps span fewer than 10,000 years).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcast.functions.calendar import holidays_for_years
from flowcast.operators.stats import resample_mean


def align_merge(traffic: DataFrame, weather: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Resample both frames to ``width`` buckets, inner equi-join on the bucket,
    then drop rows with any NULL. Empty buckets of either side never match, so the
    resampling does not need a gap-filled spine here."""
    t = resample_mean(traffic, width, ts=ts, gap_fill=False)
    w = resample_mean(weather, width, ts=ts, gap_fill=False)
    return t.join(w, on=ts, how="inner").na.drop("any")


def concat_time(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    """Full outer equi-join on the timestamp (column-wise concat of two series)."""
    return a.join(b, on=ts, how="full")


def holiday_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """C4 over the years present in ``df`` (one year either side for observed days)."""
    years = (df.agg(F.min(F.year(ts)).alias("lo"), F.max(F.year(ts)).alias("hi"))
               .where(F.col("lo").isNotNull())
               .select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("year")))
    return holidays_for_years(years).select("date").distinct()


def holiday_flag(df: DataFrame, ts: str = "ts", name: str = "is_holiday", calendar: DataFrame | None = None) -> DataFrame:
    """1 when the date of ``ts`` is a US federal holiday or observed day, else 0.

    The calendar side is broadcast: its size is bounded by 22 rows per calendar year."""
    cal = calendar if calendar is not None else holiday_calendar(df, ts)
    cal = cal.select(F.col("date").alias("_fc_hday"), F.lit(1).alias("_fc_hflag"))
    return (df.join(F.broadcast(cal), F.to_date(F.col(ts)) == F.col("_fc_hday"), "left")
              .withColumn(name, F.coalesce(F.col("_fc_hflag"), F.lit(0)))
              .drop("_fc_hday", "_fc_hflag"))


def join_predictions(preds: DataFrame, keys: Sequence[str] = ("ts", "model")) -> DataFrame:
    """Align truth, baseline and enhanced forecasts on (ts, model).

    The truth comes from the baseline rows (the enhanced forecast is scored against
    the same labels)."""
    keys = list(keys)
    base = preds.where(F.col("variant") == "baseline").select(*keys, "y_true", F.col("y_pred").alias("y_base"))
    enh = preds.where(F.col("variant") == "enhanced").select(*keys, F.col("y_pred").alias("y_enh"))
    return base.join(enh, on=keys, how="inner")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """row-wise union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_times(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    """timestamps present in both frames."""
    return a.select(ts).intersect(b.select(ts))
