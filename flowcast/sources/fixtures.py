"""Fixtures derived by Spark from the driver tables (see FIXTURES.md, section B).

Each fixture is a lazy DataFrame over the given tables, so its work grows with
them. Only the columns a fixture needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowcast.functions.buckets import time_bucket
from flowcast.functions.columns import clean_double
from flowcast.sources.tables import read_table

ORDER_SENSORS = ("F", "O", "P")
EVENT_SENSORS = ("click", "error", "purchase", "signup", "view")
WEATHER_COLUMNS = ("tmax", "tmin", "prcp", "awnd", "rhav", "rhmn", "rhmx", "aslp", "wdf2")


def readings_orders(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """B1: long traffic readings (ts, sensor_id, value) from orders."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_orderstatus", "o_totalprice"])
    return (o.groupBy(time_bucket("o_orderdate", width).alias("ts"), F.col("o_orderstatus").alias("sensor_id"))
             .agg(F.avg(clean_double("o_totalprice")).alias("value")))


def weather_ship(spark: SparkSession, sf_dir: str, width: str = "1 day", with_description: bool = False) -> DataFrame:
    """B2 (and B5 with ``with_description``): one weather row per bucket of l_shipdate."""
    cols = ["l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_suppkey"]
    if with_description:
        cols += ["l_returnflag", "l_orderkey", "l_linenumber"]
    li = read_table(spark, sf_dir, "lineitem", cols)
    ep, qty, tax = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")
    aggs = [
        (F.max(ep) / 2500.0).alias("tmax"),
        (F.min(ep) / 2500.0).alias("tmin"),
        (F.sum(F.when(F.col("l_discount") >= 0.1, qty).otherwise(F.lit(0.0))) / 100.0).alias("prcp"),
        F.avg(qty).alias("awnd"),
        (F.avg(tax) * 1000.0).alias("rhav"),
        (F.min(tax) * 1000.0).alias("rhmn"),
        (F.max(tax) * 1000.0).alias("rhmx"),
        (F.avg(ep) / 1000.0).alias("aslp"),
        (F.avg(F.col("l_suppkey")) % 360).cast("double").alias("wdf2"),
    ]
    if with_description:
        order = F.struct(ep, -F.col("l_orderkey"), -F.col("l_linenumber").cast("long"))
        aggs.append(F.max_by(F.col("l_returnflag"), order).alias("weather_description"))
    return li.groupBy(time_bucket("l_shipdate", width).alias("ts")).agg(*aggs)


def readings_events(spark: SparkSession, sf_dir: str, width: str = "5 minutes") -> DataFrame:
    """Sub-daily long readings from events (sensor = event_type)."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    return (ev.groupBy(time_bucket("ts", width).alias("ts"), F.col("event_type").alias("sensor_id"))
              .agg(F.avg(clean_double("value")).alias("value")))


def weather_events(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """B2 below the day: one weather row per bucket of the events, so that hours of the day
    (rush hour) take part."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    v = clean_double("value")
    wet = (F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)
    return ev.groupBy(time_bucket("ts", width).alias("ts")).agg(
        (F.max(v) / 4.0).alias("tmax"), (F.min(v) / 4.0).alias("tmin"),
        (F.sum(F.when(wet, v).otherwise(F.lit(0.0))) / 100.0).alias("prcp"),
        (F.avg(v) / 5.0).alias("awnd"), F.avg((F.col("user_id") % 100).cast("double")).alias("rhav"))


def readings_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many raw series, one per user, tie-broken by event_id."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    return ev.select("ts", F.col("user_id").cast("string").alias("sensor_id"),
                     clean_double("value").alias("value"), "event_id")


def history_events(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """B7 on the driver tables: training-history-shaped rows derived from events.

    model = event_type, variant = baseline (even user_id) or enhanced (odd),
    epoch = 1.. over the buckets present in the group, metrics from the bucket's values.
    """
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    v = clean_double("value")
    daily = (ev.groupBy(F.col("event_type").alias("model"),
                        F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("enhanced").alias("variant"),
                        time_bucket("ts", width).alias("day"))
               .agg((F.avg(v) / 10.0).alias("loss"),
                    (F.avg(F.abs(v - 25.0)) / 10.0).alias("val_loss"),
                    (F.min(v) / 10.0).alias("mae"),
                    (F.max(v) / 10.0).alias("val_mae"),
                    F.count(v).cast("double").alias("mape"),
                    F.countDistinct("user_id").cast("double").alias("val_mape"),
                    (F.avg(v * v) / 100.0).alias("mse"),
                    (F.avg(F.abs(v - 25.0) * F.abs(v - 25.0)) / 100.0).alias("val_mse"),
                    (F.lit(1.0) - F.avg(v) / 50.0).alias("r2"),
                    (F.lit(1.0) - F.avg(F.abs(v - 25.0)) / 25.0).alias("val_r2"),
                    F.lit(1e-4).alias("lr")))
    # one row a bucket: a run is as long as the time span, whatever the number of events
    in_run = Window.partitionBy("model", "variant").orderBy("day")
    return daily.withColumn("epoch", F.row_number().over(in_run).cast("long")).drop("day")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic metrics fixture (not a forecast) on the daily B1 series."""
    return predictions_of(readings_orders(spark, sf_dir, "1 day"), weather_ship(spark, sf_dir, "1 day"))


def predictions_of(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """y_true = row mean over sensors; baselines: linear = previous value, forest =
    mean of the previous 5, boosted = mean of the previous 15 (full windows);
    enhanced = 0.5 * (baseline + y_true) + 0.001 * awnd of the same bucket. Rows
    with a NULL prediction are dropped."""
    from flowcast.operators import ordered

    y = readings.groupBy("ts").agg(F.avg("value").alias("y_true"))
    idx = ordered.with_row_index(y, ["ts"])
    base = ordered.halo_window(idx, lambda w: {
        "linear": F.lag("y_true", 1).over(w),
        "forest": ordered.full_avg("y_true", w, 5, offset=1),
        "boosted": ordered.full_avg("y_true", w, 15, offset=1),
    }, back=15).drop(ordered.RN)
    long = base.unpivot(["ts", "y_true"], ["linear", "forest", "boosted"], "model", "base_pred")
    j = long.join(weather.select("ts", "awnd"), "ts", "left")
    better = F.lit(0.5) * (F.col("base_pred") + F.col("y_true")) + F.lit(0.001) * F.col("awnd")
    # both variants from one pass over the rows
    both = F.inline(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("base_pred").alias("y_pred")),
                            F.struct(F.lit("enhanced").alias("variant"), better.alias("y_pred"))))
    return j.select("ts", "model", "y_true", both).select("ts", "model", "variant", "y_true", "y_pred") \
        .where(F.col("y_pred").isNotNull())
