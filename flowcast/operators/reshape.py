"""Long/wide reshaping (A3) and profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast.functions.columns import with_scalars
from flowcast.operators import ordered
from flowcast.session import cut_lineage


def to_long(df: DataFrame, sensors: Sequence[str] | None = None, ts: str = "ts",
            name: str = "sensor_id", value: str = "value") -> DataFrame:
    """Wide (ts, sensors...) -> long (ts, sensor_id, value); NULL cells are kept."""
    sensors = list(sensors) if sensors is not None else [c for c in df.columns if c != ts]
    return df.unpivot([ts], sensors, name, value)


def sensor_values(df: DataFrame, name: str = "sensor_id") -> list[str]:
    """Distinct sensor ids (metadata: one value per sensor column). Bounded like
    Spark's own pivot: at most ``spark.sql.pivotMaxValues`` ids are fetched. Readings
    without a sensor raise an error: no column could hold them."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    ids = [r[0] for r in df.select(name).distinct().limit(limit + 1).collect()]
    if None in ids:
        raise ValueError(f"readings without a {name}: a wide frame has no column for them")
    if len(ids) > limit:
        raise ValueError(f"more than {limit} distinct values in {name!r}: use to_array, which has no such limit")
    return sorted(ids)


def _one_value(value: Column, duplicates: str, name: str, ts: str) -> Column:
    """The value of one cell from all its readings; NULL readings never count."""
    if duplicates == "mean":
        return F.avg(value)
    if duplicates in ("min", "max"):
        return getattr(F, duplicates)(value)
    if duplicates != "error":
        raise ValueError(f"unknown rule for duplicates {duplicates!r}")
    # min = max also lets through a reading that is stored twice
    return F.when(F.coalesce(F.min(value) != F.max(value), F.lit(False)), F.raise_error(F.lit(
        f"two readings of one {name} and {ts} differ; pass duplicates='mean', 'min' or 'max'")).cast("double")) \
        .otherwise(F.min(value))


def to_wide(df: DataFrame, sensors: Sequence[str] | None = None, ts: str = "ts",
            name: str = "sensor_id", value: str = "value", duplicates: str = "error") -> DataFrame:
    """Long -> wide with one column per sensor. Pass the sensor list to avoid the
    distinct-values job that ``pivot`` would otherwise run; a reading of a sensor that is
    not in it, or of none, raises an error, since the wide frame would lose it.

    ``duplicates`` says what becomes of several readings of one sensor and time: ``error``
    (default) if their values differ, else ``mean``, ``min`` or ``max``. NULL readings give
    way to others."""
    sensors = list(sensors) if sensors is not None else sensor_values(df, name)
    # checked in the value, so that the grouping keys stay columns and need no new shuffle
    lost = F.raise_error(F.concat(F.lit(f"{name} not in the given list {sensors}: "),
                                  F.coalesce(F.col(name).cast("string"), F.lit("NULL"))))
    listed = F.when(F.coalesce(F.col(name).isin(sensors), F.lit(False)), F.col(value)).otherwise(
        lost.cast(df.schema[value].dataType))
    return (df.select(ts, name, listed.alias(value)).groupBy(ts).pivot(name, sensors)
            .agg(_one_value(F.col(value), duplicates, name, ts)))


def sensor_index(df: DataFrame, name: str = "sensor_id") -> DataFrame:
    """(sensor, pos): the sensors that occur, in order, numbered from 0 by the distributed
    row index, however many there are."""
    return ordered.with_row_index(df.select(name).where(F.col(name).isNotNull()).distinct(), [name], (), "pos")


def to_array(df: DataFrame, index: DataFrame | None = None, ts: str = "ts", name: str = "sensor_id",
             value: str = "value", duplicates: str = "error") -> DataFrame:
    """Long -> (ts, values ARRAY<DOUBLE>, n_present, n_sensors): the wide frame in one
    column, for any number of sensors. Position ``pos`` of ``values`` is the sensor that
    ``index`` (:func:`sensor_index`) gives it, NULL where it has no reading; ``n_present``
    counts readings. Duplicates as in :func:`to_wide`; a reading without a sensor, or of one
    that ``index`` lacks, raises an error. A row holds one value a sensor."""
    index = cut_lineage(sensor_index(df, name)) if index is None else index
    cells = df.groupBy(ts, name).agg(_one_value(F.col(value).cast("double"), duplicates, name, ts).alias("_fc_v"))
    numbered = cells.join(index.select(F.col(name).alias("_fc_sensor"), "pos"), F.col(name) == F.col("_fc_sensor"), "left")
    lost = F.raise_error(F.concat(F.lit(f"{name} is not in the index: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL"))))
    placed = numbered.select(F.col(ts), F.when(F.col("pos").isNull(), lost.cast("int")).otherwise(
        F.col("pos").cast("int")).alias("pos"), "_fc_v")
    rows = placed.groupBy(ts).agg(F.collect_list(F.struct("pos", "_fc_v")).alias("_fc_cells"),
                                  F.count("_fc_v").cast("int").alias("n_present"))
    rows, s = with_scalars(rows, index.agg(F.count(F.lit(1)).cast("int").alias("n")), "_fc_n")
    # positions without a reading are added as NULL cells, then sorting makes the row dense
    absent = F.array_except(F.sequence(F.lit(0), s["n"] - 1), F.transform("_fc_cells", lambda c: c["pos"]))
    filled = F.concat("_fc_cells", F.transform(absent, lambda p: F.struct(
        p.alias("pos"), F.lit(None).cast("double").alias("_fc_v"))))
    return rows.select(ts, F.transform(F.array_sort(filled), lambda c: c["_fc_v"]).alias("values"), "n_present",
                       s["n"].alias("n_sensors"))


def profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count, column count, first and last timestamp in one aggregation."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.min(ts).alias("ts_min"),
        F.max(ts).alias("ts_max"),
    )
