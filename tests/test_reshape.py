"""Long, wide and array layouts: duplicates, lost sensors, and more sensors than columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowcast.operators import reshape as RS
from flowcast.plans.prepare import prepare_dataset

SCHEMA = "ts long, sensor_id string, value double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_duplicates_are_defined(spark):
    same = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "a", None), (1, "b", 2.0)], SCHEMA)
    assert rows_of(RS.to_wide(same, ["a", "b"])) == [(1, 1.0, 2.0)]
    assert rows_of(RS.to_array(same)) == [(1, [1.0, 2.0], 2, 2)]
    differ = spark.createDataFrame([(1, "a", 1.0), (1, "a", 9.0), (2, "a", 3.0)], SCHEMA)
    for run in (lambda: RS.to_wide(differ), lambda: RS.to_wide(differ, ["a"]), lambda: RS.to_array(differ)):
        with pytest.raises(Exception, match="differ"):
            run().collect()
    for rule, want in (("mean", 5.0), ("min", 1.0), ("max", 9.0)):
        assert rows_of(RS.to_wide(differ, ["a"], duplicates=rule)) == [(1, want), (2, 3.0)]
        assert rows_of(RS.to_array(differ, duplicates=rule)) == [(1, [want], 1, 1), (2, [3.0], 1, 1)]
    with pytest.raises(ValueError, match="unknown rule"):
        RS.to_wide(differ, ["a"], duplicates="any")


def test_a_reading_without_a_sensor_is_never_lost(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, "a", 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="without a sensor_id"):
        RS.to_wide(df)
    for run in (lambda: RS.to_wide(df, ["a"]), lambda: RS.to_array(df)):
        with pytest.raises(Exception, match="NULL"):
            run().collect()
    other = spark.createDataFrame([(1, "z", 5.0)], SCHEMA)
    with pytest.raises(Exception, match="not in the index"):
        RS.to_array(other, RS.sensor_index(df.where("sensor_id is not null"))).collect()


def test_array_layout_is_dense(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "c", 3.0), (2, "a", None), (3, "a", 1.0), (3, "b", 2.0), (3, "c", 3.0)], SCHEMA)
    assert rows_of(RS.to_array(df)) == [(1, [None, 2.0, None], 1, 3), (2, [None, None, 3.0], 1, 3), (3, [1.0, 2.0, 3.0], 3, 3)]
    assert RS.to_array(df.where("ts > 9")).collect() == []


def _readings(spark, times, sensors):
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    grid = spark.range(times * sensors).select((F.col("id") % times).alias("t"), F.floor(F.col("id") / times).alias("s"))
    value = 50 + F.sin(F.col("t") / 5) + F.pmod(F.xxhash64("t", "s"), F.lit(1000)) / 1000
    return grid.select((start + F.make_dt_interval(F.col("t"))).cast("timestamp_ntz").alias("ts"),
                       F.format_string("s%05d", "s").alias("sensor_id"), value.alias("value"))


def test_preparation_in_both_layouts(spark):
    readings = _readings(spark, 80, 5).where("not (sensor_id = 's00003' and day(ts) = 9)")
    wide = prepare_dataset(readings, None, length=6, width="1 day", fit_on="train")
    array = prepare_dataset(readings, None, length=6, width="1 day", fit_on="train", layout="array")
    a, b = ({r["seq_idx"]: r for r in d.collect()} for d in (wide, array))
    assert a.keys() == b.keys() and len(a) > 30
    for i, r in a.items():
        assert (r["ts"], r["split"]) == (b[i]["ts"], b[i]["split"])
        assert r["y"] == pytest.approx(b[i]["y"], abs=1e-9)
        for u, v in zip(r["x"], b[i]["x"], strict=True):
            assert u == pytest.approx(v, abs=1e-9)


def test_preparation_of_twenty_thousand_sensors(spark):
    out = prepare_dataset(_readings(spark, 44, 20_000), None, length=4, width="1 day", layout="array")
    shape = out.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.min(F.size(F.get("x", F.lit(0))))).first()
    # 44 days, 29 lost to the longest moving average, at most some to the outlier filter
    assert 5 <= shape[0] <= 44 - 29 - 4
    assert tuple(shape)[1:] == (4, 4, 20_000 + 1 + 4 + 3 + 4)
