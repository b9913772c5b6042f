"""History files in their real layout, wide CSVs with odd cells, streaming in any order,
keyed gap fill and repeatable augmentation."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowcast.operators import scale as SC
from flowcast.operators import stats as ST
from flowcast.sources import csv as CSV
from flowcast.streaming.resample import EVENTS_SCHEMA, stream_resample
from tests.conftest import SF_SMALL

HEADER = "loss,val_loss,mae,val_mae,mape,val_mape,mse,val_mse,r2,val_r2,lr"


def test_history_files_without_epoch(spark, tmp_path):
    for run, first in (("lstm_baseline", 1.0), ("gru_net_enhanced", 5.0)):
        lines = [",".join(str(first + e + c / 100) for c in range(11)) for e in range(40)]
        (tmp_path / f"{run}_history.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    got = CSV.read_history(spark, str(tmp_path)).collect()
    assert len(got) == 80
    for r in got:
        first = 1.0 if r["model"] == "lstm" else 5.0
        assert r["variant"] == ("baseline" if r["model"] == "lstm" else "enhanced")
        assert r["loss"] == first + r["epoch"] - 1 and r["lr"] == pytest.approx(first + r["epoch"] - 1 + 0.10)
    assert {r["epoch"] for r in got} == set(range(1, 41))


def test_history_with_another_header_fails(spark, tmp_path):
    (tmp_path / "lstm_baseline_history.csv").write_text("epoch," + HEADER + "\n" + ",".join("1" * 12) + "\n")
    with pytest.raises(Exception):
        CSV.read_history(spark, str(tmp_path)).collect()


def test_junk_cells_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ts,a,b\n2024-01-01 00:00:00,1.5,junk\nnever,,2\n")
    rows = CSV.read_traffic(spark, str(tmp_path / "t.csv")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1.5, None), (None, 2.0)]
    assert rows[0]["ts"] == dt.datetime(2024, 1, 1) and rows[1]["ts"] is None


def test_stream_over_files_in_reverse_order_equals_the_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(*EVENTS_SCHEMA.names)
    days = sorted(r[0] for r in ev.select(F.to_date("ts")).distinct().collect())[:4]
    for d in reversed(days):  # newest first: modification times follow
        ev.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    part = ev.where(F.to_date("ts").isin(days))
    want = ST.resample_mean(part, "5 minutes", ["value"], keys=["event_type"], gap_fill=False)
    got = stream_resample(spark, str(tmp_path / "in"), EVENTS_SCHEMA, max_files_per_trigger=1)
    key = lambda r: (r[0], r[1])
    a = sorted(((r["ts"], r["sensor_id"], r["value"]) for r in got.collect()), key=key)
    b = sorted(((r["ts"], r["event_type"], r["value"]) for r in want.collect()), key=key)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b))


def test_stream_over_a_folder_without_files_is_empty(spark, tmp_path):
    assert stream_resample(spark, str(tmp_path), EVENTS_SCHEMA).collect() == []


def test_gap_fill_per_key(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(t(0), "a", 1.0), (t(3), "a", 4.0), (t(5), "b", 2.0), (t(1), None, 3.0), (t(2), None, 5.0)],
                               "ts timestamp_ntz, k string, v double")
    got = sorted(((r["k"] or "", r["ts"], r["v"]) for r in ST.resample_mean(df, "1 hour", ["v"], keys=["k"]).collect()))
    assert got == sorted([("a", t(0), 1.0), ("a", t(1), None), ("a", t(2), None), ("a", t(3), 4.0), ("b", t(5), 2.0),
                          ("", t(1), 3.0), ("", t(2), 5.0)], key=lambda r: r[:2])


def test_augmentation_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select("id", (F.col("id") * 1.0).alias("x"))
    one = SC.augment(df.coalesce(1), ["x"], F.col("id"))
    many = SC.augment(df.repartition(7), ["x"], F.col("id"))
    assert one.exceptAll(many).count() == 0 and one.count() == 9000
    noise = SC.augment_noise(df, ["x"], F.col("id"), sigma=2.0).select((F.col("x") - F.col("id")).alias("e"))
    r = noise.agg(F.avg("e"), F.stddev("e")).first()
    assert abs(r[0]) < 0.15 and abs(r[1] - 2.0) < 0.15
    ratio = SC.augment_scale(df.where("id > 0"), ["x"], F.col("id")).select((F.col("x") / F.col("id")).alias("e"))
    r = ratio.agg(F.min("e"), F.max("e"), F.avg("e")).first()
    assert r[0] >= 0.95 and r[1] <= 1.05 and abs(r[2] - 1.0) < 0.003


def _mixed_files(path):
    (path / "a.csv").write_text("﻿,s1,s2\n2024-01-01 00:00:00,1,2\n2024-01-01 00:05:00,x,4\n")
    (path / "b.csv").write_text(',s2,s1,"s,3"\n2024-01-02 00:00:00,20,10,5\nnever,,NaN,7\n')
    (path / "c.csv").write_text("")


def test_values_follow_each_files_own_header(spark, tmp_path):
    _mixed_files(tmp_path)
    audit = Observation("audit")
    rows = CSV.read_traffic(spark, str(tmp_path), audit=audit).collect()
    assert rows[0].asDict().keys() == {"ts", "s1", "s2", "s,3"}
    got = sorted(((r["s1"], r["s2"], r["s,3"]) for r in rows), key=str)
    assert got == sorted([(1.0, 2.0, None), (None, 4.0, None), (10.0, 20.0, 5.0), (None, None, 7.0)], key=str)
    assert audit.get == {"n_rows": 4, "n_bad_times": 1, "n_bad_cells": 1}
    bad = {r["column"]: tuple(r)[1:] for r in CSV.bad_cells(spark, str(tmp_path)).collect()}
    assert bad == {"ts": (4, 0, 1), "s1": (4, 1, 1), "s2": (4, 1, 0), "s,3": (4, 2, 0)}


def test_chosen_columns_and_header_errors(spark, tmp_path):
    _mixed_files(tmp_path)
    rows = CSV.read_weather(spark, str(tmp_path), ["s2"]).collect()
    assert sorted((r["s2"] for r in rows), key=str) == [2.0, 20.0, 4.0, None]
    with pytest.raises(ValueError, match="in no header"):
        CSV.read_weather(spark, str(tmp_path), ["s9"])
    (tmp_path / "d.csv").write_text("t,s1,s1\n2024-01-01 00:00:00,1,2\n")
    with pytest.raises(ValueError, match="is twice"):
        CSV.read_weather(spark, str(tmp_path))


def test_a_large_file_keeps_its_header_over_its_splits(spark, tmp_path):
    lines = [f"2024-01-01 00:00:{i % 60:02d},{i},{-i}" for i in range(30_000)]
    (tmp_path / "big.csv").write_text("\n".join(["ts,b,a", *lines]) + "\n")
    (tmp_path / "small.csv").write_text("ts,a,b\n2024-01-01 00:00:00,7,8\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = CSV.read_traffic(spark, str(tmp_path), ["a", "b"])
        assert df.rdd.getNumPartitions() > 3
        r = df.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    total = sum(range(30_000))
    assert tuple(r) == (30_001, 7.0 - total, 8.0 + total)
