"""Unit tests on hand-made frames for the semantic traps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from flowcast.functions.columns import clean_double, guarded_clip
from flowcast.functions.weather import equal_width_level, rain_category
from flowcast.operators import clean as CL
from flowcast.operators import evaluate as EV
from flowcast.operators import ordered as O
from flowcast.operators import reshape as RS
from flowcast.operators import scale as SC
from flowcast.operators import stats as ST
from flowcast.operators import timeseries as TS
from flowcast.operators.join import holiday_flag
from flowcast.functions.calendar import us_holidays


def ts(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_nan_and_inf_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(clean_double("x")).collect()] == [1.0, None, None, None, None]


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(guarded_clip("x", F.lit(-1.0), F.lit(1.0))).collect()] == [1.0, None, -1.0]


def test_rolling_mean_needs_full_window(spark):
    df = spark.createDataFrame([(ts(i), float(i)) for i in range(6)], "ts timestamp_ntz, x double")
    out = O.rolling_means(df, "x", [3], chunk_rows=2).orderBy("ts").collect()
    assert [r["x_ma3"] for r in out] == [None, None, 1.0, 2.0, 3.0, 4.0]


def test_fewer_rows_than_window(spark):
    df = spark.createDataFrame([(ts(i), float(i)) for i in range(3)], "ts timestamp_ntz, x double")
    out = O.rolling_means(df, "x", [5]).collect()
    assert all(r["x_ma5"] is None for r in out)


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")  # a Monday
    assert df.select(F.weekday("ts")).first()[0] == 0


def test_split_sizes_golden():
    assert SC.split_sizes(31969) == (22378, 4795, 4796)
    assert SC.split_sizes(90) == (62, 13, 15)
    assert SC.split_sizes(10) == (7, 1, 2)


def test_chronological_split_on_spark(spark):
    df = spark.createDataFrame([(ts(i), float(i)) for i in range(90)], "ts timestamp_ntz, x double")
    out = SC.chronological_split(df)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 62, "val": 13, "test": 15}
    last_train = out.where("split = 'train'").agg(F.max("ts")).first()[0]
    first_val = out.where("split = 'val'").agg(F.min("ts")).first()[0]
    assert last_train < first_val


def test_random_split_holds_out_four_of_ten(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = {r["split"]: r["count"] for r in SC.random_split(df, "k").groupBy("split").count().collect()}
    assert sizes == {"train": 6, "test": 2, "val": 2}


def test_zscore_population_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a double, c double")
    out = SC.zscore_population(df, ["a", "c"]).collect()
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]
    assert abs(sum(r["a"] for r in out)) < 1e-12
    assert abs(sum(r["a"] ** 2 for r in out) / 3 - 1.0) < 1e-12


def test_zscore_sample_constant_column_fails_clearly(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, c double")
    with pytest.raises(Exception, match="constant"):
        SC.zscore_sample(df, ["a", "c"]).collect()
    assert [r["c"] for r in SC.zscore_sample(df, ["a", "c"], on_constant="null").collect()] == [None, None]


def test_iqr_filter_inclusive_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    # Q1=2, Q3=4, IQR=2 -> [-1, 7]
    assert sorted(r[0] for r in CL.iqr_filter(df, "x").collect()) == [1.0, 2.0, 3.0, 4.0]


def test_winsorising_zero_inflated_column_erases_it(spark):
    df = spark.createDataFrame([(0.0,)] * 8 + [(5.0,), (7.0,)], "prcp double")
    assert {r[0] for r in CL.iqr_clip(df, ["prcp"]).collect()} == {0.0}


def test_metrics_zero_actual_and_zero_variance(spark):
    p = spark.createDataFrame([("m", "v", 0.0, 1.0), ("m", "v", 2.0, 2.0)], "model string, variant string, y_true double, y_pred double")
    r = EV.regression_metrics(p).first()
    assert r["n_zero_actual"] == 1 and r["mape"] == 0.0
    c = spark.createDataFrame([("m", "v", 1.0, 1.0), ("m", "v", 1.0, 1.0)], "model string, variant string, y_true double, y_pred double")
    assert EV.regression_metrics(c).first()["r2"] == 1.0
    c2 = spark.createDataFrame([("m", "v", 1.0, 2.0), ("m", "v", 1.0, 1.0)], "model string, variant string, y_true double, y_pred double")
    assert EV.regression_metrics(c2).first()["r2"] == 0.0


def test_r2_improvement_in_points(spark):
    m = spark.createDataFrame([("a", "baseline", 1.0, 1.0, -0.2523, 10.0), ("a", "enhanced", 0.5, 0.5, 0.7325, 5.0)],
                              "model string, variant string, rmse double, mae double, r2 double, mape double")
    r = EV.improvements(m).first()
    assert abs(r["r2_improvement"] - 98.48) < 1e-9 and r["rmse_improvement"] == 50.0


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 9 + [(2.0, 1.0)], "b double, v double")
    with pytest.raises(Exception, match="not unique"):
        ST.quantile_bin_stats(df, "b", "v", 10).collect()


def test_rain_category_and_levels(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.5,), (1.0,), (3.0,), (None,)], "prcp double")
    cats = [r[0] for r in df.select(rain_category()).collect()]
    assert cats == ["No Rain", "Light", "Light", "Moderate", "Moderate", "Heavy", None]
    lv = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    levels = [r[0] for r in lv.select(equal_width_level("x", F.lit(0.0), F.lit(10.0), 5)).collect()]
    assert levels == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_histogram_counts_sum_and_constant_column(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = ST.histogram(df, "x", 5).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 11 and h[-1]["count"] == 3
    c = spark.createDataFrame([(2.0,)] * 4, "x double")
    hc = ST.histogram(c, "x", 2, density=True).orderBy("bin").collect()
    assert hc[0]["lower"] == 1.5 and hc[-1]["upper"] == 2.5 and sum(r["count"] for r in hc) == 4


def test_decomposition_parts_sum_and_acf_lag0(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 10 + math.sin(i * 2 * math.pi / 24) + 0.01 * i) for i in range(96)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    d = TS.seasonal_decompose(df, "x", 24, chunk_rows=30).where("trend IS NOT NULL").collect()
    assert len(d) == 96 - 24
    assert all(abs(r["trend"] + r["seasonal"] + r["resid"] - r["x"]) < 1e-9 for r in d)
    a = {r["lag"]: r["acf"] for r in TS.acf(df, "x", 5, chunk_rows=20).collect()}
    assert abs(a[0] - 1.0) < 1e-12 and a[1] > a[5]


def test_best_epoch_golden(spark):
    rows = [("m", "v", e, abs(e - 20) / 10.0 + 1) for e in range(1, 61)]
    h = spark.createDataFrame(rows, "model string, variant string, epoch long, val_loss double")
    r = EV.best_epoch(h).first()
    assert (r["best_epoch"], r["stop_epoch"], r["stopped"]) == (20, 50, True)


def test_to_wide_fails_on_a_sensor_that_is_not_listed(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (2, "c", 9.0)],
                                 "ts long, sensor_id string, value double")
    with pytest.raises(Exception, match="not in the given list"):
        RS.to_wide(long, ["a", "b"]).collect()
    assert sorted(map(tuple, RS.to_wide(long, ["a", "b", "c"]).collect())) == sorted(map(tuple, RS.to_wide(long).collect()))


def test_wide_long_round_trip(spark):
    rows = [(ts(0), "a", 1.0), (ts(0), "b", 2.0), (ts(1), "a", 3.0)]
    long = spark.createDataFrame(rows, "ts timestamp_ntz, sensor_id string, value double")
    wide = RS.to_wide(long, ["a", "b"])
    back = RS.to_long(wide, ["a", "b"]).where("value IS NOT NULL")
    assert sorted(back.collect()) == sorted(long.collect())
    assert wide.where("b IS NULL").count() == 1


def test_holidays_observed_across_year_end(spark):
    cal = {r["date"] for r in us_holidays(spark, 2021, 2022).collect()}
    assert dt.date(2021, 12, 31) in cal      # 1 Jan 2022 is a Saturday
    assert dt.date(2021, 7, 5) in cal        # 4 Jul 2021 is a Sunday
    assert dt.date(2021, 6, 18) in cal       # Juneteenth 2021 observed on Friday
    assert dt.date(2021, 11, 25) in cal      # Thanksgiving
    assert dt.date(2022, 5, 30) in cal       # Memorial Day
    assert dt.date(2020, 6, 19) not in {r["date"] for r in us_holidays(spark, 2020, 2020).collect()}
    df = spark.createDataFrame([(dt.datetime(2021, 12, 31, 8),), (dt.datetime(2021, 12, 30, 8),)], "ts timestamp_ntz")
    assert [r["is_holiday"] for r in holiday_flag(df).orderBy("ts").collect()] == [0, 1]


def test_interpolation_time_weighted(spark):
    rows = [(ts(0), 0.0), (ts(1), None), (ts(3), 3.0), (ts(4), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    out = [r["x"] for r in O.interpolate_time(df, ["x"], chunk_rows=1).orderBy("ts").collect()]
    assert out == [0.0, 1.0, 3.0, 3.0]
    lead = spark.createDataFrame([(ts(0), None), (ts(1), 2.0)], "ts timestamp_ntz, x double")
    assert [r["x"] for r in O.interpolate_time(lead, ["x"]).orderBy("ts").collect()] == [None, 2.0]


def test_quantile_methods_agree(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = CL.quantiles(li, ["l_extendedprice", "l_tax"], [0.1, 0.5, 0.95]).first()
    b = li.agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_q{round(p * 100):02d}")
                 for c in ("l_extendedprice", "l_tax") for p in (0.1, 0.5, 0.95)]).first()
    c = CL.quantiles(li, ["l_extendedprice", "l_tax"], [0.1, 0.5, 0.95]).first()
    assert all(abs(a[k] - b[k]) < 1e-9 and abs(c[k] - b[k]) < 1e-9 for k in b.asDict())


def test_degenerate_inputs_do_not_raise(spark):
    const = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 3.0) for i in range(60)],
                                  "ts timestamp_ntz, x double")
    assert all(r["density"] is None for r in ST.kde(const, "x", 5).collect())
    assert all(r["acf"] is None for r in TS.acf(const, "x", 3).collect())
    empty = spark.createDataFrame([], "x double")
    h = ST.histogram(empty, "x", 4, density=True).collect()
    assert len(h) == 4 and all(r["count"] == 0 for r in h)
    p = spark.createDataFrame([("m", "v", -1e-7, 1.0)], "model string, variant string, y_true double, y_pred double")
    assert EV.combined_loss(p).first()["mape_eps"] is None


def test_csv_reader_maps_nan_inf_and_blank_to_null(spark, tmp_path):
    p = tmp_path / "traffic"
    p.mkdir()
    (p / "part-0.csv").write_text("ts,s1,s2\n2024-01-01 00:00:00,1.5,NaN\n2024-01-01 00:05:00,,inf\n"
                                  "2024-01-01 00:10:00,-Infinity,2\n")
    from flowcast.sources.csv import read_traffic
    rows = read_traffic(spark, str(p)).orderBy("ts").collect()
    assert [(r["s1"], r["s2"]) for r in rows] == [(1.5, None), (None, None), (None, 2.0)]
    assert rows[1]["ts"] == dt.datetime(2024, 1, 1, 0, 5)


def test_fit_on_train_uses_only_train_rows(spark):
    from flowcast.plans.prepare import prepare_dataset
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), s, float(100 + i + (5 if s == "b" else 0)))
            for i in range(120) for s in ("a", "b")]
    long = spark.createDataFrame(rows, "ts timestamp_ntz, sensor_id string, value double")
    all_fit = prepare_dataset(long, None, length=5, width="1 day", sensors=["a", "b"], checkpoint=False)
    train_fit = prepare_dataset(long, None, length=5, width="1 day", sensors=["a", "b"], fit_on="train",
                                checkpoint=False)
    ya = {r["seq_idx"]: r["y"] for r in all_fit.collect()}
    yt = {r["seq_idx"]: r["y"] for r in train_fit.collect()}
    assert ya.keys() == yt.keys() and len(ya) == 120 - 29 - 5
    # a trending series scaled on its early part has a larger mean label than when scaled on all rows
    assert sum(yt.values()) > sum(ya.values())
    assert abs(sum(ya.values()) / len(ya)) < 0.5


@pytest.mark.parametrize("tstype", ["timestamp_ntz", "timestamp"])
def test_resample_gap_fill_keeps_timestamp_type(spark, tstype):
    rows = [(dt.datetime(2024, 1, 1, 0, 1), 1.0), (dt.datetime(2024, 1, 1, 0, 2), 3.0), (dt.datetime(2024, 1, 1, 0, 16), 5.0)]
    df = spark.createDataFrame(rows, f"ts {tstype}, x double")
    out = ST.resample_mean(df, "5 minutes").orderBy("ts").collect()
    assert [r["x"] for r in out] == [2.0, None, None, 5.0]
    assert ST.resample_mean(df, "5 minutes").schema["ts"].dataType.typeName() == df.schema["ts"].dataType.typeName()


def test_unscaling_inverts_the_population_zscore(spark):
    rows = [(1, 2.0, 7.0), (2, -3.5, 7.0), (3, None, 7.0), (4, 10.0, 7.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    back = SC.unscale_population(SC.zscore_population(df, ["a", "b"]), ["a", "b"], df)
    got = sorted(tuple(r) for r in back.collect())
    assert [r[1] is None for r in got] == [False, False, True, False]
    assert all(abs((x or 0) - (y or 0)) < 1e-12 for g, r in zip(got, rows) for x, y in zip(g, r))


def test_one_column_can_scale_another(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 0.0)], "y double, p double")
    z = SC.zscore_population(df, ["y", "p"], of="y")
    assert sorted(tuple(r) for r in z.collect()) == [(-1.0, 2.0), (1.0, -2.0)]
    assert sorted(tuple(r) for r in SC.unscale_population(z, ["p"], df, of="y").collect()) == [(-1.0, 4.0), (1.0, 0.0)]


def test_correlation_with_a_column_that_does_not_vary(spark):
    rows = [(1.0, 7.0, 3.0, None), (2.0, 7.0, 1.0, 4.0), (4.0, 7.0, 2.0, None), (None, 8.0, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "t double, same double, x double, `one pair` double")
    got = {r[0]: r[1] for r in CL.select_by_correlation(df, "t", ["same", "x", "one pair"], 0.1).collect()}
    # constant where the target has values: NaN, as in the SQL twin, and no error
    assert math.isnan(got["same"]) and math.isnan(got["one pair"])
    assert got["x"] == pytest.approx(-0.32732683535398865)
    assert CL.select_by_correlation(df.where("t is null"), "t", ["x"], 0.1).collect() == []
    assert ST.corr_pair(df, "t", "same").first()["corr"] is None
    assert ST.corr_pair(df, "t", "x").first()["corr"] == pytest.approx(-0.32732683535398865)
