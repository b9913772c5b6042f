"""Forecasters fitted once, saved, and loaded: statistics, predictions, errors."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from flowcast.operators.scale import zscore_population
from flowcast.plans import forecaster as FC
from flowcast.session import scratch_path


def _rows(spark, n=160, start=0, shift=0.0):
    rnd = random.Random(9 + start)
    rows, level = [], 0.0
    for i in range(start, start + n):
        a = rnd.uniform(-5, 5) + shift
        rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, 3.0 * level + 1.0, 7.0, "other"))
        level = a
    return spark.createDataFrame(rows, "ts timestamp_ntz, `a b` double, y2 double, same double, note string")


def test_scaler_equals_the_operator_and_survives_saving(spark):
    df, cols = _rows(spark), ["a b", "same"]
    model = FC.PopulationScaler(cols=cols).fit(df)
    path = scratch_path(spark, "scaler")
    model.write().save(path)
    loaded = FC.PopulationScalerModel.load(path)
    assert loaded.statistics() == model.statistics()
    got, want = loaded.transform(df).orderBy("ts").collect(), zscore_population(df, cols).orderBy("ts").collect()
    for g, w in zip(got, want):
        assert g["a b"] == pytest.approx(w["a b"], abs=1e-12) and g["same"] == w["same"] == 0.0
        assert g["note"] == "other"
    back = loaded.inverse(loaded.transform(df), cols).orderBy("ts").collect()
    assert [r["a b"] for r in back] == pytest.approx([r["a b"] for r in df.orderBy("ts").collect()])


def test_new_rows_are_scaled_by_the_old_statistics(spark):
    model = FC.PopulationScaler(cols=["a b"]).fit(_rows(spark))
    new = _rows(spark, start=160, shift=1000.0)
    assert model.transform(new).agg(F.avg("a b")).first()[0] > 100


def test_a_column_without_a_value_cannot_be_fitted(spark):
    df = _rows(spark).withColumn("none", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="none"):
        FC.PopulationScaler(cols=["a b", "none"]).fit(df)
    null = FC.PopulationScaler(cols=["a b"]).fit(df).transform(df.limit(1).withColumn("a b", F.lit(None).cast("double")))
    assert null.first()["a b"] is None


@pytest.mark.parametrize("name,sizes", [("linear", {"reg": 0.0}), ("boosted", {"rounds": 4}), ("forest", {"trees": 4})])
def test_a_loaded_forecaster_predicts_the_same(spark, name, sizes):
    train, new = _rows(spark), _rows(spark, start=160, shift=1.0)
    model = FC.forecaster(["a b", "y2"], "y2", length=3, name=name, **sizes).fit(train)
    path = scratch_path(spark, f"forecaster-{name}")
    model.write().save(path)
    loaded = FC.load_forecaster(path)
    ours = model.transform(new).select("seq_idx", "ts", "y", "prediction").orderBy("seq_idx").collect()
    theirs = loaded.transform(new).select("seq_idx", "ts", "y", "prediction").orderBy("seq_idx").collect()
    assert ours == theirs and len(ours) == 160 - 3
    if name == "linear":  # the label is three times the input one row before it, plus one
        plain = FC.unscaled(loaded, loaded.transform(new), ["y", "prediction"]).collect()
        assert all(abs(r["y"] - r["prediction"]) < 1e-6 for r in plain)


def test_other_pipelines_are_refused(spark):
    path = scratch_path(spark, "other")
    Pipeline(stages=[FC.PopulationScaler(cols=["a b"])]).fit(_rows(spark)).write().save(path)
    with pytest.raises(ValueError):
        FC.load_forecaster(path)


def test_a_table_shorter_than_the_window_has_no_forecast(spark):
    model = FC.forecaster(["a b"], "y2", length=3, reg=0.01).fit(_rows(spark))
    assert model.transform(_rows(spark, n=3)).count() == 0
