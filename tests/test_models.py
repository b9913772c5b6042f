"""Model tests: importance finds the planted feature, fits are deterministic."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowcast.plans import experiment as XP


def _windows(spark, n=240, seed=3):
    """Sequences of 2 steps x 2 features; y depends only on feature 0."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [[rnd.uniform(-1, 1), rnd.uniform(-1, 1)] for _ in range(2)]
        y = 2.0 * x[0][0] + 1.5 * x[1][0] + rnd.gauss(0, 0.01)
        split = "train" if i < n * 0.7 else ("val" if i < n * 0.85 else "test")
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), y, split, x))
    df = spark.createDataFrame(rows, "seq_idx long, ts timestamp_ntz, y double, split string, x array<array<double>>")
    return XP.vectorised(df)


def test_permutation_importance_finds_planted_feature(spark):
    data = _windows(spark)
    model = XP.fit("linear", data)
    imp = {r["feature"]: r["importance"] for r in
           XP.permutation_importance(model, data, ["signal", "noise"], repeats=3).collect()}
    assert imp["signal"] > 0.5
    assert abs(imp["noise"]) < 0.05
    pert = {r["feature"]: r["importance"] for r in
            XP.permutation_importance(model, data, ["signal", "noise"], repeats=2, score="perturbation").collect()}
    assert pert["signal"] > 10 * max(pert["noise"], 1e-12)


def test_same_seed_same_predictions(spark):
    data = _windows(spark)
    a = XP.predict(XP.fit("forest", data, seed=7), data, "forest", "v").orderBy("ts").collect()
    b = XP.predict(XP.fit("forest", data, seed=7), data, "forest", "v").orderBy("ts").collect()
    assert [r["y_pred"] for r in a] == [r["y_pred"] for r in b]


def test_block_rescoring_equals_swapped_windows(spark):
    data = _windows(spark)
    model = XP.fit("linear", data)
    for score in ("r2", "perturbation"):
        a, b = ({r["feature"]: (r["importance"], r["importance_std"]) for r in
                 XP.permutation_importance(model, data, ["signal", "noise"], repeats=3, score=score, method=m).collect()}
                for m in ("block", "swap"))
        assert a.keys() == b.keys() == {"signal", "noise"}
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_permutations_are_permutations(spark):
    data = _windows(spark, n=90).select("seq_idx")
    got = XP.permutations(data, 3, 42).collect()
    assert len(got) == 270
    orders = []
    for k in range(3):
        mine = sorted((r["seq_idx"], r["donor"]) for r in got if r["repeat"] == k)
        assert [r[0] for r in mine] == sorted(r[1] for r in mine) == list(range(90))
        orders.append([r[1] for r in mine])
    assert orders[0] != orders[1] != orders[2] and orders[0] != list(range(90))


def _curve(spark, losses):
    rows = [(i + 1, s, float(v) + (s == "train")) for i, v in enumerate(losses) for s in ("train", "val")]
    return spark.createDataFrame(rows, "iteration int, split string, loss double")


def test_a_later_dip_within_the_patience_is_restored(spark):
    dips_twice = _curve(spark, [9, 5, 6, 7, 8, 7, 6, 4, 5, 6, 7, 8, 9])
    assert XP.best_iteration(dips_twice, patience=30) == 8
    assert XP.best_iteration(dips_twice, patience=6) == 8
    assert XP.best_iteration(dips_twice, patience=5) == 2  # stopped before the second dip
    assert XP.best_iteration(_curve(spark, [5, 5 - 1e-6, 5 - 2e-6]), min_delta=1e-5) == 1
    assert XP.best_iteration(dips_twice.where("split = 'train'")) is None


def test_cut_ensemble_predicts_with_its_first_trees(spark):
    data = _windows(spark)
    train = data.where("split = 'train'")
    model = XP.estimator("boosted", rounds=6).fit(train)
    short = XP.cut_ensemble(model, 2)
    assert short.getNumTrees == 2 and XP.cut_ensemble(model, None) is model
    first, second = (t.setPredictionCol(c).transform for t, c in zip(model.trees[:2], ("t0", "t1")))
    both = second(first(short.transform(data))).select("prediction", (
        F.col("t0") * model.treeWeights[0] + F.col("t1") * model.treeWeights[1]).alias("want"))
    assert both.where(F.abs(F.col("prediction") - F.col("want")) > 1e-9).count() == 0


def test_boosted_is_cut_to_its_best_validation_iteration(spark):
    data = _windows(spark)
    full = XP.estimator("boosted", rounds=12).fit(data.where("split = 'train'"))
    best = XP.best_iteration(XP.iteration_metrics(full, data), patience=3)
    model = XP.fit("boosted", data, rounds=12, patience=3)
    assert model.getNumTrees == best
    it = XP.iteration_metrics(model, data)
    assert it.where(F.col("split") == "val").count() == model.getNumTrees


def test_without_training_rows_there_is_no_model(spark):
    data = _windows(spark).where("split = 'test'")
    for name in XP.MODELS:
        model = XP.fit(name, data)
        assert model is None
        assert XP.predict(model, data, name, "v").collect() == []
        assert XP.weight_importance(model, ["a", "b"], 2, name).collect() == []
    assert XP.iteration_metrics(None, data).collect() == []
    assert XP.permutation_importance(None, data, ["a", "b"]).collect() == []


def test_many_windows_are_spread_over_tasks_in_one_order(spark):
    from flowcast.plans.prepare import prepare_dataset
    day = dt.datetime(2020, 1, 1)
    rows = [(day + dt.timedelta(days=i), s, 50.0 + (i * k) % 13) for i in range(400) for s, k in (("a", 5), ("b", 7))]
    readings = spark.createDataFrame(rows, "ts timestamp_ntz, sensor_id string, value double")

    def windows(**kw):
        return prepare_dataset(readings, None, length=6, width="1 day", sensors=["a", "b"], **kw)

    one, many = windows(), windows(task_rows=64)
    sizes = many.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert many.rdd.getNumPartitions() == 6 and len(sizes) > 2 and max(r["count"] for r in sizes) < 200
    want = [tuple(r) for r in one.orderBy("seq_idx").collect()]
    assert [tuple(r) for r in many.orderBy("seq_idx").collect()] == want and len(want) == 365
    # samples of a forest follow the order of rows in a task
    assert many.select("seq_idx").collect() == windows(task_rows=64).select("seq_idx").collect()
    assert windows(task_rows=400).rdd.getNumPartitions() == one.rdd.getNumPartitions()
