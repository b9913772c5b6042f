"""Mergeable quantile sketches: rank error, exact parts, merging, odd groups."""

import numpy as np
import pytest

from flowcast.operators import clean as CL
from flowcast.operators import sketch as SK
from flowcast.operators import stats as ST

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def _data(kind, n=60_000):
    rng = np.random.default_rng(5)
    return {"normal": rng.normal(50, 4, n), "skewed": rng.exponential(3, n) ** 3,
            "lumps": np.where(rng.random(n) < 0.34, 7.0, rng.integers(0, 90, n)).astype(float)}[kind]


def _rank_errors(values, found):
    x = np.sort(values)
    lo, hi = np.searchsorted(x, found, "left") / len(x), np.searchsorted(x, found, "right") / len(x)
    return [max(a - p, p - b, 0.0) for p, a, b in zip(PROBS, lo, hi)]


@pytest.mark.parametrize("kind", ["normal", "skewed", "lumps"])
@pytest.mark.parametrize("k", [200, SK.K])
def test_rank_error_is_under_its_bound(spark, kind, k):
    values = _data(kind)
    df = spark.createDataFrame(values.reshape(-1, 1), "x double").repartition(7)
    row = SK.approx_quantiles(df, "x", PROBS, k=k).first()
    # twice the 99 % bound: a run in millions fails
    assert max(_rank_errors(values, list(row))) <= 2 * SK.rank_error(k)
    assert (row[0], row[-1]) == (values.min(), values.max())


def test_merged_sketches_agree_with_all_rows(spark):
    values = _data("skewed")
    rows = [(int(i % 3), int(i % 11), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, h int, x double")
    first = SK.quantile_sketches(df.where("h < 6"), ["x"], ["g", "h"])
    later = SK.quantile_sketches(df.where("h >= 6"), ["x"], ["g", "h"])
    merged = SK.merge_sketches(first.unionByName(later), ["g"])
    got = SK.sketch_quantiles(merged.withColumn("n", SK.sketch_count()), PROBS).collect()
    assert len(got) == 3 and sum(r["n"] for r in got) == len(values)
    for r in got:
        own = values[r["g"]::3]
        assert r["n"] == len(own)
        assert max(_rank_errors(own, [r[f"q{i}"] for i in range(len(PROBS))])) <= 2 * SK.rank_error()


def test_small_groups_are_exact_and_odd_values_left_out(spark):
    rows = [("a", float(v), 1.0) for v in range(100)] + [("b", None, 2.0), ("b", float("nan"), 3.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, `y z` double")
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in SK.approx_quantiles(df, "x", [0, 0.5, 1], ["g"]).collect()}
    assert got == {"a": (0.0, 49.0, 99.0), "b": (None, None, None), None: (5.0, 5.0, 5.0)}
    both = SK.sketch_quantiles(SK.quantile_sketches(df, ["x", "y z"]), [1.0], ["top"]).collect()
    assert {(r["column"], r["top"]) for r in both} == {("x", 99.0), ("y z", 3.0)}
    none = SK.approx_quantiles(df.limit(0), "x", [0.5]).collect()
    assert [tuple(r) for r in none] == [(None,)]
    assert SK.approx_quantiles(df.limit(0), "x", [0.5], ["g"]).collect() == []


def test_statistics_by_sketch(spark):
    df = spark.createDataFrame([("g", float(v), 2.0 * v) for v in range(1000)], "g string, x double, v double")
    q = CL.quantiles(df, ["x", "v"], [0.25, 0.5], "sketch").first()
    assert tuple(q) == (249.0, 499.0, 498.0, 998.0)
    assert ST.quantile_threshold(df, "x", 0.95, "sketch").first()[0] == 949.0
    bins = ST.quantile_bin_stats(df, "x", "v", 4, "sketch").orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in bins] == [
        (0.0, 249.0, 250), (249.0, 499.0, 250), (499.0, 749.0, 250), (749.0, 999.0, 250)]
    box = ST.box_stats(df, "g", "x", method="sketch").first()
    assert (box["q1"], box["median"], box["q3"], box["n_outliers"]) == (249.0, 499.0, 749.0, 0)
    with pytest.raises(ValueError):
        ST.box_stats(df, "g", "x", method="other")
