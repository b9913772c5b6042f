"""Correlations by blocked products, binned densities, folded recursions, p-values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowcast.operators import evaluate as EV
from flowcast.operators import stats as ST
from flowcast.operators import timeseries as TS


def test_correlations_of_hundreds_of_columns_match_pandas(spark):
    rng = np.random.default_rng(1)
    p, n = 229, 400
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, p)) + rng.normal(size=(n, p)) + 1000
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 7.1, np.nan  # a constant column and one without a value
    cols = [f"c {i}" for i in range(p)]
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    out = ST.corr_matrix(df, cols).toPandas().pivot(index="col_a", columns="col_b", values="corr").loc[cols, cols]
    want = pd.DataFrame(x, columns=cols).corr()
    assert out.shape == (p, p)
    assert (out.isna() == want.isna()).all().all()
    assert np.nanmax(np.abs(out.to_numpy(float) - want.to_numpy())) < 1e-9


def test_correlation_of_odd_frames(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, 5.0, 1.0)], "a double, b double, c double")
    assert all(r["corr"] is None for r in ST.corr_matrix(df, ["b", "c"]).collect())
    got = {(r[0], r[1]): r[2] for r in ST.corr_matrix(df, ["a", "c"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "c"): None, ("c", "a"): None, ("c", "c"): None}
    assert len(ST.corr_matrix(df.limit(0), ["a", "b"]).collect()) == 4
    assert ST.corr_matrix(df, []).collect() == []


@pytest.mark.parametrize("kind", ["normal", "skewed", "lumps"])
def test_binned_density_errs_less_than_its_bound(spark, kind):
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(50, 4, 3000), "skewed": rng.exponential(3, 3000) ** 2, "lumps": rng.integers(0, 4, 3000) * 1.0}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    a = ST.kde(df, "x").orderBy("k").toPandas()
    b = ST.kde(df, "x", method="exact").orderBy("k").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    assert (a["x"] == b["x"]).all()
    assert (a["density"] - b["density"]).abs().max() < 4e-10 / h
    with pytest.raises(ValueError):
        ST.kde(df, "x", method="other")


def test_density_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for method in ("binned", "exact"):
        assert all(r["density"] is None for r in ST.kde(df, "x", 5, method=method).collect())


def test_partial_autocorrelation_solves_yule_walker(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for _ in range(500):
        x.append(0.6 * x[-1] + rng.normal())
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v) for i, v in enumerate(x)] + [(dt.datetime(2030, 1, 1), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    r = {k["lag"]: k["acf"] for k in TS.acf(df, "x", 12).collect()}
    got = {k["lag"]: (k["pacf"], k["band"]) for k in TS.pacf(df, "x", 12).collect()}
    assert got[0][0] == 1.0 and len(got) == 13
    for k in range(1, 13):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        last = np.linalg.solve(system, [r[i] for i in range(1, k + 1)])[-1]
        assert got[k][0] == pytest.approx(last, abs=1e-10)
        assert got[k][1] == pytest.approx(1.96 / math.sqrt(501))
    assert [tuple(q)[:2] for q in TS.pacf(df, "x", 0).collect()] == [(0, 1.0)]


# two-sided quantiles of Student's t from tables, and closed forms for 1 and 2 degrees of freedom
TABLED = [(12.706204736432095, 1, 0.05), (63.65674116287399, 1, 0.01), (4.302652729911275, 2, 0.05),
          (2.2281388519649385, 10, 0.05), (3.169272667175838, 10, 0.01), (2.0422724563012373, 30, 0.05),
          (1.0, 1, 0.5), (0.0, 7, 1.0), (1.0, 2, 1 - 1 / math.sqrt(3)), (-3.0, 2, 1 - 3 / math.sqrt(11))]


def test_p_values_match_tables(spark):
    df = spark.createDataFrame([(t, n, p) for t, n, p in TABLED], "t double, dof long, p double")
    for r in df.withColumn("got", EV.t_test_p(F.col("t"), F.col("dof"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-9), tuple(r)


def test_p_values_of_many_degrees_of_freedom_and_odd_input(spark):
    df = spark.createDataFrame([(1.959963984540054, 10 ** 9), (None, 5), (2.0, 0), (40.0, 500), (1e-9, 3)], "t double, dof long")
    got = [r[0] for r in df.select(EV.t_test_p(F.col("t"), F.col("dof"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-8)  # the normal limit
    assert got[1] is None and got[2] is None
    assert 0 <= got[3] < 1e-150 and got[4] == pytest.approx(1.0, abs=1e-8)
