"""Property tests: chunked ordered operators equal the global window for random
chunk and bucket sizes; split sizes add up and stay in time order."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowcast.operators import ordered as O
from flowcast.operators import scale as SC


@settings(max_examples=6, deadline=None)
@given(n=st.integers(5, 120), chunk=st.integers(1, 40), bucket=st.integers(1, 50), back=st.integers(1, 9),
       seed=st.integers(0, 1000))
def test_halo_equals_global_window(spark, n, chunk, bucket, back, seed):
    import random
    rnd = random.Random(seed)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 10_000)), i,
             None if rnd.random() < 0.2 else rnd.uniform(-5, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k long, x double")
    w = Window.orderBy("ts", "k")
    ref = df.select("k", F.lag("x", back).over(w).alias("l_ref"),
                    F.when(F.count("x").over(w.rowsBetween(-back, 0)) == back + 1,
                           F.avg("x").over(w.rowsBetween(-back, 0))).alias("m_ref"))
    idx = O.with_row_index(df, ["ts", "k"])
    out = O.halo_window(idx, lambda win: {"l": F.lag("x", back).over(win), "m": O.full_avg("x", win, back + 1)},
                        back=back, chunk_rows=chunk)
    j = out.join(ref, "k")
    bad = j.where(~F.col("l").eqNullSafe(F.col("l_ref"))
                  | (F.abs(F.coalesce("m", F.lit(1e9)) - F.coalesce("m_ref", F.lit(1e9))) > 1e-9))
    assert j.count() == n and bad.count() == 0


@given(n=st.integers(1, 100_000))
def test_split_sizes_add_up(n):
    a, b, c = SC.split_sizes(n)
    assert a + b + c == n and min(a, b, c) >= 0 and a == int(n * 0.7)
