"""Queries on tables of their own: columns that stop varying, joins that stay narrow."""

import datetime as dt

import duckdb

import __spark_entry__ as E
from tests.test_oracle import _digest

QUERIES, SQLS = E.queries(), E.oracle_sql()

def _twin(folder, table, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return _digest(c.execute(SQLS[name]).df())

def test_least_value_of_many_events_is_the_same_in_every_bucket(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2), i * 7 % 50, kinds[i % 5],
             0.0 if i % 5 == 0 else float(i * i % 97) + i % 11) for i in range(1200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double") \
        .write.parquet(f"{tmp_path}/events.parquet")
    name = "features_enhanced_6h"
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) > 20 and (got["tmin"] == 0.0).all()
    assert _digest(got) == _twin(tmp_path, "events", name)

def test_rows_are_placed_without_gathering_a_flag_in_one_task(spark, tmp_path):
    rows = [(["R", "A", "N", None][i % 4], "FO"[i % 2], float(i * i % 1013)) for i in range(4000)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_extendedprice double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    name, threshold = "sketch_ranks_prices", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as for a table that is large
    try:
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = _digest(df.toPandas())
    finally:
        spark.conf.set(threshold, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert got == _twin(tmp_path, "lineitem", name)
