"""Physical-plan guards for every registered query (sf0.001 tables):
no Python UDF evaluation, no cross products, and pruned parquet scans."""

import pytest

import __spark_entry__ as E
from flowcast.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL

# model fits: their plans are ML transforms over the checkpointed dataset
SLOW = {"experiment_predictions", "experiment_metrics", "gbt_iteration_metrics", "permutation_importance",
        "perturbation_importance", "weight_importance", "weather_impact_summary"}
NAMES = sorted(n for n in REGISTRY if n not in SLOW | {"experiment_rows", "experiment_invariants"})


def _plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_spark_native_and_has_no_cross_product(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "EvalPython" not in plan          # no Python UDF in the hot path
    assert "CartesianProduct" not in plan    # no cross joins
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(E.queries()["weather_derived"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans
    for s in scans:
        assert "l_comment" not in s and "l_partkey" not in s and "l_returnflag" not in s
    plan = _plan(E.queries()["lags_users"](spark, SF_SMALL))
    assert all("props" not in s and "event_type" not in s for s in plan.splitlines() if "ReadSchema" in s)


def test_holiday_calendar_is_broadcast(spark):
    plan = _plan(E.queries()["holiday_flag_orders"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
