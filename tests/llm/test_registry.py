"""The corpus queries as the driver sees them."""

import corpus_pipeline
from flowcast.llm.queries import ORACLES, QUERIES


def test_operators_are_registered_once_each():
    numbers = [int(name.split("_")[0].removeprefix("op")) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert all(callable(q) for q in QUERIES.values())


def test_twins_are_sql_of_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(sql, str) and "SELECT" in sql for sql in ORACLES.values())


def test_stages_call_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash", "mix_sources", "best_fit"]
