import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowcast.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, members string, u string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "m", "u") for r in rows], SCHEMA)


def run(spark, rows, **kw):
    df = frame(spark, rows)
    return mixing.mix(df, F.array("source"), mixing.word_count(F.col("text")), **kw)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    sources = ["a"] * 6 + ["b", "c", "é", None]
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 3, 10, 40, 200]))), rng.choice(sources))
            for i in range(n)]


def test_targets_share_all_and_respect_the_cap():
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0}
    goal = mixing.targets(sizes, {"a": 5, "b": 2, "c": 1, "d": 5}, 3)
    assert goal == {"a": 30.0, "b": 970.0, "c": 15.0, "d": 0.0}
    assert mixing.targets({"a": 0}, {"a": 1}, 3) == {"a": 0.0}
    goal = mixing.targets({"a": 100, "b": 100}, {"a": 5, "b": 2}, 3)
    assert goal["a"] == pytest.approx(200 * 5 / 7) and sum(goal.values()) == pytest.approx(200)


def test_source_order_puts_null_last():
    assert mixing.source_order({"b", None, "a", "é", "\U0001F600", "￿"}) == ["a", "b", "é", "￿", "\U0001F600", None]


def test_route_is_a_cheapest_largest_flow():
    rng = random.Random(2)
    for _ in range(60):
        names = ["x", "y", "z"]
        pats = {p: rng.randint(0, 3) for r in (1, 2) for p in itertools.combinations(names, r) if rng.random() < 0.7}
        quotas = {s: rng.randint(0, 6) for s in names}
        flow = mixing.route(pats, quotas, 3)
        assert all(0 <= flow[p] <= 3 * pats[p] for p in pats)
        # largest flow by max-flow min-cut over source subsets: unmet sources see only full patterns
        best = min(sum(quotas[s] for s in names if s not in cut) + sum(3 * n for p, n in pats.items() if set(p) & set(cut))
                   for r in range(4) for cut in itertools.combinations(names, r))
        assert sum(flow.values()) == best
        # no cheaper: the flow at each number of uses is the largest possible there
        for level in (1, 2):
            at = min(sum(quotas[s] for s in names if s not in cut) + sum(level * n for p, n in pats.items() if set(p) & set(cut))
                     for r in range(4) for cut in itertools.combinations(names, r))
            assert sum(min(flow[p], level * pats[p]) for p in pats) == at


def test_mix_meets_targets(spark):
    rows = corpus()
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = r["members"][0]
        d = by.setdefault(s, [0, r["source_size"][0], r["target"][0], 0])
        d[0] += r["taken"]
        d[3] = max(d[3], r["size"])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
    for taken, size, target, most in by.values():
        assert abs(taken - target) <= most / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows).collect()))


def test_sql_twin_on_a_fixture(spark):
    import duckdb
    rows = corpus(3, 120) + [(900, None, "a"), (901, "", None), (902, None, "empty")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = sorted(con.execute(mixing.SQL).fetchall())
    got = sorted((r["id"], r["size"], r["source_size"][0], r["target"][0], r["taken"]) for r in run(spark, rows).collect())
    assert [(*w[:3], round(w[3], 6), w[4]) for w in want] == [(*g[:3], round(g[3], 6), g[4]) for g in got]


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 3 else ["a"], 10) for i in range(90)], "doc_id long, s array<string>, n long")
    got = mixing.mix(df, F.col("s"), F.col("n"), weights=(1.0, 1.0)).collect()
    total = sum(r["taken"] for r in got)
    assert abs(total - 900) <= 10


def test_mixed_documents_repeat_rows(spark):
    rows = corpus(5, 200) + [(0, "a b c", "b"), (0, "a b c", "b")]
    df = frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in mixing.mix(df, F.array("source"), mixing.word_count(F.col("text"))).collect())


def test_empty_and_no_words(spark):
    assert run(spark, []).collect() == []
    assert [r["taken"] for r in run(spark, [(1, None, "a"), (2, "", None), (None, None, None)]).collect()] == [0, 0, 0]


def overlapping(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, s array<string>, n long")


def test_the_bound_counts_patterns_that_share_sources_only(spark):
    rows = [(1, ["a"], 5), (2, ["b"], 7), (3, ["c"], 9), (4, ["d"], 4)]
    assert mixing.mix(overlapping(spark, rows), F.col("s"), F.col("n"), max_patterns=1).count() == 4
    shared = overlapping(spark, [*rows, (5, ["a", "b"], 3)])
    assert mixing.mix(shared, F.col("s"), F.col("n"), max_patterns=3).count() == 5
    with pytest.raises(ValueError, match="share sources"):
        mixing.mix(shared, F.col("s"), F.col("n"), max_patterns=2)


def test_goals_of_very_many_sources(spark):
    """More sources than the flow takes; targets as the plain rule on the driver gives them."""
    n = 50_000
    size = (F.pmod(F.xxhash64("id"), F.lit(97)) * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(13))).cast("long")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array(F.concat(F.lit("host"), F.col("id"))).alias("s"), size.alias("n"))
    got = mixing.mix(docs, F.col("s"), F.col("n")).select(
        F.get("members", F.lit(0)).alias("s"), "size", F.get("target", F.lit(0)).alias("target"), "taken").collect()
    assert len(got) == n > mixing.MAX_PATTERNS
    sizes = {r["s"]: r["size"] for r in got}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(mixing.source_order(sizes))}
    goal = mixing.targets(sizes, weight, mixing.MAX_REPEATS)
    assert max(abs(r["target"] - goal[r["s"]]) for r in got) < 1e-6
    # a source is one document here, taken whole times: the nearest to its target
    assert all(abs(r["taken"] - goal[r["s"]]) <= r["size"] / 2 + 0.5 for r in got)


def test_shared_and_other_sources_together(spark):
    rows = [(i, [["a", "b"], ["a"], ["x"], ["y"], [], None][i % 6], 10) for i in range(600)]
    got = mixing.mix(overlapping(spark, rows), F.col("s"), F.col("n"), weights=(1.0,)).collect()
    assert len(got) == 600 and all(r["taken"] == 0 for r in got if not r["members"])
    by = {}
    for r in got:
        if r["members"]:
            by[tuple(r["members"])] = by.get(tuple(r["members"]), 0) + r["taken"]
    # 4,000 words of members, four equal targets within three times each source's size
    assert abs(by[("x",)] - 1000) <= 10 and abs(by[("y",)] - 1000) <= 10
    assert abs(by[("a", "b")] + by[("a",)] - 2000) <= 20


def test_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 120_000, "a", 1, 2, 3), (2, "w " * 60_000, "b", 1, 2, 3)],
                               "doc_id long, text string, source string, plan_members int, edge_members int, border int")
    got = {r["id"]: r for r in mixing.mix(df, F.array("source"), mixing.word_count(F.col("text"))).collect()}
    assert {i: r["size"] for i, r in got.items()} == {1: 120_000, 2: 60_000}
    assert mixing.mixed_documents(df).columns == df.columns


def test_rows_of_one_id_at_the_border(spark, monkeypatch):
    """A third of all rows share an id and a size, another third have no id: they are taken one by one."""
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    rows = corpus(5, 100) + [(7, "w w w", "b")] * 100 + [(None, "w " * n, "b") for n in range(1, 11) for _ in range(10)]
    out = run(spark, rows).collect()
    assert sorted((str(r["id"]), r["size"]) for r in out) == sorted((str(i), len(t.split())) for i, t, _ in rows)
    for name in {r["members"][0] for r in out}:
        mine = [r for r in out if r["members"][0] == name]
        most = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"][0]) <= most / 2 + 1
    assert all(r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"] for r in out)
    views = duckdb_rows(rows)
    assert sorted((str(r["id"]), r["size"], r["taken"]) for r in out) == views


def duckdb_rows(rows):
    """Rows of the query's SQL, told apart only by what it returns."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    got = duckdb.connect().execute(mixing.SQL).fetchall()
    return sorted((str(i), size, taken) for i, size, _, _, taken in got)
