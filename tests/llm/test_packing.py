import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from flowcast.llm import packing

SCHEMA = "doc_id long, text string, source string, size string, bin string, shard string"


def slow_best_fit(sizes, sources, clusters, capacity, lanes):
    bins, out = [], []
    for s, src, c in zip(sizes, sources, clusters):
        ok = [(b["left"], n) for n, b in enumerate(bins)
              if b["left"] >= s and not (c >= 0 and c in b["c"]) and b["s"][src] < lanes]
        if ok:
            n = min(ok)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "c": set(), "s": Counter()})
        b = bins[n]
        out.append((n, capacity - b["left"]))
        b["left"] -= s
        b["s"][src] += 1
        if c >= 0:
            b["c"].add(c)
    return out


def test_best_fit_matches_a_plain_search():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 80)
        sizes = sorted((rng.randint(1, 30) for _ in range(n)), reverse=True)
        sources = [rng.randint(0, 3) for _ in range(n)]
        clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        lanes = rng.randint(1, 4)
        where, start = packing.best_fit(sizes, sources, clusters, 30, lanes)
        assert list(zip(where, start)) == slow_best_fit(sizes, sources, clusters, 30, lanes)


def check(spark, rows, capacity=50, lanes=3, shard_rows=40):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = packing.pack_documents(df, capacity=capacity, max_per_source=lanes, shard_rows=shard_rows).collect()
    need = Counter()
    for i, t, _ in rows:
        need[i] += len((t or "").split())
    have = Counter()
    bins = defaultdict(list)
    text = {i: t for i, t, _ in rows}
    for r in got:
        have[r["id"]] += r["size"]
        if r["size"]:
            bins[r["bin"]].append(r)
        else:
            assert r["bin"] is None and r["start"] is None
    assert +need == +have and set(need) == {r["id"] for r in got}
    for rs in bins.values():
        rs.sort(key=lambda r: r["start"])
        at = 0
        for r in rs:
            assert r["start"] == at
            at += r["size"]
        assert at <= capacity
        assert max(Counter(r["source"] for r in rs).values()) <= lanes
        same = Counter((text[r["id"]] or "").lower() for r in rs)
        assert max(same.values()) == 1
    return got, bins


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = "hot copy of one text" if rng.random() < 0.3 else " ".join("w%d" % rng.randint(0, 9) for _ in range(rng.choice([0, 2, 5, 20, 49, 50, 51, 130])))
        rows.append((i, t, rng.choice(["hot", "hot", "b", "c", None])))
    return rows


def test_every_word_once_and_no_conflict(spark):
    rows = corpus() + [(1000, None, "b"), (1001, "", None), (1002, "LONG " * 1000, "b")]
    got, bins = check(spark, rows)
    again, _ = check(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeated_rows_conflict_with_each_other(spark):
    rows = [(1, "same text here", "a")] * 30 + [(2, "x", "b"), (None, "no id", None)]
    _, bins = check(spark, rows, shard_rows=10_000)
    assert len([b for b in bins.values() if any(r["id"] == 1 for r in b)]) == 30


def test_bins_are_well_filled(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"x{i}" for _ in range(rng.randint(1, 25))), f"s{i % 20}") for i in range(600)]
    _, bins = check(spark, rows, lanes=9, shard_rows=4096)
    assert len(bins) <= 1.05 * sum(len(r[1].split()) for r in rows) / 50 + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(df).collect() == []
    assert packing.pack(df, F.lit(1), F.col("source"), F.col("text")).count() == 0
