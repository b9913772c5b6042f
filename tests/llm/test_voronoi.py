import math
import random

from pyspark.sql import functions as F

from flowcast.llm import voronoi

SCHEMA = "vec_id long, embedding array<float>, id string, v string, cell string"


def slow(rows, every, k=5):
    sound = []
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            sound.append((i, [math.floor(256 * x) for x in e]))
    out = set()
    for q in {(i, tuple(v)) for i, v in sound if i is not None and i % every == 0}:
        hits = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in sound if i != q[0])[:k]
        out |= {(q[0], q[1], n + 1, i, -s) for n, (s, i) in enumerate(hits)}
    return sorted((q, r, i, s) for q, _, r, i, s in out)


def run(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, e, "a", "b", "c") for i, e in rows], SCHEMA)
    return sorted(tuple(r) for r in voronoi.top_k(df, F.col("vec_id") % every == 0, **kw).collect())


def f32(x):
    import numpy as np
    return float(np.float32(x))


def vectors(seed, n, d=6, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [f32(c + rng.gauss(0, spread)) for c in rng.choice(centres)]) for i in range(n)]


def test_matches_brute_force(spark):
    for spread in (0.05, 1.0):
        rows = vectors(1, 300, spread=spread)
        assert run(spark, rows, 7, n_pivots=8, block_rows=20) == slow(rows, 7)


def test_ties_copies_and_unusable_vectors(spark):
    rows = vectors(2, 80)
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # one vector many times
    rows += [(200, None), (210, [1.0, None]), (220, [float("nan")] * 6), (230, [float("inf")] + [0.0] * 5), (240, []),
             (250, [0.5, 0.25]), (7, rows[7][1]), (7, rows[8][1]), (0, rows[0][1])]
    assert run(spark, rows, 10, n_pivots=4, block_rows=16) == slow(rows, 10)


def test_rows_of_the_querys_own_id_give_no_bound(spark):
    for r in (2, 3, 9):
        rows = [(0, [10.0])] * r + [(i, [6.0 - i]) for i in range(1, 6)]
        got = run(spark, rows, 10)
        assert got == slow(rows, 10)
        assert len(got) == 5
    rows = vectors(8, 120) + [(0, [f32(1 + j / 8)] * 6) for j in range(6)]  # one id with several vectors
    rows += [(10, dict(rows)[10])] * 7
    assert run(spark, rows, 10, n_pivots=40, block_rows=16) == slow(rows, 10)


def test_copies_of_a_row_spread_over_blocks(spark):
    rows = [(1, 0, [1], n) for n in range(3000)]
    celled = spark.createDataFrame(rows, "id long, cell int, v array<long>, n long")
    counts = spark.createDataFrame([(0, 30)], "cell int, blocks long")
    sizes = [r["count"] for r in voronoi._dealt(celled, counts).groupBy("cell", "block").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200
    rows = vectors(9, 60) + [(0, [1.0] * 6)] * 90
    assert run(spark, rows, 10, n_pivots=3, block_rows=16) == slow(rows, 10)


def test_fewer_candidates_than_k(spark):
    rows = vectors(3, 4)
    assert run(spark, rows, 2) == slow(rows, 2)
    assert run(spark, [(0, [1.0])], 1) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 21 + i * 0.25), float(-(2 ** 20) + i)]) for i in range(40)]
    rows = [(i, [f32(x) for x in v]) for i, v in rows]
    assert run(spark, rows, 4, n_pivots=3) == slow(rows, 4)


def test_empty_table(spark):
    assert run(spark, [], 1) == []


def test_far_cells_are_skipped(spark):
    rows = [(i, [f32(100 * (1 if i % 2 else -1) + (i % 10) / 100), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(spark, rows, 10, n_pivots=2) == slow(rows, 10)


def test_many_query_chunks(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "CHUNK_QUERIES", 4)
    rows = vectors(6, 120)
    assert run(spark, rows, 3, n_pivots=4, block_rows=16) == slow(rows, 3)


def test_rows_of_one_product_do_not_change_the_hits(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(7)
    x, q = (rng.integers(-50, 50, (n, 3)).tolist() for n in (90, 25))
    rows = pa.array([{"id": i, "v": v} for i, v in enumerate(x)])
    asked = pa.array([{"id": 1000 + i, "v": v, "floor": float("-inf")} for i, v in enumerate(q)])
    whole = voronoi._block_hits(rows, asked, 3, 5)
    monkeypatch.setattr(voronoi, "PRODUCT_QUERIES", 4)
    assert voronoi._block_hits(rows, asked, 3, 5).equals(whole)
    assert whole.num_rows == 125
