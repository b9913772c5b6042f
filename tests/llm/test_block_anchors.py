import hashlib
import random

import duckdb
import numpy as np
import pytest

from flowcast.llm import block_anchors as B

SCHEMA = "doc_id long, text string, k string, regions int"  # the last two clash with inner names


def brute(rows, window):
    held = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[s:s + window])
                held[key] = min(held.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and held[tuple(words[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, text, len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


def check(spark, rows, window):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {(r["id"], r["k"]): r for r in B.repeated_spans(df, window=window, with_kept=True).collect()}
    keys = df.selectExpr("doc_id", "text", "xxhash64(text) k").collect()
    texts = {(r["doc_id"], r["text"]): r["k"] for r in keys}
    for i, text, n, kept in brute(rows, window):
        hit = got.get((i, texts[(i, text)]))
        if n == 0:
            assert hit is None
            continue
        assert (hit["n_removed"], hit["kept"].encode()) == (n, kept)
        assert hit["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        words = text.encode().split()
        for s in reversed(hit["spans"]):
            del words[s["start"]:s["end"]]
        assert b" ".join(words) == kept
    return got


def corpus(seed, vocabulary=40):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    shared = [words(rng.randint(6, 50)) for _ in range(5)]
    rows = []
    for i in range(50):
        parts = words(rng.randint(0, 25))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += (p if rng.random() < 0.6 else p[a:b]) + words(rng.randint(0, 9))
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200, rows[0][1]), (201, rows[4][1]), (202, " ".join(words(300) * 2)), (203, " ".join(["a"] * 90)),
             (204, " ".join(["a"] * 60)), (205, " ".join(["a", "b"] * 40))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,seed", [(8, 1), (9, 2), (20, 3), (50, 4)])
def test_matches_brute_force(spark, window, seed):
    assert check(spark, corpus(seed), window)


def test_few_words(spark):
    """Two words only: nearly every stretch occurs often, at every distance."""
    check(spark, corpus(5, vocabulary=2), 8)


def test_nulls_repeated_rows_and_ids(spark):
    rng = random.Random(6)
    a = " ".join(f"x{rng.randrange(1000)}" for _ in range(60))
    rows = [(None, a), (5, None), (5, a), (5, a), (7, a + " tail"), (7, "head " + a), (9, ""), (None, None), (9, "short one")]
    got = check(spark, rows, 10)
    assert sorted(i for i, _ in got) == [7, 7]  # rows of one id leave each other alone


def test_long_text(spark):
    rng = random.Random(7)
    words = [f"v{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words[1_000:110_000])), (2, " ".join(words)), (3, "y" * 200_000)]
    got = check(spark, rows, 50)
    assert [(r["n_removed"], [tuple(s) for s in r["spans"]]) for r in got.values()] == [(109_000, [(1_000, 110_000)])]


def test_empty_table(spark):
    assert B.repeated_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_least_of_neighbours():
    v = np.random.default_rng(1).integers(0, 9, 60).astype(np.uint64)
    for width in (1, 2, 5, 7, 16, 60):
        assert B._least(v, width).tolist() == [i + int(v[i:i + width].argmin()) for i in range(60 - width + 1)]


def test_query_matches_twin_with_nulls(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(8)] + [(400, None), (401, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(B.SQL).fetchall()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in B.query(spark, str(tmp_path)).collect()}
    assert got == want and sum(r[1] for r in got.values()) > 0
