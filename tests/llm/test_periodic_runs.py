import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from flowcast.llm import periodic_runs as R

# names that clash with the operator's own, and one that needs quoting
SCHEMA = "doc_id long, text string, runs_id string, runs_text string, `a b` int"


def brute(words, least=6, exponent=4):
    """Every stretch with period q for every q, shortest period first."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                out.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def corpus(seed, n=40):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        words = [rng.choice("abcdé"[:rng.randint(1, 5)]).encode() for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.5 and len(words) > 4:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(3, 10)
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        docs.append(words)
    return docs


@pytest.mark.parametrize("seed", range(12))
def test_runs_match_brute_force(seed):
    docs = corpus(seed)
    assert R.runs_of(docs) == [brute(w) for w in docs]


@pytest.mark.parametrize("least,exponent", [(2, 2), (4, 3), (10, 5)])
def test_other_bounds(least, exponent):
    docs = corpus(99)
    assert R.runs_of(docs, least, exponent) == [brute(w, least, exponent) for w in docs]


def test_squares_of_multiples_merge():
    words = [b"x", *[b"a", b"b"] * 12, b"y"]
    assert R.runs_of([words]) == [[(1, 24, 2)]]
    assert R.runs_of([[b"a"] * 5, [b"a"] * 6, [], [b"a"]]) == [[], [(0, 6, 1)], [], []]


def test_common_prefixes_and_order():
    rng = np.random.default_rng(3)
    sizes = [30, 1, 45]
    sym = np.concatenate([rng.integers(0, 3, s) + 10 * k for k, s in enumerate(sizes)])
    ends = np.cumsum(sizes)
    end = np.repeat(ends, sizes)
    sa, apart, levels = R.suffix_array(sym, end)
    tails = [tuple(sym[i:end[i]]) for i in range(len(sym))]
    assert [tails[i] for i in sa] == sorted(tails)
    lcp = R.common_prefixes(sa, apart, levels, end)
    for k in range(1, len(sa)):
        a, b = tails[sa[k - 1]], tails[sa[k]]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(["u"] + ["v", "w", "w"] * 40_000 + ["u"])  # a text of over 100,000 words
    rows = [(1, "a b " * 5, "x", "y", 3), (1, "a b " * 5, "x", "y", 3), (None, None, None, None, None), (2, "", "", "", 0),
            (3, " \t\n\x0b\x0c\r ", "z", "z", 1), (4, "q" * 200_000, "z", "z", 1), (5, long, "z", "z", 1)]
    out = R.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["a b"] for r in out] == [r[4] for r in rows]
    assert [r["runs_text"] for r in out] == [r[3] for r in rows]
    found = [[tuple(x) for x in r["runs"]] for r in out]
    assert found == [[(0, 10, 2)], [(0, 10, 2)], [], [], [], [], [(1, 120_000, 3)]]
    assert [r["kept"] for r in out] == ["a b", "a b", "", "", "", "q" * 200_000, "u v w w u"]
    assert [r["n_words"] for r in out] == [10, 10, 0, 0, 0, 1, 120_002]


def test_empty_table(spark):
    assert R.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_planted_texts():
    words = [str(i).encode() for i in range(100)]
    hit = [i for i in range(400) if R.planted(i, words) != words]
    from zlib import crc32
    assert set(hit) <= {i for i in range(400) if crc32(str(i).encode()) % 10 == 0} and len(hit) > 20
    for i in hit:
        g = crc32(str(i).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert R.planted(i, words) == [words[j if j < a else a + (j - a) % p] for j in range(100)]
    assert R.planted(None, words) == words and R.planted(hit[0], []) == []


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [rng.choice(["to", "be", "or", "not", "é"]) for _ in range(rng.randint(0, 90))]
        rows.append((i, None if i == 7 else rng.choice([" ", "\n", "  "]).join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in R.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = R.planted(i, (text or "").encode().split())
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
