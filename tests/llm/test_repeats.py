import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowcast.llm import repeats

SCHEMA = "doc_id long, text string, h1 string, place int"  # the last two clash with inner names


def brute(docs, length):
    seen = Counter(t[i:i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not p for p, g in zip(b"\x00" + bytes(gone), gone))
        out.append((doc_id, sum(gone), runs, kept))
    return sorted(out, key=str)


def found(spark, docs, length):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = {(r["id"], r["k"]): r for r in repeats.repeated_spans(df, length=length, with_kept=True).collect()}
    keyed = df.selectExpr("doc_id", "text", "xxhash64(text) k").collect()
    out = []
    for r in keyed:
        hit, body = got.get((r["doc_id"], r["k"])), (r["text"] or "").encode()
        if hit is None:
            out.append((r["doc_id"], 0, 0, body))
            continue
        kept = bytes(hit["kept"])
        assert hashlib.sha256(kept).hexdigest() == hit["kept_sha256"]
        rest = body
        for s in reversed(hit["spans"]):
            rest = rest[:s["start"]] + rest[s["end"]:]
        assert rest == kept
        out.append((r["doc_id"], hit["n_removed"], len(hit["spans"]), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(10, 60)) for _ in range(4)]
    docs = []
    for _ in range(30):
        parts = [text(rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, 3), p[a:] if rng.random() < 0.5 else p)
        docs.append("".join(parts))
    docs += [docs[0], docs[1], docs[2][:150] + "X" + docs[2][151:], "a" * 500, "b" * 130 + "a" * 260, "ab" * 200,
             "abc" * 90 + "x" + "abc" * 80, "", "short", shared[0] * 3, shared[1][:99], shared[1][:100], shared[1][:101]]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("length,seed", [(100, 1), (130, 2), (80, 3), (400, 4)])
def test_matches_brute_force(spark, length, seed):
    docs = corpus(seed)
    assert found(spark, docs, length) == brute([(i, t.encode()) for i, t in docs], length)


def test_nulls_repeated_rows_and_ids(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    docs = [(None, long), (1, None), (1, long + "tail"), (2, "z" * 50), (2, "z" * 50), (None, None)]
    assert found(spark, docs, 100) == brute([(i, (t or "").encode()) for i, t in docs], 100)
    twice = [(7, long), (7, long)]
    assert [r[1] for r in found(spark, twice, 100)] == [300, 300]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.repeated_spans(df).collect() == []


def test_strings_never_cross_documents(spark):
    a = "".join(random.Random(6).choice("abcdefgh ") for _ in range(200))
    docs = [(1, a[:90]), (2, a[90:]), (3, a)]
    assert all(r[1] == 0 for r in found(spark, docs, 120)[:1])
    assert found(spark, docs, 100) == brute([(i, t.encode()) for i, t in docs], 100)


def test_texts_beyond_the_places_raise(monkeypatch):
    data = np.frombuffer(b"ab" * 40, np.uint8)
    bounds = np.array([0, len(data)])
    assert len(repeats.triggers(data, bounds, 10)[0])
    monkeypatch.setattr(repeats, "PLACE", np.uint64(63))
    with pytest.raises(ValueError, match="80 bytes"):
        repeats.triggers(data, bounds, 10)


def test_query_counts_input_bytes_and_removes_by_bytes(spark, tmp_path):
    """Passages of over 50 words: one of 400 bytes or more goes from both documents, a shorter one
    stays; n_bytes is the size of the input either way."""
    rng = random.Random(7)
    words = lambda n, size: " ".join("".join(rng.choices("abcdefgé", k=size)) for _ in range(n))
    long, short = words(60, 8), words(60, 4)
    assert len(short.encode()) < 400 <= len(long.encode())
    docs = [(1, words(20, 5) + "\n" + long), (2, long + "\t" + words(30, 5)), (3, short + "\n" + words(30, 5)),
            (4, words(20, 5) + "\t" + short), (5, words(90, 8)), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    body = [(i, (t or "").encode()) for i, t in docs]
    want = [(i, len(dict(body)[i]), n, runs, hashlib.sha256(kept).hexdigest()) for i, n, runs, kept in brute(body, 400)]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert [n > 0 for _, _, n, _, _ in want] == [True, True, False, False, False, False]
