import zlib

import numpy as np
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from flowcast.llm import quality_gam as gam

SCHEMA = "doc_id long, text string, f string, held_out string, score string"


def test_held_out_accuracy(spark):
    got = gam.query(spark, SF_MID).toPandas()
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality").toPandas()
    assert len(got) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    good, bad = both.score[both.quality == 1].to_numpy(), both.score[both.quality == 0].to_numpy()
    assert len(bad) and (good[:, None] > bad[None, :]).mean() > 0.97


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_scores_add_table_entries():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((500, 4)), 2)
    y = (x[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float)
    model = gam.fit(x, y)
    for row, s in zip(x[:50], model.score(x[:50])):
        total = model.base + sum(t[sum(c <= row[i] for c in e)] for i, (e, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[sum(c <= row[i] for c in model.pair_edges[i]), sum(c <= row[j] for c in model.pair_edges[j])]
                     for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = [(i, ("good words here. " * (i % 7 + 1)) if i % 3 else "### *** " * 9, "a", "b", "c") for i in range(200)]
    docs += [(None, None, "a", "b", "c"), (300, "", "a", "b", "c"), (5, docs[5][1], "a", "b", "c")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    first = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, f int")
    other = first.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(str, gam.classify(df, first).collect()))
    assert a == sorted(map(str, gam.classify(df, other).collect()))
    assert len(a) == len(docs)


def test_no_labels_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "a", "b", "c"), (2, None, "a", "b", "c")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in gam.classify(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in gam.classify(df, one).collect())
    assert gam.classify(df.limit(0), one).collect() == []


def test_the_training_sample_is_the_smallest_hashes(spark, monkeypatch):
    """Only as many rows as the bound are taken, whatever the number of tasks."""
    from pyspark.sql import functions as F
    measured = spark.range(3000).select("id", F.lit(False).alias("held_out"), F.array(
        *[F.col("id").cast("double")] * len(gam.FEATURES)).alias("f")).repartition(20)
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append((x, y)))
    gam.train(measured, labels, max_rows=200)
    hashes = {r["id"]: r["h"] for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect()}
    want = sorted(hashes, key=lambda i: hashes[i])[:200]
    assert [int(r[0]) for r in seen[0][0]] == want and [int(v) for v in seen[0][1]] == [i % 2 for i in want]


def slow_features(text):
    """The features by plain counting over characters and lists."""
    import math
    import re
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in re.split(f"[{blank}]+", text) if w]
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip(blank)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    letters = sum(c.isascii() and c.isalpha() for c in text)
    runs, longest = 0, 0
    for i, w in enumerate(words):
        runs = runs + 1 if i and words[i - 1] == w else 1
        longest = max(longest, runs)
    chars = sum(map(len, words))
    plain = sum(not re.search(r"[\x00-\x7f]", re.sub("[A-Za-z]", "", w.rstrip(".,;:?"))) for w in words)
    return [math.log1p(len(words)), chars / n, sum(c in "#*$%&|<>" for c in text) / n,
            sum(x in lines[:i] for i, x in enumerate(lines)) / max(len(lines), 1), len(covered) / n,
            sum(c.isascii() and c.isupper() for c in text) / max(letters, 1), text.count("!") / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, sum(w[-1] in ".?!" for w in words) / n, plain / n,
            len(set(words)) / n, len(words) / max(len(lines), 1), text.count("|") / n,
            sum(c in "0123456789" for c in text) / max(chars, 1), text.count(",") / n,
            sum(x.rstrip(blank)[-1] in ".?!" for x in lines) / max(len(lines), 1), math.log1p(longest)]


def test_features_match_plain_counting():
    import random
    rng = random.Random(5)
    pool = ["the", "THE", "café", "a,", "end.", "wow!", "x|y", "12", "#", "no", "no", "日本", "\n", "\t", "\r", "  "]
    texts = ["", " \n ", "one", "same " * 30] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for t in texts:
        assert gam.text_features(t.encode()) == pytest.approx(slow_features(t), abs=1e-12), t
    assert len(gam.text_features(("word " * 150_000).encode())) == len(gam.FEATURES)
