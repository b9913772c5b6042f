import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers  # noqa: F401

from flowcast.llm import token_counts as tc


def reference(vocabulary, byte_fallback):
    """The tokenizers library's unigram model over the same pieces and scores."""
    pieces = [("<unk>", vocabulary.least)] + list(vocabulary.pieces)
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", vocabulary.least) for b in range(256)]
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


def texts(seed, n=300):
    rng = random.Random(seed)
    bits = ["the", "tion", " ", " ", "  ", "é", "ß", "😀", "\n", "\t", "▁", "Token", "a", "aaa", "x", "12", "...", "中文", "́", "'s", "Über"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "▁", " a", "a ", "a" * 3000]


@pytest.mark.parametrize("fallback", [True, False])
def test_public_vocabulary(fallback):
    v = tc.load_vocabulary()
    assert v.byte_fallback
    v = tc.Vocabulary(v.pieces, v.least, fallback)
    ref, parts = reference(v, fallback), tc.PartCounter(v)
    for t in texts(1):
        assert tc.count_tokens(t, parts) == len(ref.encode(t).ids), repr(t)


def test_ties_follow_the_tokenizer():
    rng = random.Random(2)
    for trial in range(60):
        letters = "ab▁" if trial % 2 else "abc▁"
        pieces = {c for c in letters if rng.random() < 0.8}
        pieces |= {"".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(8)}
        pieces = sorted(p for p in pieces if "▁" not in p[1:]) or ["a"]
        v = tc.Vocabulary(tuple((p, float(rng.choice([-1, -2, -3, -4]))) for p in pieces), -4.0, False)
        ref, parts = reference(v, False), tc.PartCounter(v)
        for _ in range(40):
            t = "".join(rng.choice("aabbc z") for _ in range(rng.randint(0, 14)))
            assert tc.count_tokens(t, parts) == len(ref.encode(t).ids), (v, t)


def test_real_documents(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    ref = reference(tc.load_vocabulary(), True)
    want = {i: len(ref.encode(t).ids) for i, t in zip(docs.doc_id, docs.text)}
    assert {r["doc_id"]: r["n_tokens"] for r in tc.query(spark, SF_SMALL).collect()} == want


def test_forgetting_changes_nothing(monkeypatch):
    v = tc.load_vocabulary()
    some = texts(3, 50)
    whole = [tc.count_tokens(t, tc.PartCounter(v)) for t in some]
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    parts = tc.PartCounter(v)
    assert [tc.count_tokens(t, parts) for t in some] == whole


def test_long_parts_keep_few_states():
    v = tc.load_vocabulary()
    ref, parts = reference(v, True), tc.PartCounter(v, held=0)
    long = [t.replace(" ", "") * 8 for t in texts(4, 40)] + ["ab€" * 60_000]
    for t in long:
        assert tc.count_tokens(t, parts) == len(ref.encode(t).ids)
    assert tc.count_tokens(long[-1], tc.PartCounter(v)) == parts.count(tc.MARK + long[-1])


def test_nulls_empty_table_and_clashing_names(spark):
    v = tc.load_vocabulary()
    schema = "doc_id long, text string, n_tokens string, parts string"
    rows = [(1, None, "a", "b"), (None, "the end", "a", "b"), (1, "", "a", "b"), (2, "the end", None, None), (2, "the end", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = df.select("doc_id", tc.token_count(F.col("text"), v).alias("n")).collect()
    n = len(reference(v, True).encode("the end").ids)
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", 0), ("1", 0), ("2", n), ("2", n), ("None", n)]
    assert df.limit(0).select(tc.token_count(F.col("text"), v)).collect() == []
