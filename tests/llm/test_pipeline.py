import random
from collections import Counter

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline as cp
from flowcast.llm import mixing, quality_rules, simhash
from flowcast.llm.common import read
from test_line_dedup import slow as slow_lines
from test_packing import slow_best_fit  # noqa: F401
from test_simhash import slow_components


VOCABULARY = ["the", "and", "of", "to", *(a + b for a in ("riv", "mount", "gard", "wint") for b in ("er", "ain", "en", "ing", "als"))]


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF_SMALL, "documents", *cp.COLUMNS)
    out = [docs]
    for _, f in cp.STAGES:
        out.append(f(spark, out[-1], SF_SMALL).cache())
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=str)


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash", "mix_sources", "best_fit"]
    assert all(s.columns == list(cp.COLUMNS) for s in stages[:-1])


def test_rules_stage(stages):
    judged = quality_rules.judge(stages[0])
    assert rows(stages[1]) == rows(judged.where("kept"))


def test_line_stage(stages):
    want = [(i, t) for i, t, _ in slow_lines([(r["doc_id"], r["text"]) for r in stages[1].collect()])]
    got = sorted(((r["doc_id"], r["text"]) for r in stages[2].collect()), key=str)
    assert got == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_simhash_stage(stages):
    found = slow_components([(r["doc_id"], r["text"]) for r in stages[2].collect()])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({c for _, _, c in found})


def test_mix_stage(stages):
    taken = mixing.mix(stages[3], F.array("source"), mixing.word_count(F.col("text"))).collect()
    want = Counter({r["id"]: r["repeats"] for r in taken if r["repeats"]})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_pack_stage(stages):
    need = Counter()
    for r in stages[4].collect():
        need[r["doc_id"]] += len(r["text"].encode().split())
    have, bins = Counter(), {}
    for r in stages[5].collect():
        have[r["doc_id"]] += r["size"]
        bins.setdefault(r["bin"], []).append(r)
    assert +need == +have
    for rs in bins.values():
        assert sum(r["size"] for r in rs) <= 2048 and max(Counter(r["doc_id"] for r in rs).values()) == 1


def test_run_agrees(spark, stages):
    assert cp.run(spark, SF_SMALL).count() == stages[-1].count()


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, bin string"
    odd = [(None, None, None, None, None, "s", "b"), (1, "", "en", "a", 0, "s", "b"), (2, "x " * 30, "en", None, 60, None, None),
           (2, "x " * 30, "en", None, 60, None, None), (3, "Some plain words make one line. " * 9, "en", "a", 1, "s", "b")]
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(60)) + ".", "en", source, None, "s", None)
            for i, source in ((None, "a"), (4, None), (5, "a"), (5, "b"))]
    for data in ([], odd, odd + good):
        docs = spark.createDataFrame(data, schema)
        for name, f in cp.STAGES:
            before, docs = docs, f(spark, docs, "unused")
            if name != "best_fit":
                assert docs.columns == [x.split()[0] for x in schema.split(", ")]
            if name == "quality_rules":
                kept = docs.select("doc_id", "text").collect()
                base = quality_rules.judge(before).where("not base_failed").select("doc_id", "text").collect()
                assert not Counter(map(tuple, kept)) - Counter(map(tuple, base))
                assert all(len((t or "").split()) >= 20 and not t.startswith(("x ", "Some plain")) for _, t in kept)
        words = Counter()
        for r in before.collect():
            words[r["doc_id"]] += len((r["text"] or "").split())
        packed = Counter()
        for r in docs.collect():
            packed[r["doc_id"]] += r["size"]
        assert +packed == +words
