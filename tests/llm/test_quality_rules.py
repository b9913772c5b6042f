import random
import re

import duckdb
from conftest import SF_MID
from pyspark.sql import functions as F

from flowcast.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, stats string, kept string, pattern string, vote_pattern string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:n] for n, x in enumerate(lines))
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def texts(seed=1):
    rng = random.Random(seed)
    bits = ["a", "bé", "C", "#", "*|", "\n", "\n", "\x0b", "\x1c", " ", "😀", "a b c d e f g h ", "x y\n"]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(200)] \
        + [None, "", " ", "\n\n", "same line\nsame line\n same line", "w " * 100, "a b c d e f g h a b c d e f g h"]


def test_counts_match_brute_force():
    for t in texts():
        assert rules.text_stats((t or "").encode())[:5] == slow(t)


def test_verdicts(spark):
    rows = [(i, t, "s", "k", "p", "v") for i, t in enumerate(texts(2))] + [(3, texts(2)[3], "s", "k", "p", "v"), (None, None, "s", "k", "p", "v")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = rules.judge(df, failed_col="f", p_col="pg", kept_col="kp")
    assert set(out.columns) == {*df.columns, "f", "pg", "kp"}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, _, _, repeat = slow(r["text"])
        assert r["f"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["f"] and r["kp"])
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kp"] for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rules.judge(df, failed_col="f", p_col="pg", kept_col="kp").collect() == []
    assert rules.fit({}) == {}


def test_fit_finds_an_inaccurate_rule():
    # the second and third rules agree; the fourth accuses at random and is not believed
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        bad = rng.random() < 0.2
        p = "-" + ("b" if bad and rng.random() < 0.9 else "-") + ("b" if bad and rng.random() < 0.9 else "-") \
            + ("b" if rng.random() < 0.3 else "-") + "-----" + ("b" if bad and rng.random() < 0.8 else "g") + "g"
        counts[p] = counts.get(p, 0) + 1
    good = rules.fit(counts)
    assert good["---b-----gg"] > 0.9
    assert good["-bb------bg"] < 0.01 and good["---------gg"] > 0.99


def test_labels_agree(spark):
    got = rules.query(spark, SF_MID).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    bad_kept, good_lost, bad, good = con.execute(f"""
        select count(*) filter (quality = 0 and kept), count(*) filter (quality = 1 and not kept and not base_failed),
               count(*) filter (quality = 0), count(*) filter (quality = 1 and not base_failed)
        from got join read_parquet('{SF_MID}/labels.parquet') l on l.doc_id = got.doc_id""").fetchone()
    assert bad and good and bad_kept <= 0.05 * bad and good_lost <= 0.01 * good
