"""Quality rules by weak supervision.

Each rule reads counts of one text and votes good, bad or abstains. The votes of all
documents are counted by vote pattern (at most 3 to the number of rules), and
expectation-maximisation over those counts estimates, for each rule, how often it votes
bad on good and on bad documents, and the share of bad documents. A document's posterior
probability of being good follows from its pattern and replaces a filter that asks
every rule to pass.

Defined cases: null and empty texts have zero counts (all rules that need words abstain,
the length rule votes bad); repeated rows vote once each; an empty table gives an empty
table and no model is needed; other columns pass through untouched whatever their names.
The whole text is always read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import fresh, materialise, read

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
WORD_BYTES = LETTERS + bytes(range(0x80, 0x100))  # letters of other scripts too
WINDOW = 8

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_letters", "n_bang", "n_again", "n_stops", "n_plain")
STATS_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    windows = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())]
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[size:size + n] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in FIELDS, of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text) - len(text.translate(None, LETTERS))
    return (
        len(words),
        len(text.translate(None, CONTINUATION + SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        letters,
        text.count(b"!"),
        sum(a == b for a, b in zip(words, words[1:])),
        sum(w[-1:] in b".?!" for w in words),
        sum(not w.rstrip(b".,;:?").translate(None, WORD_BYTES) for w in words),
    )


def _stats_of(texts: pa.Array) -> pa.Array:
    rows = [text_stats(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    columns = np.array(rows, np.int64).reshape(len(rows), len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(FIELDS))], names=list(FIELDS))


def stats(text: Column) -> Column:
    return F.arrow_udf(_stats_of, STATS_TYPE)(text)


# Rules: name, numerator, denominator, and the ratio beyond which the rule votes bad
# ("above" or "below"). Most only accuse: when they see nothing bad they abstain, as that
# says little about the other kinds of junk. The last two also vote good, from the ratio
# in the last field on (up or down, away from bad). All abstain when the denominator is 0.
RULES = (
    ("symbols", "n_symbols", "n_words", "above", 0.10, None),
    ("repeated_windows", "n_repeat_words", "n_words", "above", 0.30, None),
    ("repeated_words", "n_again", "n_words", "above", 0.30, None),
    ("upper_case", "n_upper", "n_letters", "above", 0.40, None),
    ("exclamations", "n_bang", "n_words", "above", 0.25, None),
    ("repeated_lines", "n_dup_lines", "n_lines", "above", 0.30, None),
    ("long_words", "word_chars", "n_words", "above", 15.0, None),
    ("short_words", "word_chars", "n_words", "below", 2.0, None),
    ("plain_words", "n_plain", "n_words", "below", 0.60, 0.90),
    ("sentence_ends", "n_stops", "n_words", "below", 0.004, 0.02),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def votes(s: Column) -> Column:
    """One character a rule: g good, b bad, - abstains. The first is the length rule."""
    parts = [F.when(s["n_words"] < MIN_WORDS, "b").otherwise("-")]
    for _, num, den, side, bad, good in RULES:
        ratio = s[num] / F.nullif(s[den], F.lit(0))
        accuse = ratio > bad if side == "above" else ratio < bad
        vote = F.when(accuse, "b")
        if good is not None:
            vote = vote.when(ratio <= good if side == "above" else ratio >= good, "g")
        parts.append(vote.otherwise("-"))
    return F.concat(*parts)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def fit(counts: dict[str, int], rounds: int = 300, strength: float = 50.0) -> dict[str, float]:
    """Posterior probability of good for each vote pattern.

    Two classes; the three outcomes of a rule (good, bad, abstain) are independent given
    the class. The model holds how often good and bad documents get each outcome, that
    is, the rule's accuracy and coverage. Dirichlet priors of weight ``strength`` hold
    rules that seldom vote and tell the two classes apart. The first responsibilities
    come from the bad votes. ``counts`` has at most 3**(rules + 1) entries."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    outcome = np.array([[["b", "g", "-"].index(c) for c in p] for p in patterns])
    given = (outcome[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, outcome
    two_sided = np.array([False, *[r[-1] is not None for r in RULES]])[:outcome.shape[1], None]
    prior = (np.where(two_sided, [0.3, 0.4, 0.3], [0.3, 0.0, 0.7]),  # in bad documents
             np.where(two_sided, [0.01, 0.9, 0.09], [0.01, 0.0, 0.99]))  # in good ones
    accused = (outcome == 0).sum(1)
    q = np.where(accused > 0, 1 - 0.3 ** accused, 0.02)  # probability of being bad
    for _ in range(rounds):
        share = ((n * q).sum() + 0.1 * strength) / (n.sum() + strength)
        odds = np.full(len(n), np.log(share / (1 - share)))
        logs = []
        for weight, p in zip((n * q, n * (1 - q)), prior):
            rate = (np.einsum("p,pro->ro", weight, given) + strength * p) / (weight.sum() + strength)
            logs.append(np.log(np.maximum(rate, 1e-9)))
        odds = odds + np.einsum("pro,ro->p", given, logs[0] - logs[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - q).max() < 1e-10
        q = new
        if done:
            break
    return {p: round(float(1 - x), 9) for p, x in zip(patterns, q)}


def vote_pattern(s: Column) -> Column:
    """The votes, then F if the base verdict is a failure and P if not."""
    return F.concat(votes(s), F.when(base_failed(s), "F").otherwise("P"))


def verdicts(spark: SparkSession, pattern_counts: DataFrame, threshold: float) -> DataFrame:
    """(pattern, p_good, base_failed, kept) for a frame of (pattern, n): its rows are
    bounded by the number of vote patterns, not by the documents."""
    seen = pattern_counts.collect()
    counts: dict[str, int] = {}
    for r in seen:
        counts[r["pattern"][:-1]] = counts.get(r["pattern"][:-1], 0) + r["n"]
    good = fit(counts)
    rows = [(r["pattern"], good[r["pattern"][:-1]], r["pattern"][-1] == "F",
             r["pattern"][-1] == "P" and good[r["pattern"][:-1]] >= threshold) for r in seen]
    return spark.createDataFrame(sorted(rows), "pattern string, p_good double, base_failed boolean, kept boolean")


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5,
          failed_col: str = "base_failed", p_col: str = "p_good", kept_col: str = "kept") -> DataFrame:
    """``docs`` with the base verdict, the posterior and the final verdict. Every text is
    counted once: the documents are written with their vote pattern, and the model and the
    verdicts read that table. Only vote patterns are collected and broadcast."""
    pattern, = fresh(docs, "vote_pattern")
    voted = materialise(docs.withColumn(pattern, vote_pattern(stats(F.col(text_col)))), "rule-votes")
    counts = voted.groupBy(F.col(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    table = verdicts(docs.sparkSession, counts, threshold).withColumnsRenamed(
        {"pattern": pattern, "p_good": p_col, "base_failed": failed_col, "kept": kept_col})
    return voted.join(F.broadcast(table), pattern).drop(pattern)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their columns as they came."""
    extra = fresh(docs, "rule_failed", "rule_p", "rule_kept")
    return judge(docs, text_col, threshold, *extra).where(F.col(extra[2])).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    # counts are kept once, narrow, instead of reading every text twice
    counted = materialise(docs.select("doc_id", stats(F.col("text")).alias("s")), "rule-stats")
    voted = counted.withColumn("pattern", vote_pattern(F.col("s")))
    table = verdicts(spark, voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), 0.5)
    return voted.join(F.broadcast(table), "pattern").select(
        "doc_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS[:5]], "base_failed", "kept", "p_good")
