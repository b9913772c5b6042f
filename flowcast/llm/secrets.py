"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds, for
each blob and rule version already scanned, the spans found (an empty list too). A scan
takes the distinct blobs, looks up which rule versions each has not met, runs only
those, and joins findings back to all paths that hold a blob. A later run with the
ledger of an earlier one scans new blobs with all rules and old blobs with new or
changed rules only.

Spans are in code points, end exclusive, leftmost and non-overlapping within a rule.

Defined cases: a null text is the empty text; repeated rows and equal texts share one
scan and each row gets its findings; an empty table or ledger works; the whole text is
scanned, however long; other columns pass through whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import fresh, materialise, read


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules first, in the order in which spans are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
BASE = 3
SPAN = "array<struct<rule:int,start:int,end:int>>"
SPAN_ARROW = pa.list_(pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def compiled(rule: Rule) -> re.Pattern:
    """The rule's pattern. A pattern that is one repeated class can carry its least length
    itself, as its matches are whole runs; that spares a match for every short run."""
    pattern = rule.pattern
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def find(text: str, rules: tuple[Rule, ...], patterns: list[re.Pattern], which: list[int]) -> list[dict]:
    out = []
    for r in which:
        least, group = rules[r].least, rules[r].group
        for m in patterns[r].finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append({"rule": r, "start": m.start(), "end": m.end()})
    return out


def scan(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None,
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule_key, spans) for the pairs of blob and rule version in
    ``versions`` that ``ledger`` (of the same columns) has not seen."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # one text a blob; equal texts meet in the map side already
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("body")) \
        .groupBy("blob").agg(F.first("body").alias("body"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        due = blobs.withColumn("todo", every)
    else:
        met = ledger.groupBy(F.col("blob").alias("met_blob")).agg(F.collect_set("rule_key").alias("met"))
        due = (blobs.join(met, F.col("blob") == F.col("met_blob"), "left")
               .withColumn("todo", F.array_except(every, F.coalesce(F.col("met"), F.array().cast("array<string>"))))
               .where(F.size("todo") > 0))
    number = {r.key: i for i, r in enumerate(rules)}

    def run(bodies: pa.Array, todo: pa.Array) -> pa.Array:
        patterns = [compiled(r) for r in rules]
        found = [find(b, rules, patterns, [number[k] for k in t])
                 for b, t in zip(bodies.to_pylist(), todo.to_pylist())]
        return pa.array(found, SPAN_ARROW)

    spans = due.select("blob", "todo", F.arrow_udf(run, SPAN)("body", "todo").alias("found"))
    return spans.select("blob", "found", F.explode("todo").alias("rule_key")).select(
        "blob", "rule_key",
        F.filter("found", lambda s: F.get(every, s["rule"]) == F.col("rule_key")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, text_col: str = "text",
             rules: tuple[Rule, ...] = RULES, spans_col: str = "spans") -> DataFrame:
    """``versions`` without the text, with its blob (``version_blob``) and the spans of the
    blob in the order of start, then rule: every path and version gets the findings of its
    content. Both new columns get an underscore in front where ``versions`` has the name."""
    known = ledger.where(F.col("rule_key").isin([r.key for r in rules]) & (F.size("spans") > 0))
    order = {r.key: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    keep = [c for c in versions.columns if c != text_col]
    blob, listed, found_blob, found = fresh(versions.drop(text_col), "version_blob", spans_col, "found_blob", "found_spans")
    per_blob = known.select(F.col("blob").alias(found_blob),
                            F.transform("spans", lambda s: F.struct(
                                s["start"].alias("start"), rank[F.col("rule_key")].alias("rule"),
                                s["end"].alias("end"))).alias("part")) \
        .groupBy(found_blob).agg(F.array_sort(F.flatten(F.collect_list("part"))).alias(found))
    # written, so that the join shuffles both sides by itself and AQE can split the rows of a
    # text that very many versions share
    per_blob = materialise(per_blob, "secret-findings")
    addressed = versions.select(*[F.col(f"`{c}`") for c in keep],
                                F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(blob))
    return addressed.join(per_blob, F.col(blob) == F.col(found_blob), "left") \
        .select(*[F.col(f"`{c}`") for c in keep], blob, F.coalesce(F.col(found), F.array().cast(
            "array<struct<start:int,rule:int,end:int>>")).alias(listed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    ledger = materialise(scan(docs), "secret-ledger")
    kinds = F.array(*[F.lit(r.kind) for r in RULES])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["rule"] < BASE)

    def count_of(rule: int):  # a second lambda parameter would be the place in the array
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")

    counts = [count_of(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES[:BASE])]
    return findings(docs, ledger).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
