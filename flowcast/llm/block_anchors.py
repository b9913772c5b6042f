"""Removal of passages held by an earlier document, by fixed-block anchors.

A window is ``window`` consecutive words of one document. Words covered by a window whose
words also start somewhere in a document with a smaller id are removed; windows are judged
on the input.

Index. Every document is cut into blocks of half a window's words at fixed places; any
window, wherever it lies in a document of the index, holds a whole block. Probe. Every
rolling stretch of a block's length is looked up among the blocks; a hit in a document
with a smaller id is an anchor. Extend. An anchor's context is all words that a window
round it could take. Where the whole context is the same round a block of a smaller id,
the anchor is extended by its full reach in one step, and repeats longer than that grow
together from their anchors. Elsewhere, near the ends of repeats, the windows round the
anchor are compared one by one with those round the blocks it hit, of which one
representative a distinct context is looked at. What is covered are the maximal repeats.

Only places that can be part of a repeat are indexed and probed: each window names the
least of its stretches by hash, equal windows name the same one, and windows whose named
stretch lies in one document only are left out before any word is probed. This loses
nothing and keeps the probes to about the repeated part of the corpus.

Stretches and contexts are compared by 64-bit hashes each, both at once where a context
decides, single windows by 128 bits. Counts are minima with map-side combining, and tables
are written before they meet in joins, so that a passage that a third of the documents
hold is split by AQE. Texts move by document only.

Defined cases: a null text has no word; texts shorter than a window keep everything; rows
of one id never remove each other's words, repeated rows get the same result each; a null
id is neither smaller nor larger than another, so such rows lose nothing and remove
nothing; an empty table gives an empty table; other columns never take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import WORD_SQL, materialise, read

WINDOW = 50
REMEMBERED = 400_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound, after which it starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Stretches:
    """Hashes of stretches of a sequence of word hashes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, which: int = 0):
        n = len(words)
        self.up, self.down = self._of(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(words + np.uint64(which)) * self.up[:n], out=self.sums[1:])

    @classmethod
    def _of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a base and of its inverse modulo 2**64."""
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            have = []
            for b in (BASES[which], pow(BASES[which], -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                have.append(np.cumprod(p, dtype=np.uint64))
            cls._powers[which] = have = (have[0], have[1])
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least, leftmost on ties, of each run of ``width`` neighbours."""
    best = np.arange(len(values))
    span = 1  # best[i] is the place of the least of values[i:i + span]
    while span < width:
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best


def named_stretches(one: Stretches, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each stretch that a window names, and the first and last window that do."""
    block = window // 2
    at = np.arange(n - block + 1)
    h = one.of(at, at + block)
    place = _least(h, window - block + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[first]], first, np.r_[first[1:] - 1, len(place) - 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _per_text(batches: Iterator[pa.RecordBatch], schema: list[tuple[str, pa.DataType]], of) -> Iterator[pa.RecordBatch]:
    """Rows that ``of(words, row of the batch)`` gives for each text, as columns of equal
    length, behind the text's id and k."""
    known = WordHashes()
    for batch in batches:
        parts, counts, rows = [], [], []
        texts = batch.column("text").cast(pa.large_binary())
        lists = {c: batch.column(c) for c in batch.schema.names if c not in ("id", "k", "text")}
        for i in range(len(batch)):
            words = (texts[i].as_py() or b"").split()
            out = of(known, words, {c: v[i] for c, v in lists.items()})
            if out is not None and len(out[0]):
                parts.append(out)
                counts.append(len(out[0]))
                rows.append(i)
        if parts:
            row = pa.array(np.repeat(rows, counts))
            columns = [pa.array(np.concatenate([p[j] for p in parts]), kind) for j, (_, kind) in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("k").take(row), *columns],
                                             names=["id", "k", *[c for c, _ in schema]])


def _field(listed: pa.Scalar, name: str, kind=np.int64) -> np.ndarray:
    """A field of the structs of a list; empty for a null list."""
    if not listed.is_valid:
        return np.empty(0, kind)
    return listed.values.field(name).to_numpy(zero_copy_only=False).astype(kind)


def _ranges(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places from 0 to n-1 inside any of the ranges, both ends included."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:n] > 0)


def _windows_named(texts: DataFrame, window: int) -> DataFrame:
    """(id, k, h, first, last) for each stretch named by windows first..last."""
    def of(known, words, _):
        if len(words) < window:
            return None
        h, first, last = named_stretches(Stretches(known.of(words)), len(words), window)
        return h.view(np.int64), first, last

    schema = [("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
    return texts.mapInArrow(lambda b: _per_text(b, schema, of),
                            f"id {dict(texts.dtypes)['id']}, k bigint, h bigint, first int, last int")


def anchors(regions: DataFrame, window: int) -> DataFrame:
    """(id, k, b, c, at, probe): the blocks to index and the stretches to probe in the
    regions of each text: hash of the stretch, of its context, and its place."""
    block = window // 2

    def of(known, words, row):
        n = len(words)
        first, last = _field(row["regions"], "first"), _field(row["regions"], "last")
        lower, higher = (_field(row["regions"], f, bool) for f in ("lower", "higher"))
        probe = _ranges(n, first[lower], last[lower] + window - block)  # a smaller id may hold them
        index = _ranges(n, first[higher], last[higher] + window - block)  # a larger id may
        index = index[index % block == 0]
        at = np.concatenate((probe, index))
        one = Stretches(known.of(words))
        begin, end = np.maximum(at - (window - block), 0), np.minimum(at + window, n)
        context = _mix(one.of(begin, end) ^ ((at - begin).astype(np.uint64) * np.uint64(BASES[1])))
        return one.of(at, at + block).view(np.int64), context.view(np.int64), at, np.arange(len(at)) < len(probe)

    schema = [("b", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("probe", pa.bool_())]
    return regions.mapInArrow(lambda b: _per_text(b, schema, of),
                              f"id {dict(regions.dtypes)['id']}, k bigint, b bigint, c bigint, at int, probe boolean")


def single_windows(opened: DataFrame, window: int) -> DataFrame:
    """(id, k, w1, w2, start) for every window round the places in ``places``, once each."""
    block = window // 2

    def of(known, words, row):
        n, at = len(words), _field(row["places"], "at")
        start = _ranges(n, np.maximum(at - (window - block), 0), np.minimum(at, n - window))
        x = known.of(words)
        return [Stretches(x, i).of(start, start + window).view(np.int64) for i in (0, 1)] + [start]

    schema = [("w1", pa.int64()), ("w2", pa.int64()), ("start", pa.int32())]
    return opened.mapInArrow(lambda b: _per_text(b, schema, of),
                             f"id {dict(opened.dtypes)['id']}, k bigint, w1 bigint, w2 bigint, start int")


def _gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Distinct rows of each text; a set, so that copies of a row do not add up."""
    return rows.groupBy(F.col("id").alias("g_id"), F.col("k").alias("g_k")).agg(
        F.collect_set(F.struct(*columns)).alias(name))


def _with(texts: DataFrame, gathered: DataFrame, how: str = "inner") -> DataFrame:
    return texts.join(gathered, (F.col("id") == F.col("g_id")) & (F.col("k") == F.col("g_k")), how).drop("g_id", "g_k")


def _keyed(rows: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """Written under other key names: a join then shuffles both sides by itself, and AQE can
    split the rows of a key that very many texts share."""
    return materialise(rows.withColumnsRenamed(keys), name)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_kept: bool = False) -> DataFrame:
    """(id, k, spans, n_removed, kept_sha256[, kept]) for each id and text that loses words:
    spans are the maximal removed runs as structs of word numbers start and end, ``k`` is
    xxhash64 of the text, ``kept`` the remaining words joined by spaces."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text")) \
        .where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * window - 1))
    named = materialise(_windows_named(texts, window), "anchor-named")
    span = _keyed(named.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"),
                  {"h": "s_h"}, "anchor-span")
    shared = named.join(span, F.col("h") == F.col("s_h")).select(
        "id", "k", "first", "last", (F.col("low") < F.col("id")).alias("lower"), (F.col("high") > F.col("id")).alias("higher"))
    regions = materialise(_with(texts, _gathered(shared, "regions", "first", "last", "lower", "higher")), "anchor-regions")

    both = materialise(anchors(regions, window), "anchor-blocks")
    # of each distinct context of a block, the row with the smallest id speaks for all
    contexts = _keyed(both.where("not probe").groupBy("b", "c").agg(F.min(F.struct("id", "k", "at")).alias("who")),
                      {"b": "x_b", "c": "x_c"}, "anchor-contexts")
    heads = _keyed(contexts.groupBy("x_b").agg(F.min("who.id").alias("low")), {"x_b": "y_b"}, "anchor-heads")
    hits = materialise(both.where("probe").join(heads, (F.col("b") == F.col("y_b")) & (F.col("low") < F.col("id")))
                       .select("id", "k", "b", "c", "at"), "anchor-hits")
    hits = materialise(hits.join(contexts, (F.col("b") == F.col("x_b")) & (F.col("c") == F.col("x_c")), "left")
                       .select("id", "k", "b", "at", F.coalesce(F.col("who.id") < F.col("id"), F.lit(False)).alias("full")),
                       "anchor-extended")
    partial = hits.where("not full")
    open_blocks = _keyed(partial.select("b").distinct(), {"b": "z_b"}, "anchor-open")
    speakers = contexts.join(open_blocks, F.col("x_b") == F.col("z_b"), "left_semi").select("who.*")
    places = _gathered(partial.select("id", "k", "at").unionByName(speakers), "places", "at")
    windows = materialise(single_windows(_with(regions.select("id", "k", "text"), places), window), "anchor-windows")
    earliest = _keyed(windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                      .where("low < high"), {"w1": "v1", "w2": "v2"}, "anchor-earliest")
    held = windows.join(earliest, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")) & (F.col("low") < F.col("id")))

    full = _gathered(hits.where("full"), "full", "at")
    starts = _gathered(held, "starts", "start")
    marked = _with(_with(regions.select("id", "k", "text"), full, "left"), starts, "left") \
        .where("full is not null or starts is not null")
    block = window // 2

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(len(batch)):
                words = texts[i].as_py().split()
                n, at = len(words), _field(batch.column("full")[i], "at")
                start = _field(batch.column("starts")[i], "start")
                edge = np.zeros(n + 1, np.int64)
                for a, b in ((np.maximum(at - (window - block), 0), np.minimum(at + window, n)), (start, start + window)):
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                gone = np.cumsum(edge)[:n] > 0
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                kept = b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])
                out.append(([{"start": int(a), "end": int(b)} for a, b in turn], int(gone.sum()),
                            hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            spans, n_removed, digest, kept = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("k"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "k", "spans", "n_removed", "kept_sha256", "kept"])

    found = marked.mapInArrow(cover, f"id {dict(texts.dtypes)['id']}, k bigint, spans array<struct<start:int,end:int>>, "
                                     "n_removed bigint, kept_sha256 string, kept string")
    found = found.dropDuplicates(["id", "k"])  # rows with equal id and text
    return found if with_kept else found.drop("kept")


def whole_words(text: Column) -> Column:
    """Number of words and SHA-256 of the words joined by spaces."""
    def of(texts: pa.Array) -> pa.Array:
        n, digest = [], []
        for t in texts.cast(pa.large_binary()):
            words = (t.as_py() or b"").split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=["n", "sha"])
    return F.arrow_udf(of, "struct<n:bigint,sha:string>")(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = repeated_spans(docs).select(F.col("id").alias("g_id"), F.col("k").alias("g_k"), "n_removed", "kept_sha256")
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("k"), whole_words(F.col("text")).alias("w"))
    return _with(whole, found, "left").select(
        F.col("id").alias("doc_id"), F.col("w.n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "w.sha").alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_SQL}'), CAST([] AS VARCHAR[])) AS words FROM documents
), w AS (
  SELECT doc_id, s, md5(array_to_string(words[s + 1:s + {WINDOW}], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS s FROM d) q
), m AS (
  SELECT content, min(doc_id) AS low FROM w GROUP BY content
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i
  FROM w JOIN m USING (content) WHERE low < doc_id
), g AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
), p AS (
  SELECT d.doc_id, words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words ELSE
           list_select(words, list_sort(list_transform(list_filter(range(len(words)),
             lambda i: NOT list_contains(places, i)), lambda i: i + 1))) END AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM p
"""
