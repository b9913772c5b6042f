"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
that no neighbouring word extends with that period; runs of at least ``least`` words and
``exponent`` periods are reported.

Tasks take whole documents, many short ones together, as arrays of word numbers that no
two documents share, so suffixes of different documents have no common prefix. Suffixes
are sorted by doubling prefixes, only the groups still tied each round, and the ranks of
the rounds give the common prefixes of neighbours. An LCP interval of depth d stands for
all suffixes that share d words. For the suffixes i of all its children but the largest,
membership of ``ISA[i + d]`` and ``ISA[i - d]`` in the interval, with differing next words,
finds each branching tandem: the last square of a run. Intervals are pairs of bounds in
arrays; no tree is built. A run of ``exponent`` periods puts as many suffixes into its
interval, so smaller intervals are skipped, and further steps back by d must be members as
well. Each square found is rotated to the left as far as its words allow, and squares of
one stretch merge into a run of the smallest period.

Defined cases: null and empty texts have no word and no run; a text of one word has none;
repeated rows get the same result each; ties do not arise, as a stretch has one smallest
period; an empty table gives an empty table; other columns pass through whatever their
names. Whole texts are read; a long text is worked on by itself, in memory of some 100
bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import fresh, read

LEAST = 6
EXPONENT = 4
BATCH_WORDS = 200_000  # documents worked on together; a longer one is alone
MATRIX = 1 << 20  # words compared at a time when squares are rotated

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_array(sym: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order of the suffixes, round in which each parts from the one before it, ranks by
    round) for word numbers ``sym``; ``end`` is the end of the document of each place."""
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    slots = np.arange(n)
    ranked = sym[sa]
    new = np.r_[True, ranked[1:] != ranked[:-1]][:n]
    apart = np.where(new, 0, -1)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0))
    levels, step = [rank], 1
    tied = ~(new & np.r_[new[1:], True][:n])
    open_slots = slots[tied]
    while len(open_slots):
        place = sa[open_slots]
        after = place + step
        inside = after < end[place]
        key = rank[place] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        sa[open_slots] = place
        new = np.r_[True, key[1:] != key[:-1]]
        apart[open_slots[new & (apart[open_slots] < 0)]] = len(levels)
        rank = rank.copy()
        rank[place] = np.maximum.accumulate(np.where(new, open_slots, 0))
        levels.append(rank)
        open_slots = open_slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return sa, apart, levels


def common_prefixes(sa: np.ndarray, apart: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order."""
    lcp = np.where(apart > 0, 1 << np.maximum(apart - 1, 0), 0)
    for t in range(len(levels) - 3, -1, -1):
        slot = np.flatnonzero(apart >= t + 2)
        a, b = sa[slot - 1], sa[slot]
        x, y = a + lcp[slot], b + lcp[slot]
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[t][np.where(inside, x, 0)] == levels[t][np.where(inside, y, 0)])
        lcp[slot[same]] += 1 << t
    return lcp


def _nearest_smaller(lcp: np.ndarray, at: np.ndarray, toward: int) -> np.ndarray:
    """For each place in ``at`` the nearest one to the left (-1) or right (1) with a smaller
    value, by jumping along the pointers found so far; the array ends in values below all."""
    pointer = np.arange(len(lcp)) + toward
    live = at
    while len(live):
        live = live[lcp[pointer[live]] >= lcp[live]]
        pointer[live] = pointer[pointer[live]]
    return pointer[at]


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for ``size`` values from ``first`` on of each row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def branching_tandems(sym: np.ndarray, begin: np.ndarray, end: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the last square of every stretch that holds ``exponent`` periods."""
    none = np.empty(0, np.int64)
    n = len(sym)
    if n < 2:
        return none, none
    sa, apart, levels = suffix_array(sym, end)
    lcp = np.r_[common_prefixes(sa, apart, levels, end), -1]
    lcp[0] = -1
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    cut = np.flatnonzero(lcp > 0)
    left, right = _nearest_smaller(lcp, cut, -1), _nearest_smaller(lcp, cut, 1)
    large = right - left >= exponent
    cut, left, right = cut[large], left[large], right[large]
    if not len(cut):
        return none, none
    # cuts of one interval side by side; its children lie between them
    order = np.argsort(left * (n + 1) + right, kind="stable")
    cut, left, right = cut[order], left[order], right[order]
    head = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    n_cuts = np.diff(np.r_[head, len(cut)])
    child_of = np.repeat(np.arange(len(head)), n_cuts + 1)
    first_child = np.cumsum(n_cuts + 1) - (n_cuts + 1)
    start = np.empty(len(child_of), np.int64)
    inner = np.ones(len(start), bool)
    inner[first_child] = False
    start[first_child], start[inner] = left[head], cut
    stop = np.r_[start[1:], 0]
    stop[np.r_[first_child[1:], len(start)] - 1] = right[head]
    size = stop - start
    most = np.maximum.reduceat(size, first_child)
    largest = np.minimum.reduceat(np.where(size == most[child_of], np.arange(len(size)), len(size)), first_child)
    small = np.ones(len(size), bool)
    small[largest] = False
    row, slot = _spread(start[small], size[small])
    interval = child_of[small][row]
    i, low, high, d = sa[slot], left[head][interval], right[head][interval], lcp[cut[head]][interval]

    def member(x: np.ndarray) -> np.ndarray:
        inside = (x >= begin[i]) & (x < end[i])
        at = isa[np.where(inside, x, 0)]
        return inside & (at >= low) & (at < high)

    def word(x: np.ndarray) -> np.ndarray:
        return np.where(x < end[i], sym[np.minimum(x, n - 1)], -1)

    ahead = member(i + d) & (word(i + 2 * d) != word(i + d))
    behind = member(i - d) & (word(i + d) != sym[i])
    found_p, found_d = [], []
    for keep, place in ((ahead, i), (behind, i - d)):
        for back in range(1, exponent - 1):
            keep = keep & member(place - back * d)
        found_p.append(place[keep])
        found_d.append(d[keep])
    both = np.unique(np.concatenate(found_p) * (n + 1) + np.concatenate(found_d))
    return both // (n + 1), both % (n + 1)


def find_runs(sym: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST,
              exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period."""
    place, period = branching_tandems(sym, begin, end, exponent)
    start, stop = place.copy(), place + 2 * period
    floor = begin[place]
    live, width = np.arange(len(place)), 32
    while len(live):  # rotate the squares to the left, many words at a time
        part = live[:max(1, MATRIX // width)]
        at = start[part, None] - np.arange(1, width + 1)
        inside = at >= floor[part, None]
        at = np.where(inside, at, 0)
        same = inside & (sym[at] == sym[at + np.where(inside, period[part, None], 0)])
        whole = same.all(1)
        start[part] -= np.where(whole, width, same.argmin(1))
        live = np.concatenate((part[whole], live[len(part):]))
        if whole.all():
            width = min(width * 2, 1 << 14)
    long = stop - start >= np.maximum(least, exponent * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    # squares of multiples of the period span the same stretch
    single = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][:len(start)]
    start, stop, period = start[single], stop[single], period[single]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words, from 0 on."""
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def runs_of(documents: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    if not sizes.sum():
        return out
    ends = np.cumsum(sizes)
    # a document's numbers start at its place, so no two documents share one
    sym = np.concatenate([numbered(w) + (e - s) for w, s, e in zip(documents, sizes, ends)])
    begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    start, stop, period = find_runs(sym, begin, end, least, exponent)
    for d, s, e, q in zip(np.searchsorted(ends, start, side="right").tolist(), start.tolist(), stop.tolist(), period.tolist()):
        first = int(ends[d] - sizes[d])
        out[d].append((s - first, e - s, q))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside every run's part after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs_col: str = "runs",
                  kept_col: str = "kept", words_col: str = "n_words", least: int = LEAST, exponent: int = EXPONENT,
                  prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` without the text, with its runs, its words outside the repeated parts joined
    by spaces, and its number of words. ``prepare`` maps (id, words) to the words to use."""
    rest = [c for c in docs.columns if c != text_col]
    gid, gtext = fresh(docs, "runs_id", "runs_text")
    work = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(id_col).alias(gid), F.col(text_col).alias(gtext))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(rest)).to_pylist()
            texts = batch.column(len(rest) + 1).cast(pa.large_binary())
            at = 0
            while at < len(ids):
                documents, held, first = [], 0, at
                while at < len(ids) and (not documents or held < BATCH_WORDS):
                    words = (texts[at].as_py() or b"").split()
                    documents.append(prepare(ids[at], words) if prepare else words)
                    held += len(words)
                    at += 1
                found = runs_of(documents, least, exponent)
                kept = [b" ".join(kept_words(w, r)) for w, r in zip(documents, found)]
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j).slice(first, at - first) for j in range(len(rest))],
                     pa.array(listed, RUN_ARROW), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array([len(w) for w in documents], pa.int64())], names=[*rest, runs_col, kept_col, words_col])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[:len(rest)]]
    return work.mapInArrow(of, ", ".join([*kinds, f"`{runs_col}` {RUN}", f"`{kept_col}` string", f"`{words_col}` bigint"]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: one document in ten repeats a stretch of its words to its end, at a
    place and a period that the CRC-32 of its id gives; rows without an id stay as they are."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic_runs(docs, prepare=planted)
    # greatest length / period, compared as products; then the smallest start and period
    ranked = F.array_sort("runs", lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"), F.lit(0)),
        F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)),
        F.signum(x["period"] - y["period"]).cast("int")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumns({"best": F.get(ranked, F.lit(0)), "lines": lines})
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
