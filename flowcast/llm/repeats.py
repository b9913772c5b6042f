"""Removal of long repeated byte strings by parsing at rolling-hash triggers.

Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any
document, is removed; strings never cross documents and are judged on the input.

Parse. A trigger is a place whose rolling hash (of ``GRAM`` bytes) is the least, leftmost
on ties, among the places of some string of ``length`` bytes. Which place of a string is
its trigger depends on the string alone, so equal strings have their triggers at equal
offsets, and no string is without one, however poor its alphabet. A trigger stands for
the consecutive strings that have it, and the text round it (the union of all strings
that could) is its phrase.

Dictionary. Triggers whose gram occurs once in the corpus are dropped: their strings are
unique. A phrase that occurs twice makes all its strings repeated (settled). Only triggers
between the two, near the ends of repeats, need a closer look: their strings are cut into
ranges of ``RANGE`` neighbouring offsets; the bytes common to a range (its core) occur
once if none of its strings is repeated, and the bytes of all of them (its hull) occur
twice only if all are. Where neither settles it, each string of the range is counted on
its own. A string near the end of one repeat may equal one inside another, so at both
steps one representative of each distinct settled phrase (or hull) that shares a gram
(or core) with an open one is looked at as well; copies beyond it are not.

All counts are partial sums by a 128-bit polynomial hash (64 bits where a collision only
causes a closer look), so a passage held by a third of all documents meets in no task;
texts move by document only. The README says how this departs from building suffix
arrays.

Defined cases: a null text is the empty text; texts shorter than ``length`` bytes keep
everything; rows with equal id and text are two documents, whose strings repeat each
other; null ids are ids; an empty table gives an empty table; other columns never take
part. A text of 1 GiB or more raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import materialise, read

LENGTH = 400
GRAM = 64
RANGE = 32
CHUNK_BYTES = 1 << 19  # texts hashed together; a longer text is a chunk of its own
PLACE_BITS = np.uint64(30)
PLACE = np.uint64((1 << 30) - 1)

_RNG = np.random.default_rng(400)
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + _RNG.integers(0, 2, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[which] = (out[0], out[1])
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + size * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` neighbours."""
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:len(v)] = v
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def triggers(data: np.ndarray, bounds: np.ndarray, length: int):
    """For texts laid end to end in ``data`` at ``bounds``: places of the triggers, first
    and last start of their strings, and the grams' hashes."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64), None
    if len(data) > int(PLACE):
        raise ValueError(f"a text of {len(data)} bytes; places are told apart up to {int(PLACE)}")
    gram = min(GRAM, length)
    hashes = Hashes(data, 0)
    grams = hashes.grams(gram)
    ranked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(ranked, length - gram + 1)
    inside = np.zeros(len(data) + 2, np.int32)
    long = np.diff(bounds) >= length
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:len(least)] > 0)
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64), hashes
    place = (least[starts] & PLACE).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    place = place[first]
    return place, starts[first], starts[last], grams[place], hashes


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) for groups of neighbouring texts; nulls are empty."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    body = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(raw):
        end = max(int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1, begin + 1)
        cut = offsets[begin:end + 1]
        yield np.arange(begin, end), body[cut[0]:cut[-1]], cut - cut[0]
        begin = end


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _distinct_places(*keys: np.ndarray) -> np.ndarray:
    """True for the first of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order] = new  # lexsort is stable
    return out


def _take(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column("id").take(pa.array(rows)), batch.column("k").take(pa.array(rows))]


def _of_lists(column: pa.ListArray, rows: np.ndarray, bounds: np.ndarray, *fields: str):
    """Fields of the structs in the lists of ``rows`` (neighbours), with the text each
    belongs to and that text's bounds in the chunk."""
    part = column.slice(int(rows[0]), len(rows))
    flat = part.flatten()
    text = np.repeat(np.arange(len(rows)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    values = [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    return text, bounds[text], bounds[text + 1], *values


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value from first to last of each row."""
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def parse(docs: DataFrame, length: int) -> DataFrame:
    """One row a trigger: gram, phrase hash (h1, h2), id, k, place in the text, the least
    and greatest offset of its strings, and whether the phrase's place is new in its text
    (phrases cut by both ends of a short text share one)."""
    reach = length - min(GRAM, length)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in _chunks(batch.column("text")):
                place, first, last, gram, one = triggers(data, bounds, length)
                if not len(place):
                    continue
                text = np.searchsorted(bounds, place, side="right") - 1
                begin = np.maximum(bounds[text], place - reach)
                end = np.minimum(bounds[text + 1], place + length)
                new = np.ones(len(place), bool)
                new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram), _signed(one.of(begin, end)), _signed(Hashes(data, 1).of(begin, end)),
                     *_take(batch, rows[text]), pa.array((place - bounds[text]).astype(np.int32)),
                     pa.array((place - last).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(new)],
                    names=["gram", "h1", "h2", "id", "k", "place", "low", "high", "new"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(of, f"gram bigint, h1 bigint, h2 bigint, id {kind}, k bigint, place int, low int, high int, new boolean")


def look_closer(phrased: DataFrame, length: int) -> DataFrame:
    """One row for each range of the triggers in ``open``: hashes of its core (c1, c2) and,
    where the text holds it whole, of its hull (u1, u2), and whether the place of each is
    new in its text."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in _chunks(batch.column("text")):
                text, begin, end, place, low, high = _of_lists(batch.column("open"), rows, bounds, "place", "low", "high")
                if not len(place):
                    continue
                i, r = _spread(low // RANGE, high // RANGE)
                at = place[i] + begin[i]
                near, far = at - r * RANGE, at - (r * RANGE + RANGE - 1)  # first byte at the range's ends
                whole = (far >= begin[i]) & (near + length <= end[i])
                one, two = Hashes(data, 0), Hashes(data, 1)
                hull = [np.zeros(len(i), np.uint64) for _ in range(2)]
                for h, by in zip(hull, (one, two)):
                    h[whole] = by.of(far[whole], near[whole] + length)
                yield pa.RecordBatch.from_arrays(
                    [_signed(one.of(near, far + length)), _signed(two.of(near, far + length)),
                     pa.array(_distinct_places(near).astype(np.int32)),
                     *[pa.array(h.view(np.int64), mask=~whole) for h in hull],
                     pa.array((_distinct_places(far, whole) & whole).astype(np.int32)),
                     *_take(batch, rows[text[i]]), pa.array(place[i].astype(np.int32)), pa.array(r.astype(np.int32)),
                     pa.array(low[i].astype(np.int32)), pa.array(high[i].astype(np.int32))],
                    names=["c1", "c2", "c_new", "u1", "u2", "u_new", "id", "k", "place", "r", "low", "high"])

    kind = dict(phrased.dtypes)["id"]
    return phrased.where("open is not null").select("id", "k", "text", "open").mapInArrow(
        of, f"c1 bigint, c2 bigint, c_new int, u1 bigint, u2 bigint, u_new int, id {kind}, k bigint, "
            "place int, r int, low int, high int")


def single_strings(ranged: DataFrame, length: int) -> DataFrame:
    """One row for each string of the ranges in ``ranges``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in _chunks(batch.column("text")):
                text, begin, _, place, r, low, high = _of_lists(
                    batch.column("ranges"), rows, bounds, "place", "r", "low", "high")
                if not len(place):
                    continue
                i, offset = _spread(np.maximum(low, r * RANGE), np.minimum(high, r * RANGE + RANGE - 1))
                start = begin[i] + place[i] - offset
                yield pa.RecordBatch.from_arrays(
                    [_signed(Hashes(data, 0).of(start, start + length)), _signed(Hashes(data, 1).of(start, start + length)),
                     *_take(batch, rows[text[i]]), pa.array((start - begin[i]).astype(np.int32))],
                    names=["h1", "h2", "id", "k", "start"])

    kind = dict(ranged.dtypes)["id"]
    return ranged.select("id", "k", "text", "ranges").mapInArrow(
        of, f"h1 bigint, h2 bigint, id {kind}, k bigint, start int")


def _by_text(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows gathered by text, under names that no join confuses."""
    return rows.groupBy(F.col("id").alias("r_id"), F.col("k").alias("r_k")).agg(
        F.collect_list(F.struct(*columns)).alias(name))


def _with(texts: DataFrame, gathered: DataFrame, how: str = "inner") -> DataFrame:
    return texts.join(gathered, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("k") == F.col("r_k")), how).drop("r_id", "r_k")


def _often(rows: DataFrame, keys: list[str], weight) -> DataFrame:
    """Keys, under the names o_<key>, whose weights add up to two or more. They are
    written: a join with them then shuffles both sides by itself, and AQE can split the
    rows of a key that very many texts share."""
    return materialise(rows.groupBy(*[F.col(c).alias(f"o_{c}") for c in keys]).agg(F.sum(weight).alias("o_n"))
                       .where("o_n > 1"), "repeat-often")


def _match(rows: DataFrame, often: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    on = None
    for c in keys:
        same = F.col(c) == F.col(f"o_{c}")
        on = same if on is None else on & same
    joined = rows.join(often, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"o_{c}" for c in keys])


def _renamed(keys: DataFrame) -> DataFrame:
    return materialise(keys.distinct().toDF(*[f"o_{c}" for c in keys.columns]), "repeat-open")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_kept: bool = False) -> DataFrame:
    """(id, k, spans, n_removed, kept_sha256[, kept]) for every distinct id and text that
    loses bytes. ``k`` is xxhash64 of the text; spans are the maximal removed runs as
    structs of byte positions start and end; ``kept`` is the rest, as binary."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text")) \
        .where(F.octet_length("text") >= length)
    parsed = materialise(parse(texts, length), "repeat-triggers")
    shared = _match(parsed, _often(parsed, ["gram"], F.lit(1)), ["gram"]).drop("o_n")
    shared = materialise(shared, "repeat-shared")
    twice = _often(shared, ["h1", "h2"], F.col("new").cast("int"))
    known = materialise(_match(shared, twice, ["h1", "h2"], "left").withColumn("all", F.col("o_n").isNotNull().cast("int"))
                        .drop("o_n"), "repeat-known")
    unsettled = known.where("all = 0")
    # one representative a distinct settled phrase and trigger place in it, where the gram
    # is open elsewhere
    first_byte = F.greatest(F.lit(0), F.col("place") - (length - min(GRAM, length)))
    speaker = (known.where("all = 1").groupBy("h1", "h2", (F.col("place") - first_byte).alias("inside"), "gram")
               .agg(F.min(F.struct("id", "k", "place", "low", "high")).alias("m")))
    speaker = _match(speaker, _renamed(unsettled.select("gram")), ["gram"], "left_semi").select("m.*")
    to_open = _by_text(unsettled.select("id", "k", "place", "low", "high").unionByName(speaker), "open", "place", "low", "high")
    marked = _with(texts, _by_text(known, "triggers", "place", "all"))
    phrased = materialise(_with(marked, to_open, "left"), "repeat-phrases")
    ranges = materialise(look_closer(phrased, length), "repeat-ranges")
    cored = materialise(_match(ranges, _often(ranges, ["c1", "c2"], F.col("c_new")), ["c1", "c2"]).drop("o_n"), "repeat-cores")
    hulls = _often(cored.where("u1 is not null"), ["u1", "u2"], F.col("u_new"))
    hulled = materialise(_match(cored, hulls, ["u1", "u2"], "left").withColumn("hull", F.col("o_n").isNotNull()).drop("o_n"),
                         "repeat-hulls")
    mixed = hulled.where("not hull")
    speaker = hulled.where("hull").groupBy("u1", "u2", "r", "c1", "c2").agg(
        F.min(F.struct("id", "k", "place", "low", "high")).alias("m"))
    speaker = _match(speaker, _renamed(mixed.select("c1", "c2")), ["c1", "c2"], "left_semi").select("r", "m.*")
    fields = ["place", "r", "low", "high"]
    to_count = _by_text(mixed.select("id", "k", *fields).unionByName(speaker.select("id", "k", *fields)), "ranges", *fields)
    strings = materialise(single_strings(_with(phrased.select("id", "k", "text"), to_count), length), "repeat-strings")
    starts = _by_text(_match(strings, _often(strings, ["h1", "h2"], F.lit(1)), ["h1", "h2"]), "starts", "start")
    whole = _by_text(hulled.where("hull"), "hulls", "place", "r")
    reach = length - min(GRAM, length)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in _chunks(batch.column("text")):
                text, begin, end, place, settled = _of_lists(batch.column("triggers"), rows, bounds, "place", "all")
                at = (begin + place)[settled > 0]
                low, high = [np.maximum(begin[settled > 0], at - reach)], [np.minimum(end[settled > 0], at + length)]
                _, begin, _, place, r = _of_lists(batch.column("hulls"), rows, bounds, "place", "r")
                low.append(begin + place - (r * RANGE + RANGE - 1))
                high.append(begin + place - r * RANGE + length)
                _, begin, _, start = _of_lists(batch.column("starts"), rows, bounds, "start")
                low.append(begin + start)
                high.append(begin + start + length)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.concatenate(low), 1)
                np.add.at(edge, np.concatenate(high), -1)
                gone = np.cumsum(edge)[:-1] > 0
                out = []
                for row, a, b in zip(rows, bounds[:-1], bounds[1:]):
                    mine = gone[a:b]
                    if not mine.any():
                        continue
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False]))))
                    kept = data[a:b][~mine].tobytes()
                    out.append((row, [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)],
                                int(mine.sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                if out:
                    index, spans, n, digest, kept = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [*_take(batch, np.array(index)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         pa.array(n, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())],
                        names=["id", "k", "spans", "n_removed", "kept_sha256", "kept"])

    kind = dict(texts.dtypes)["id"]
    full = _with(_with(phrased.drop("open"), whole, "left"), starts, "left").select(
        "id", "k", "text", "triggers", "hulls", "starts")
    found = full.mapInArrow(cover, f"id {kind}, k bigint, spans array<struct<start:int,end:int>>, n_removed bigint, "
                                   "kept_sha256 string, kept binary")
    found = found.dropDuplicates(["id", "k"])  # rows with equal id and text
    return found if with_kept else found.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    found = repeated_spans(docs).select(F.col("id").alias("r_id"), F.col("k").alias("r_k"), "spans", "n_removed", "kept_sha256")
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("k"),
                        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("all_sha256"))
    return _with(whole, found, "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
