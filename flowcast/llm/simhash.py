"""SimHash near-dedup by tiled exact comparison.

Texts are lower-cased (A-Z) and cut into word shingles; each bit of a fingerprint is the
majority of that bit over the XXH64 hashes of the shingles. Distinct fingerprints are
dealt into tiles of one population count and at most about ``tile_rows`` members. Two
fingerprints that differ in at most ``radius`` bits differ in population count by at most
``radius``, so only pairs of tiles that near are compared, by numpy exclusive-or and bit
counts. Within a pair of tiles the same bound holds for the ones in three parts of the
bits, taken together, and cells of members beyond it are skipped too; nothing else is.
A pair of tiles returns a spanning forest of its links, which
keeps every connection without listing all pairs of a group. Connected components over
the forests give the groups.

Defined cases: null and empty texts have fingerprint 0 and link like any other; repeated
rows and equal texts share a fingerprint and are compared once; a null id never names a
group unless all its members' ids are null; an empty table gives an empty table; other
columns pass through untouched whatever their names. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowcast.llm.common import fresh, materialise, read
from flowcast.llm.components import connected_components, roots

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
TILE_ROWS = 65_536
BLOCK = 1 << 15  # shingle hashes counted at a time
LINKS_HELD = 1 << 20
PAIRS_HELD = 1 << 17  # pairs compared at a time
PARTS = (0xFFFF, 0xFFFF << 16, 0xFFFFFFFF << 32)  # bits counted apart within a tile
TILE_PAIRS = 1  # tile pairs a task; each is up to 4 billion comparisons


def text_fingerprint(text: bytes, words_per: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    last = max(len(words) - words_per + 1, 1)
    starts = [0] + [e + 1 for e in ends[:last - 1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[-last:])), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, BLOCK):
        part = hashes[i:i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words_per: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long of the same 64 bits."""
    def of(texts: pa.Array) -> pa.Array:
        bits = [text_fingerprint(t or b"", words_per) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(bits, np.uint64).view(np.int64))
    return F.arrow_udf(of, "bigint")(text)


def _cells(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a tile's members by their counts of ones in PARTS, the counts of each cell
    and the cells' bounds in that order."""
    counts = np.stack([np.bitwise_count(tile & np.uint64(p)) for p in PARTS], axis=1).astype(np.int64)
    order = np.lexsort(counts.T[::-1])
    ranked = counts[order]
    first = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]).any(1)][:len(ranked)])
    return order, ranked[first], np.r_[first, len(ranked)]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest (member, root) over all fingerprints of two tiles that link; pass one tile
    twice to compare it with itself."""
    both = np.concatenate((a, b))
    forest_u, forest_v = np.empty(0, np.int64), np.empty(0, np.int64)
    held_u, held_v, held = [], [], 0

    def reduced():
        u = np.concatenate([forest_u, *held_u])
        v = np.concatenate([forest_v, *held_v])
        top = roots(u, v, len(both))
        member = np.flatnonzero(top != np.arange(len(both)))
        return member, top[member]

    # links are sought between cells of the tiles: members with equal counts of ones in each
    # part, skipped where the parts differ by more than the radius together
    order_a, cells_a, begin_a = _cells(a)
    order_b, cells_b, begin_b = _cells(b)
    for i, counts in enumerate(cells_a):
        near = np.flatnonzero(np.abs(cells_b - counts).sum(1) <= radius)
        if not len(near):
            continue
        some_b = np.concatenate([order_b[begin_b[j]:begin_b[j + 1]] for j in near])
        step = max(1, PAIRS_HELD // len(some_b))
        for start in range(begin_a[i], begin_a[i + 1], step):
            some_a = order_a[start:min(start + step, begin_a[i + 1])]
            u, v = np.nonzero(np.bitwise_count(a[some_a, None] ^ b[None, some_b]) <= radius)
            u, v = some_a[u], some_b[v]
            differ = a[u] != b[v]
            if differ.any():
                held_u.append(u[differ])
                held_v.append(v[differ] + len(a))
                held += len(held_u[-1])
            if held > LINKS_HELD:
                forest_u, forest_v = reduced()
                held_u, held_v, held = [], [], 0
    member, root = reduced()
    return both[member], both[root]


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): edges that connect all fingerprints of column ``fp`` (each once) within
    ``radius`` bits of one another."""
    spark = distinct.sparkSession
    pc = F.bit_count("fp")
    counts = {r["pc"]: r["n"] for r in distinct.groupBy(pc.alias("pc")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: -(-n // tile_rows) for c, n in counts.items()}  # at most 65 population counts
    if not parts:
        return spark.createDataFrame([], "a bigint, b bigint")
    n_parts = F.create_map(*[F.lit(x) for c in sorted(parts) for x in (c, parts[c])])
    tiles = materialise(
        distinct.select("fp", pc.alias("pc"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.get(F.map_values(n_parts), F.array_position(
            F.map_keys(n_parts), F.col("pc")).cast("int") - 1).cast("long")))
        .groupBy("pc", "part").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    # partners of a tile: the tiles of its own population count from itself on, and all
    # tiles of the next `radius` population counts
    near, n_pairs = [], 0
    for c in sorted(parts):
        for d in range(c, c + radius + 1):
            if d in parts:
                near.append((c, d, parts[d]))
                n_pairs += parts[c] * (parts[c] + 1) // 2 if c == d else parts[c] * parts[d]
    partners = spark.createDataFrame(near, "pc int, pc_b int, parts_b bigint")
    first = tiles.withColumnsRenamed({"part": "part_a", "fps": "fps_a"}).join(F.broadcast(partners), "pc")
    first = first.withColumn("part_b", F.explode(F.sequence(
        F.when(F.col("pc") == F.col("pc_b"), F.col("part_a")).otherwise(F.lit(0).cast("long")),
        F.col("parts_b") - 1)))
    second = tiles.withColumnsRenamed({"pc": "pc_b", "part": "part_b", "fps": "fps_b"})
    pairs = first.join(second.hint("shuffle_hash"), ["pc_b", "part_b"]).select("fps_a", "fps_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = y.values.to_numpy(zero_copy_only=False).view(np.uint64)
                member, root = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(member.view(np.int64)), pa.array(root.view(np.int64))], names=["a", "b"])

    return pairs.repartition(max(len(near) * 2, -(-n_pairs // TILE_PAIRS))).mapInArrow(compare, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           words_per: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, k, fp, component_id, root) for each row of ``docs``: k is xxhash64 of the text,
    fp the fingerprint as a long, component_id the smallest id that links reach, root the
    smallest fingerprint that they reach, which no two groups share."""
    fps = materialise(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"),
                                  fingerprint(F.col(text_col), words_per).alias("fp")), "simhash-fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    edges = materialise(links(reps.select("fp"), radius), "simhash-links")
    linked = connected_components(edges)  # (node, root), linked fingerprints only
    owned = materialise(linked.join(reps.withColumnRenamed("fp", "node"), "node"), "simhash-groups")
    least = owned.groupBy("root").agg(F.min("rep").alias("least"))
    named = owned.join(least, "root").select(F.col("node").alias("fp"), "least", "root")
    # written, so that the last join shuffles both sides by itself and can split a
    # fingerprint that very many rows share
    per_fp = materialise(reps.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"),
                                                               F.coalesce("root", "fp").alias("root")), "simhash-named")
    return fps.join(per_fp, "fp").select("id", "k", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words_per: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group, that with the smallest id (one row of it, if rows share
    the id), with its columns as they came. Groups that share their smallest id, or have
    none, keep one each."""
    found = groups(docs, id_col, text_col, words_per, radius)
    gid, gk, n = fresh(docs, "group_id", "group_text", "group_row")
    chosen = (found.where(F.col("id").eqNullSafe(F.col("component_id")))
              .groupBy("id", "root").agg(F.min("k").alias("k"))
              .select(F.col("id").alias(gid), F.col("k").alias(gk)).distinct())
    kept = docs.join(chosen, F.col(id_col).eqNullSafe(F.col(gid)) & (F.xxhash64(text_col) == F.col(gk)))
    # the window meets rows of one id and text only: a row stored more than once
    one = Window.partitionBy(gid, gk).orderBy(F.lit(0))
    return kept.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                               "component_id")
