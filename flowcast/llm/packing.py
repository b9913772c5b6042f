"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A document longer than the capacity fills whole bins of its own; its last piece is packed
like any other. Pieces go largest first to the bin with the least residual that holds
them and does not conflict: bins are kept in residual order, and the successor search
walks on from the tightest fitting bin until one is compatible. A bin carries two
bitmaps. The cluster bitmap forbids two pieces of one duplicate cluster in a bin. The
source bitmap has ``max_per_source`` bits a source, one for each of its pieces in the
bin, so a bin takes at most that many of a source.

Pieces are dealt to shards of about ``shard_rows`` by a hash of document and piece, and
each shard packs on its own, so no task grows with the corpus, and a source or cluster
that holds a third of all rows is spread over all shards. Pieces that share a bin are
always in the same shard, so conflicts are exact.

Defined cases: a document without words (null or empty text) has one piece of size 0 and
a null bin; a null source is a source; repeated rows are packed each on its own (and
conflict, being one cluster); ties go by id, then piece; an empty table gives an empty
table; other columns never take part.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import materialise, read, word_count

CAPACITY = 2048
MAX_PER_SOURCE = 4
SHARD_ROWS = 4096
BIN_BITS = 24  # bins of a shard


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int,
             max_per_source: int) -> tuple[list[int], list[int]]:
    """Bin and start of each item, taken in the order given (largest first). ``sources``
    and ``clusters`` are small numbers; cluster -1 conflicts with none."""
    bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    where, start = [0] * len(sizes), [0] * len(sizes)
    lanes = max_per_source
    for k, size in enumerate(sizes):
        low = sources[k] * lanes
        full = 1 << (low + lanes - 1)
        mine = 1 << clusters[k] if clusters[k] >= 0 else 0
        i = bisect_left(bins, (size, -1))
        while i < len(bins) and (cluster_bits[bins[i][1]] & mine or source_bits[bins[i][1]] & full):
            i += 1
        if i < len(bins):
            residual, b = bins.pop(i)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        used = (source_bits[b] >> low) & ((1 << lanes) - 1)
        source_bits[b] |= (used + 1) << low  # lanes fill from the lowest bit
        cluster_bits[b] |= mine
        where[k], start[k] = b, capacity - residual
        if residual > size:
            insort(bins, (residual - size, b))
    return where, start


def _numbered(values: pa.ChunkedArray, alone: bool) -> list[int]:
    """Dense numbers, null being a value; with ``alone``, -1 for values that occur once."""
    codes = values.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    if alone:
        seen = np.bincount(codes, minlength=1)
        dense = np.cumsum(seen > 1) - 1
        codes = np.where(seen[codes] > 1, dense[codes], -1)
    return codes.tolist()


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, id_col: str = "doc_id",
         capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, size, source, bin, start): every word of every document in exactly one
    bin; ``start`` is the place of the piece in its bin and pieces follow one another in
    the text, ``piece * capacity`` words in."""
    n = F.col("n")
    narrow = docs.select(F.col(id_col).alias("id"), size.alias("n"), source.alias("source"),
                         cluster.alias("cluster"))
    pieces = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    narrow = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    narrow = materialise(narrow.select(
        "id", "piece", F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("size"),
        "source", "cluster", F.monotonically_increasing_id().alias("salt")), "pack-pieces")
    # bounded by shard_rows: one more shard for every so many pieces
    shards = max(1, -(-narrow.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id", "piece", "cluster", F.lit("shard")), F.lit(shards))
    # a third of all rows may be equal; equal rows are dealt by the number written with them
    salt = F.pmod(F.xxhash64("salt"), F.lit(shards))
    repeated = narrow.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    narrow = narrow.join(repeated.withColumnsRenamed({"id": "rid", "piece": "rpiece"}),
                         F.col("id").eqNullSafe(F.col("rid")) & (F.col("piece") == F.col("rpiece")), "left")
    dealt = narrow.withColumn("shard", F.when(F.col("copies").isNull(), shard).otherwise(salt)) \
        .drop("rid", "rpiece", "copies", "salt")

    def shard_bins(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("size", "descending"), ("id", "ascending"), ("piece", "ascending")]))
        some = rows.filter(pc.greater(rows["size"], 0))  # sizes of 0 come last
        where, start = best_fit(some["size"].to_pylist(), _numbered(some["source"], False),
                                _numbered(some["cluster"], True), capacity, max_per_source)
        base = rows["shard"][0].as_py() << BIN_BITS
        none = [None] * (len(rows) - len(some))
        return rows.select(["id", "piece", "size", "source"]) \
            .append_column("bin", pa.array([base + b for b in where] + none, pa.int64())) \
            .append_column("start", pa.array(start + none, pa.int64()))

    id_type = dict(narrow.dtypes)["id"]
    schema = f"id {id_type}, piece int, size bigint, source string, bin bigint, start bigint"
    return dealt.groupBy("shard").applyInArrow(shard_bins, schema)


def exact_copy_cluster(text: Column) -> Column:
    """Documents with the same text, up to case, are one cluster."""
    return F.md5(F.lower(F.coalesce(text, F.lit(""))))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", **options) -> DataFrame:
    return pack(docs, word_count(F.col(text_col)), F.col(source_col),
                exact_copy_cluster(F.col(text_col)), id_col, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return pack_documents(docs).withColumnRenamed("id", "doc_id")
