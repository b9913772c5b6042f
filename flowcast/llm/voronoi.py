"""Exact top-k search by a Voronoi join.

Pivots (a bounded sample, ``n_pivots`` rows by a hash of id) split vectors into cells,
each vector going to its nearest pivot. A summary of each cell holds its size, radius and
the distances and ids of its k + 1 members nearest the pivot. For a query q and a cell with
pivot p, any member x at distance d from p scores within <q, p> +- |q| d. The lower ends of
the summarised members of other ids give the query a threshold that its k-th score reaches,
and the query is sent only to cells whose upper end <q, p> + |q| radius reaches it. Cells are cut into
blocks of bounded size, so a vector that fills a third of the table fills many blocks;
block and query chunk are multiplied by numpy, and each block returns at most k hits a
query, of which the k best remain.

Queries are few against the data, so a query is copied to its cells and data rows move
once. Scores are integers; products are exact in float64 below 2**53 and in int64 above.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; equal rows of one id are one query but each a
candidate; a query's own id is never its candidate; ties go to the smaller id; an empty
table gives an empty result; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowcast.llm.common import materialise, read

K = 5
N_PIVOTS = 64
BLOCK_ROWS = 4096
CHUNK_QUERIES = 4096  # queries that meet a block together; a block is copied once for each chunk
PRODUCT_QUERIES = 256  # of them, rows of one product
BLOCK_PAIRS = 16  # pairs of block and chunk a task, about 4 MB each
EVERY = 50


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as double, as longs; null where a component is null
    or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    # a double that is not finite is neither below infinity nor above its negative
    sound = F.forall(wide, lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * 256).cast("long")))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list array, padded with zeros to ``width``, as int64."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a and rows of b, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _assign(pivots: np.ndarray, width: int):
    """Cell and distance to its pivot, for each vector."""
    def of(vectors: pa.Array) -> pa.Array:
        x = matrix(vectors, width).astype(np.float64)
        p = pivots.astype(np.float64)
        square = (x ** 2).sum(1)[:, None] - 2 * (x @ p.T) + (p ** 2).sum(1)[None, :]
        cell = square.argmin(1)
        gap = np.sqrt(((x - p[cell]) ** 2).sum(1))
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(gap)], names=["cell", "gap"])
    return F.arrow_udf(of, "struct<cell:int,gap:double>")


SLACK = 1e-6  # relative room for rounding in bounds; only ever sends a query further


def _targets(pivots: np.ndarray, width: int, cells: np.ndarray, radius: np.ndarray,
             near_cell: np.ndarray, near_gap: np.ndarray, near_id: np.ndarray, k: int):
    """Cells that a query must visit, and the threshold of its score."""
    def of(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        q = matrix(vectors, width).astype(np.float64)
        size = np.sqrt((q ** 2).sum(1))
        dots = q @ pivots.astype(np.float64).T
        room = SLACK * (1 + np.abs(dots).max(initial=0) + size.max(initial=0) * radius.max(initial=0))
        lower = dots[:, near_cell] - size[:, None] * near_gap[None, :]
        # rows of the query's own id, however many, are no candidates and give no bound
        lower[ids.to_numpy(zero_copy_only=False)[:, None] == near_id[None, :]] = -np.inf
        if lower.shape[1] >= k:
            floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k] - room
        else:
            floor = np.full(len(q), -np.inf)
        upper = dots[:, cells] + size[:, None] * radius[None, :] + room
        visit = [cells[u >= t].astype(np.int32) for u, t in zip(upper, floor)]
        return pa.StructArray.from_arrays([pa.array(visit, pa.list_(pa.int32())), pa.array(floor)], names=["cells", "floor"])
    return F.arrow_udf(of, "struct<cells:array<int>,floor:double>")


def _dealt(celled: DataFrame, counts: DataFrame) -> DataFrame:
    """(cell, block, id, v): rows dealt to their cell's blocks by their number, so that
    copies of a row spread too."""
    return (celled.join(F.broadcast(counts), "cell")
            .withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks"))).select("cell", "block", "id", "v"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = K, n_pivots: int = N_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query row."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    sound = materialise(vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"),
                                       F.coalesce(is_query, F.lit(False)).alias("is_query"))
                        .where("v is not null"), "voronoi-vectors")
    width = sound.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    sample = sound.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(n_pivots).collect()
    pivots = matrix(pa.array([r["v"] for r in sample], pa.list_(pa.int64())), width)
    pivots = np.unique(pivots, axis=0)
    celled = materialise(sound.withColumn("c", _assign(pivots, width)("v"))
                         .select("id", "v", "is_query", "c.*", F.monotonically_increasing_id().alias("n")), "voronoi-cells")
    # summaries: one row a cell, and its k + 1 members nearest the pivot; one without an id
    # gives no bound
    cells = {r["cell"]: (r["n"], r["radius"]) for r in celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}
    nearest = Window.partitionBy("cell").orderBy("gap")
    near = (celled.where("id is not null").select("cell", "gap", "id", F.row_number().over(nearest).alias("r"))
            .where(F.col("r") <= k + 1).collect())
    order = np.array(sorted(cells), np.int64)
    targets = _targets(pivots, width, order, np.array([cells[c][1] for c in order.tolist()], float),
                       np.array([r["cell"] for r in near], np.int64), np.array([r["gap"] for r in near], float),
                       np.array([r["id"] for r in near], np.int64), k)
    blocks = {c: -(-n // block_rows) for c, (n, _) in cells.items()}
    counts = spark.createDataFrame([(int(c), int(b)) for c, b in blocks.items()], "cell int, blocks bigint")
    packed = _dealt(celled, counts).groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    queries = (celled.where("is_query").select("id", "v").distinct()
               .withColumn("t", targets("id", "v")).select("id", "v", "t.floor", F.explode("t.cells").alias("cell"))
               .join(F.broadcast(counts), "cell"))
    total = sum(blocks.values())
    chunks = max(1, -(-queries.select("id").distinct().count() // CHUNK_QUERIES)) if total else 1
    chunked = (queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
               .groupBy("cell", "chunk", "blocks").agg(F.collect_list(F.struct("id", "v", "floor")).alias("asked"))
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .select("cell", "block", "asked"))
    pairs = packed.join(chunked, ["cell", "block"]).select("rows", "asked")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column(0), batch.column(1)):
                yield _block_hits(rows.values, asked.values, width, k)

    hits = pairs.repartition(max(2 * len(cells), -(-total * chunks // BLOCK_PAIRS))).mapInArrow(solve, "query_id bigint, q bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _block_hits(rows: pa.StructArray, asked: pa.StructArray, width: int, k: int) -> pa.RecordBatch:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    qids = asked.field("id").to_numpy(zero_copy_only=False)
    floor = asked.field("floor").to_numpy(zero_copy_only=False)
    by_id = np.argsort(ids, kind="stable")  # a stable sort by score then keeps smaller ids first
    ids, x = ids[by_id], matrix(rows.field("v"), width)[by_id]
    q = matrix(asked.field("v"), width)
    scores = (row for at in range(0, len(q), PRODUCT_QUERIES) for row in products(q[at:at + PRODUCT_QUERIES], x))
    out: list[tuple[np.ndarray, ...]] = []
    for i, row in enumerate(scores):
        fit = np.flatnonzero((row >= floor[i]) & (ids != qids[i]))
        if len(fit) > k:
            cut = np.partition(row[fit], len(fit) - k)[len(fit) - k]
            fit = fit[row[fit] >= cut]
        fit = fit[np.argsort(-row[fit], kind="stable")][:k]
        out.append((np.full(len(fit), qids[i]), np.full(len(fit), xxhash.xxh64_intdigest(q[i].tobytes()) >> 1), ids[fit], row[fit]))
    parts = [np.concatenate(p).astype(np.int64) for p in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["query_id", "q", "vec_id", "score"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
