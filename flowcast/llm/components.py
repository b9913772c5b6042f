"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcast.llm.common import materialise


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number of each of 0..n-1 over edges (u, v)."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        differ = a != b
        if not differ.any():
            return top
        np.minimum.at(top, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its
    component, and roots are listed too.

    A large star joins each node's larger neighbours to its smallest one; a small star
    does so for the smaller neighbours. Both take the minimum with map-side partial
    aggregation and join it back, so no group meets in one task (AQE splits a node with
    very many edges), and the edges end as stars in a number of rounds that grows with
    the logarithm of the longest chain. Every round is written to the shared folder."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialise(e, "components")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that each join shuffles both sides by itself
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "components-low")
        # larger neighbours only: rows (v, m) for v > u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(large, "components-large")
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = large.join(low2, "u").select("u", "v", "m")
        e = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                          F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        e = materialise(e, "components")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _mark(e: DataFrame) -> tuple:
    """Changes when the set of edges changes."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
