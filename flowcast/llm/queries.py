"""Queries of the corpus operators and their SQL twins, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowcast.llm import (block_anchors, line_dedup, mixing, packing, periodic_runs, prefix_trie, quality_gam,
                          quality_rules, repeats, secrets, simhash, token_counts, voronoi)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.query,
    "op2_secret_scan": secrets.query,
    "op3_simhash": simhash.query,
    "op4_best_fit": packing.query,
    "op5_suffix_dedup": repeats.query,
    "op6_quality_gam": quality_gam.query,
    "op7_voronoi_topk": voronoi.query,
    "op8_quality_rules": quality_rules.query,
    "op9_line_dedup": line_dedup.query,
    "op10_token_counts": token_counts.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_block_anchors": block_anchors.query,
    "op13_periodic_runs": periodic_runs.query,
}

# Twins that DuckDB can run on the same tables; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op7_voronoi_topk": voronoi.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_block_anchors": block_anchors.SQL,
}
