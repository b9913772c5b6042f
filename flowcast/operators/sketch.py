"""Mergeable quantile sketches: the approximate mode of D6, D13 and D14.

A sketch is one KLL summary a group and column, some ``k`` values large whatever the number
of rows. Sketches are built with map-side partial aggregation, so a group that holds a third
of all rows leaves each task as one small value, and they merge: those of new data can be
merged into stored ones, and those of hours into days, without reading the rows again.

A quantile from a sketch is a value of the data (there is no interpolation) whose rank is off
by less than :func:`rank_error` of the rows with 99 % confidence; the least and greatest
values and the number of rows are exact, and so is every quantile of a group that has no more
than ``k`` rows. NULL and NaN are left out. A group without values has NULL quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4096


def rank_error(k: int = K) -> float:
    """Share of the rows by which the rank of a quantile may be off (99 % confidence)."""
    return 2.296 / k ** 0.9723  # fixed values of the sketch's published error bound


def _values(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def quantile_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by..., column, sketch): one sketch a group and column, all in one aggregation."""
    cols, by = list(cols), list(by)
    made = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(_values(c), k).alias(f"_fc_k{i}") for i, c in enumerate(cols)])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_fc_k{i}").alias("sketch"))
                              for i, c in enumerate(cols)]))
    return made.select(*by, rows)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, sketch): the sketches of all rows with the same ``by`` merged. With
    fewer columns than they were built by, this is a roll-up; after a union with the sketches
    of new data, an incremental update."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_count(sketch: str | Column = "sketch") -> Column:
    """Number of values that a sketch has seen (exact)."""
    return F.kll_sketch_get_n_double(sketch)


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """``sketches`` with one column a probability in place of the sketch."""
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    # one lookup for all probabilities; a sketch that has seen no value has none
    found = F.when(sketch_count() > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs])))
    out = sketches.withColumn("_fc_q", found)
    rest = [F.col(f"`{c}`") for c in sketches.columns if c != "sketch"]
    return out.select(*rest, *[F.get("_fc_q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def approx_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                     names: Sequence[str] | None = None, k: int = K) -> DataFrame:
    """The approximate form of :func:`ordered.exact_quantiles`: one row a group, one column a
    probability, by one aggregation instead of a range shuffle over the distinct values."""
    return sketch_quantiles(quantile_sketches(df, [col], by, k), probs, names).drop("column")
