"""Sort, limit and top-k (F1-F4). Limits are the feature here (reports of the
first/last rows or top features); a global ``orderBy(...).limit(n)`` plans as a
TakeOrderedAndProject, which keeps only n rows per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_time(df: DataFrame, ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """range-partitioned global sort by time and tie-breakers."""
    return df.orderBy(ts, *tiebreak)


def top_features(imp: DataFrame, k: int, score: str = "importance", name: str = "feature") -> DataFrame:
    """F2: the k highest scores (ties by name)."""
    return imp.orderBy(F.col(score).desc(), F.col(name).asc()).limit(k)


def head_rows(df: DataFrame, n: int, ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """first n rows in time order."""
    return df.orderBy(ts, *tiebreak).limit(n)


def tail_rows(df: DataFrame, n: int, ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """last n rows in time order."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]).limit(n)
