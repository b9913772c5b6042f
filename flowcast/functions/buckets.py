"""Tumbling time buckets.

Buckets are left-closed and left-labelled. Multi-day buckets are aligned to
Monday 2000-01-03 (the origin SQL engines commonly use), so a 7-day bucket
starts on a Monday; sub-day widths that divide a day are origin-free.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast.functions.columns import col

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
_ORIGIN_EPOCH_SECONDS = 10959 * 86400  # 2000-01-03 00:00


def width_seconds(width: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week)s?\s*", width)
    if not m:
        raise ValueError(f"unsupported bucket width: {width!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def time_bucket(ts, width: str) -> Column:
    """Start of the tumbling bucket of ``width`` containing ``ts`` (same timestamp type)."""
    w = width_seconds(width)
    offset = _ORIGIN_EPOCH_SECONDS % w
    start = f"{offset} seconds" if offset else "0 seconds"
    return F.window(col(ts), f"{w} seconds", f"{w} seconds", start).start
