"""Report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast.functions.columns import col


def fixed4(c) -> Column:
    """'%.4f' formatting of a metric."""
    return F.format_string("%.4f", col(c))


def percent2(c) -> Column:
    """'%.2f%%' formatting of an improvement."""
    return F.format_string("%.2f%%", col(c))
