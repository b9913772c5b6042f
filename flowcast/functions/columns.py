"""Null hygiene and small column helpers.

pandas has a single missing marker (NaN) that aggregates skip. Spark keeps
NaN as a value (``avg`` over a NaN is NaN, NaN sorts above every number), so
every source turns NaN and +/-Inf into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    c = col(c)
    return ~(F.isnan(c) | (c == F.lit(_INF)) | (c == F.lit(-_INF)))


def clean_double(c) -> Column:
    """NaN and +/-Inf become NULL (B10 ``inf_to_null`` on one column)."""
    c = col(c)
    return F.when(c.isNotNull() & is_finite(c), c)


def guarded_clip(c, lower, upper) -> Column:
    """``clip`` that keeps NULLs (``greatest``/``least`` would skip them)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, col(lower)), col(upper)))


def pearson(a, b) -> Column:
    """Pearson correlation of the pairs without NULL, an aggregate; NaN, not an error, if either
    side does not vary over them, as in SQL engines whose division by zero is no error."""
    a, b = col(a), col(b)
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def truthy(cond: Column) -> Column:
    """A comparison with a NULL operand is False, as in pandas."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """Boolean condition (NULL counts as False) as a 0/1 integer."""
    return truthy(cond).cast("int")


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns, widen integral ones to BIGINT and dates to
    timestamps so results compare across engines (summation order differs
    between engines)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # (1 + 1e-12): see TIE_NUDGE in flowcast.plans.catalog
            # + 0.0 turns a rounded -0.0 into 0.0
            out.append((F.round(c.cast("double") * F.lit(1.0 + 1e-12), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(c.cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            # dates as midnight timestamps: one representation across engines
            out.append(c.cast("timestamp_ntz").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def with_scalars(df: DataFrame, one_row: DataFrame, name: str) -> tuple[DataFrame, dict[str, Column]]:
    """Attach a one-row aggregate to every row of ``df`` as ONE struct column
    ``name`` filled by a scalar subquery; return the frame and field references.

    The subquery runs once and its value is inlined (no join, no cross product),
    and it appears once in the plan, so the upstream plan is planned once. Drop
    ``name`` when done.
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("s")).scalar()
    return df.select("*", packed.alias(name)), {c: F.col(f"`{name}`.`{c}`") for c in one_row.columns}
