"""Registry of named queries: each pairs a Spark plan over the driver tables with
its DuckDB SQL twin (or none, for model fits and random operators).

Spark results pass through :func:`finish`, which rounds floating columns and
widens integral ones to BIGINT; the SQL twins round and cast the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowcast.functions.columns import round_doubles


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: int = 6
    ids: str = ""  # SURVEY section 2 ids covered


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    return round_doubles(df, digits)


def register(name: str, sql: str | None, digits: int = 6, ids: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), digits)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, digits, ids)
        return fn
    return deco


# Values built from 2-decimal prices often sit exactly on a rounding tie, where
# engines that sum in different orders land one ulp apart on either side. Both
# sides scale by (1 + TIE_NUDGE) before rounding so such ties round the same way.
TIE_NUDGE = 1e-12


def rnd(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`flowcast.functions.columns.round_doubles` for one column."""
    return f"round(CAST({expr} AS DOUBLE) * (1 + {TIE_NUDGE}), {digits}) + 0.0::DOUBLE"


def wrap(inner: str, doubles: str = "", ints: str = "", keep: str = "", digits: int = 6) -> str:
    """Final projection of a SQL twin: round doubles, cast integers to BIGINT."""
    cols = [f'{rnd(chr(34) + c + chr(34), digits)} AS "{c}"' for c in doubles.split()]
    cols += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    cols += [f'"{c}"' for c in keep.split()]
    return f"SELECT {', '.join(cols)} FROM (\n{inner}\n) q"
