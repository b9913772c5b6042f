"""Calendar features (G1) and the US federal holiday calendar (C4).

The calendar is generated by Spark from date rules, one row per holiday date,
so it can be joined (C3) instead of calling a Python predicate per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.functions.columns import col


def hour(ts="ts") -> Column:
    return F.hour(col(ts))


def day_of_week(ts="ts") -> Column:
    """Monday=0 ... Sunday=6 (Spark ``weekday``; ``dayofweek`` is Sunday=1)."""
    return F.weekday(col(ts))


def month(ts="ts") -> Column:
    return F.month(col(ts))


def calendar_columns(ts="ts") -> dict[str, Column]:
    """G1: hour, day_of_week (Monday=0), month."""
    return {"hour": hour(ts), "day_of_week": day_of_week(ts), "month": month(ts)}


def _nth_weekday(y: Column, m: int, dow: str, n: int) -> Column:
    # next_day is strictly after its argument, so start from the last day of the previous month
    start = F.date_sub(F.make_date(y, F.lit(m), F.lit(1)), 1)
    return F.date_add(F.next_day(start, dow), 7 * (n - 1))


def _last_weekday(y: Column, m: int, last_day: int, dow: str) -> Column:
    return F.next_day(F.date_sub(F.make_date(y, F.lit(m), F.lit(last_day)), 7), dow)


def _observed(d: Column) -> Column:
    """Saturday moves to the Friday before, Sunday to the Monday after."""
    dow = F.dayofweek(d)  # Sunday=1, Saturday=7
    return F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1))


def holiday_rules(y: Column) -> list[tuple[str, Column, bool]]:
    """(name, date, has_observed_day) for year ``y``; NULL where a rule does not apply.

    Fixed values (federal holidays, valid from 1971):
    New Year's Day 1 January; Martin Luther King Jr. Day third Monday of January
    (from 1986); Washington's Birthday third Monday of February; Memorial Day last
    Monday of May; Juneteenth National Independence Day 19 June (from 2021);
    Independence Day 4 July; Labor Day first Monday of September; Columbus Day
    second Monday of October; Veterans Day 11 November (fourth Monday of October
    in 1971-1977); Thanksgiving fourth Thursday of November; Christmas Day
    25 December. Fixed-date holidays also have an observed day.
    """
    def md(m, d):
        return F.make_date(y, F.lit(m), F.lit(d))

    veterans_fixed = (y < 1971) | (y > 1977)
    return [
        ("New Year's Day", md(1, 1), True),
        ("Martin Luther King Jr. Day", F.when(y >= 1986, _nth_weekday(y, 1, "Mon", 3)), False),
        ("Washington's Birthday", _nth_weekday(y, 2, "Mon", 3), False),
        ("Memorial Day", _last_weekday(y, 5, 31, "Mon"), False),
        ("Juneteenth National Independence Day", F.when(y >= 2021, md(6, 19)), True),
        ("Independence Day", md(7, 4), True),
        ("Labor Day", _nth_weekday(y, 9, "Mon", 1), False),
        ("Columbus Day", _nth_weekday(y, 10, "Mon", 2), False),
        ("Veterans Day", F.when(veterans_fixed, md(11, 11)).otherwise(_nth_weekday(y, 10, "Mon", 4)), True),
        ("Thanksgiving", _nth_weekday(y, 11, "Thu", 4), False),
        ("Christmas Day", md(12, 25), True),
    ]


def holidays_for_years(years: DataFrame, year_col: str = "year") -> DataFrame:
    """C4 over a DataFrame of years: (date, name), including observed days.

    An observed day may fall in the neighbouring year (1 January on a Saturday is
    observed on 31 December before). At most 22 rows per input year.
    """
    y = F.col(year_col).cast("int")
    entries = []
    for name, d, observed in holiday_rules(y):
        entries.append(F.struct(d.alias("date"), F.lit(name).alias("name")))
        if observed:
            entries.append(F.struct(_observed(d).alias("date"), F.lit(name + " (observed)").alias("name")))
    return (
        years.select(F.explode(F.array(*entries)).alias("h"))
        .select("h.date", "h.name")
        .where(F.col("date").isNotNull())
    )


def us_holidays(spark: SparkSession, from_year: int, to_year: int) -> DataFrame:
    """C4: US federal holiday calendar for ``from_year..to_year`` (date, name)."""
    years = spark.range(from_year, to_year + 1).select(F.col("id").cast("int").alias("year"))
    return holidays_for_years(years)
