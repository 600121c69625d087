"""Calendars that dates can't hold: days are numbered from a start, and year, month, day and day of year follow by arithmetic."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of months.
MONTHS = {"noleap": [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "all_leap": [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "360_day": [30] * 12}
ALIASES = {"365_day": "noleap", "366_day": "all_leap", "gregorian": "standard", "proleptic_gregorian": "standard"}


def named(calendar: str) -> str:
    out = ALIASES.get(calendar, calendar)
    if out != "standard" and out not in MONTHS:
        raise ValueError(f"unknown calendar {calendar!r}")
    return out


def max_doy(calendar: str) -> int:
    calendar = named(calendar)
    return 366 if calendar == "standard" else sum(MONTHS[calendar])


def with_parts(df: DataFrame, calendar: str, day: str = "tidx", first_year: int = 2000) -> DataFrame:
    """df with year, month, dom, doy and month_length of its day numbers; 0 is January 1 of the first year."""
    months = MONTHS[named(calendar)]
    n = sum(months)
    ends = list(accumulate(months))
    doy = F.pmod(F.col(day), F.lit(n)) + 1
    month: Column = F.lit(12)
    before: Column = F.lit(ends[10])
    length: Column = F.lit(months[11])
    for i in range(10, -1, -1):
        inside = doy <= ends[i]
        month = F.when(inside, i + 1).otherwise(month)
        before = F.when(inside, ends[i] - months[i]).otherwise(before)
        length = F.when(inside, months[i]).otherwise(length)
    year = (F.floor(F.col(day) / n) + first_year).cast("int")
    return df.withColumns({"year": year, "month": month, "dom": (doy - before).cast("int"), "doy": doy.cast("int"), "month_length": length})


def part_key(group: str) -> Column:
    """As columns.group_key(), from parts."""
    return {"time": lambda: F.lit(1), "time.month": lambda: F.col("month"), "time.season": lambda: F.floor(F.pmod("month", F.lit(12)) / 3).cast("int"), "time.dayofyear": lambda: F.col("doy")}[group]()


def part_index(group: str, calendar: str) -> Column:
    """As columns.group_index(), from parts."""
    n = max_doy(calendar)
    if group == "time.month":
        return F.col("month") - 0.5 + F.col("dom") / F.col("month_length")
    if group == "time.season":
        return F.col("doy") / n * 4 - F.lit(1 / 6)
    if group == "time.dayofyear":
        return F.col("doy").cast("double")
    raise ValueError(f"no continuous index for {group!r}")
