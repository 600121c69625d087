"""Overlapping periods of a series, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import offsets


def _base(time: Column, months: int, first: int) -> Column:
    """The number of the base period that a time falls in."""
    return F.floor((F.year(time) * 12 + F.month(time) - 1 - first) / months).cast("int")


def _start(number: Column, months: int, first: int) -> Column:
    month = number * months + first
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def stack_periods(df: DataFrame, window: int = 30, stride: int | None = None, min_length: int | None = None, by: Sequence[str] = (), time: str = "time", freq: str = "YS", align_days: bool = False, start: str | None = None, pad_value: float | None = None, value: str = "value") -> DataFrame:
    """df with `period` (start of a window) and `step` (from 1): a row for each window that a time falls in.

    Windows are `window` steps of freq (years, quarters or months) long and start every `stride` of them from
    the base period of the first time on. One must be covered to its end, or to min_length steps; where that
    is the window and periods are years or quarters, the first one counts only if the record begins in its
    first month. The rows of a time go to at most window / stride windows, found by arithmetic, without a join.

    align_days asks that days meet across periods, which dates of the standard calendar only do within single
    months. start adds `placeholder`, one time axis for all windows, in days. pad_value fills windows up to the
    longest with rows of that value and without a time.
    """
    stride = window if stride is None else stride
    least = window if min_length is None else min_length
    if stride > window or least > window:
        raise ValueError("stride and min_length are at most the window")
    months, first = offsets.months(freq)
    if align_days and (months >= 12 or window > 1):
        raise ValueError(f"days of {window} {freq} don't meet across periods of the standard calendar")
    whole = Window.partitionBy(*by)
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    own = df.withColumn("_b", _base(F.col(time), months, first)).withColumn("_from", F.min(time).over(whole)).withColumn("_first", F.min("_b").over(whole))
    # the record ends one step behind its last time
    step = F.coalesce(F.try_divide(F.max(seconds).over(whole) - F.min(seconds).over(whole), F.count(F.lit(1)).over(whole) - 1), F.lit(0.0))
    own = own.withColumn("_end", F.max(seconds).over(whole) + step)
    # window k starts at first + k stride; a time of base period b is in those that start from b - window + 1 to b
    low = F.greatest(F.lit(0), F.ceil((F.col("_b") - window + 1 - F.col("_first")) / stride).cast("int"))
    high = F.floor((F.col("_b") - F.col("_first")) / stride).cast("int")
    own = own.where(high >= low).withColumn("_k", F.explode(F.sequence(low, high)))
    at = F.col("_first") + F.col("_k") * stride
    covered = lambda k, n: F.unix_timestamp(_start(F.col("_first") + k * stride + n, months, first).cast("timestamp")) <= F.col("_end") + 0.5
    # none follows the first that isn't covered
    own = own.withColumn("_at", at).where(covered(F.col("_k"), least))
    if least == window and months % 3 == 0:
        opening = F.year("_from") * 12 + F.month("_from") - 1 == F.col("_first") * months + first
        own = own.where((F.col("_k") > 0) | opening)
    out = own.withColumn("period", _start(F.col("_at"), months, first))
    out = out.withColumn("step", F.row_number().over(Window.partitionBy(*by, "period").orderBy(time))).drop("_b", "_from", "_end", "_first", "_k", "_at")
    if pad_value is not None:
        sizes = out.groupBy(*by, "period").agg(F.max("step").alias("_n"))
        longest = sizes.agg(F.max("_n").alias("_most"))
        short = sizes.crossJoin(F.broadcast(longest)).where("_n < _most").withColumn("step", F.explode(F.sequence(F.col("_n") + 1, F.col("_most")))).drop("_n", "_most")
        out = out.unionByName(short.withColumn(value, F.lit(pad_value).cast(df.schema[value].dataType)), allowMissingColumns=True)
    return out if start is None else out.withColumn("placeholder", F.date_add(F.lit(start).cast("date"), F.col("step") - 1))


def unstack_periods(df: DataFrame, window: int, stride: int, by: Sequence[str] = (), time: str = "time", freq: str = "YS") -> DataFrame:
    """One row a time again: windows side by side as they are, else the middle stride of each; the first keeps all before it, the last all behind."""
    df = df.where(F.col(time).isNotNull()).drop("placeholder")
    if window == stride:
        return df.drop("period", "step")
    if window % stride or (window // stride) % 2 == 0:
        raise NotImplementedError("window / stride is an odd whole number")
    months, first = offsets.months(freq)
    half = (window // stride) // 2
    whole = Window.partitionBy(*by)
    place = F.floor((_base(F.col(time), months, first) - _base(F.col("period"), months, first)) / stride)
    own = df.withColumn("_p", place).withColumn("_first", F.min("period").over(whole)).withColumn("_last", F.max("period").over(whole))
    keep = (F.col("_p") == half) | ((F.col("period") == F.col("_first")) & (F.col("_p") < half)) | ((F.col("period") == F.col("_last")) & (F.col("_p") > half))
    return own.where(keep).drop("_p", "_first", "_last", "period", "step")


def rescale_days(df: DataFrame, days: int, by: Sequence[str] = (), doy: str = "doy", value: str = "value", source_days: int | None = None) -> DataFrame:
    """A table by day of the year on a calendar of `days` days: gaps filled, then days stretched from [1, source_days], linearly between neighbours."""
    n = source_days or 366
    w = Window.partitionBy(*by).orderBy(doy)
    known = df.where(F.col(value).isNotNull())
    own = known.withColumn("_x", 1 + (F.col(doy) - 1) * ((days - 1) / (n - 1)))
    own = own.withColumn("_x1", F.lead("_x").over(w)).withColumn("_v1", F.lead(value).over(w)).withColumn("_k", F.row_number().over(w))
    low = F.when(F.col("_k") == 1, F.lit(1)).otherwise(F.ceil(F.col("_x") - 1e-9).cast("int"))
    high = F.when(F.col("_x1").isNull(), F.lit(days)).otherwise((F.ceil(F.col("_x1") - 1e-9) - 1).cast("int"))
    own = own.withColumn("_d", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    at = F.when((F.col("_d") < F.col("_x")) | F.col("_x1").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("_d") - F.col("_x")) / (F.col("_x1") - F.col("_x")) * (F.col("_v1") - F.col(value)))
    return own.select(*by, F.col("_d").alias(doy), at.alias(value))
