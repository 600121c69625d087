"""Order statistics of series, as window functions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import kernels as K


def average_rank(value: str, part: Sequence[str]) -> Column:
    """Rank from 1 among the values of a part, ties averaged, NULL for NULL."""
    order = Window.partitionBy(*part).orderBy(F.col(value).asc_nulls_last())
    ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def percent_rank(df: DataFrame, value: str, part: Sequence[str], out: str = "rank", tie_break: Sequence[Column | str] | None = None, seed: int = 0) -> DataFrame:
    """df with ranks as shares of the count, stretched from [least, greatest] to [0, greatest]; one value alone gives NULL.

    tie_break: columns that break ties in the order of a hash of them, instead of averaging.
    """
    known = F.col(value).isNotNull()
    if tie_break:
        rank = F.when(known, F.row_number().over(Window.partitionBy(*part).orderBy(F.col(value).asc_nulls_last(), C.uniform(*tie_break, seed=seed))).cast("double"))
    else:
        rank = average_rank(value, part)
    whole = Window.partitionBy(*part)
    own = df.withColumn("_rank", rank / F.count(value).over(whole))
    least, most = F.min("_rank").over(whole), F.max("_rank").over(whole)
    return own.withColumn(out, most * F.try_divide(F.col("_rank") - least, most - least)).drop("_rank")


def ecdf(df: DataFrame, threshold: Column, by: Sequence[str], value: str = "value", out: str = "ecdf") -> DataFrame:
    """Share of values up to the threshold."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(value).isNotNull(), (F.col(value) <= threshold).cast("double"))).alias(out))


def at_quantile(df: DataFrame, q: str, by: Sequence[str], value: str = "value", out: str = "quantile") -> DataFrame:
    """One row a group: the quantile that column q, the same in all rows of a group, asks for.

    The order statistics around (n - 1) q come from row numbers, as percentile() takes constants only.
    """
    known = df.where(F.col(value).isNotNull() & F.col(q).isNotNull())
    part = Window.partitionBy(*by)
    own = known.withColumn("_k", F.row_number().over(part.orderBy(value)) - 1).withColumn("_p", (F.count("*").over(part) - 1) * F.col(q))
    own = own.where((F.col("_k") == F.floor("_p")) | (F.col("_k") == F.ceil("_p")))
    low, high = F.min(value), F.max(value)
    return own.groupBy(*by).agg((low + (F.first("_p") - F.floor(F.first("_p"))) * (high - low)).alias(out))


def map_cdf(x: DataFrame, y: DataFrame, y_value: float, by: Sequence[str], value: str = "value", out: str = "mapped") -> DataFrame:
    """The value of x whose cumulative probability is that of y_value in y; one more than the counts stands on both sides of the share."""
    share = y.where(F.col(value).isNotNull()).groupBy(*by).agg(((1 + F.sum((F.col(value) <= y_value).cast("long"))) / (1 + F.count("*"))).alias("_q"))
    return at_quantile(x.join(share, list(by)), "_q", by, value, out)


def ordered(df: DataFrame, by: Sequence[str], value: str = "value", out: str = "place") -> DataFrame:
    """df with the place of each value in the sorted part, ties in order of time; NULL last."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), "time")))


def runs(df: DataFrame, condition: Column, by: Sequence[str], time: str = "time") -> DataFrame:
    """df with `run`: a number for each stretch of rows on which the condition holds, NULL elsewhere."""
    w = Window.partitionBy(*by).orderBy(time)
    own = df.withColumn("_in", F.coalesce(condition, F.lit(False)))
    starts = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)
    return own.withColumn("_start", starts).withColumn("run", F.when(F.col("_in"), F.sum("_start").over(w))).drop("_in", "_start")


def clusters(df: DataFrame, u1: Column | float, u2: Column | float, by: Sequence[str], value: str = "value", time: str = "time") -> DataFrame:
    """(by, cluster, start, end, maxpos, maximum): runs above u2 whose maximum is above u1; the earliest of equal maxima."""
    high, low = (x if isinstance(x, Column) else F.lit(x) for x in (u1, u2))
    own = runs(df.withColumn("_high", high), F.col(value) > low, by, time).where("run IS NOT NULL")
    out = own.groupBy(*by, "run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min(F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))).alias("_top"), F.max(value).alias("maximum"), F.max("_high").alias("_high"))
    out = out.where(F.col("maximum") > F.col("_high"))
    return out.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("start")).alias("cluster"), "start", "end", F.col("_top.t").alias("maxpos"), "maximum")


def tie_break(df: DataFrame, by: Sequence[str], value: str = "value", keys: Sequence[str] = ("time",), out: str = "broken", seed: int = 0) -> DataFrame:
    """Values plus noise of 0.1 to 0.25 of the least gap between them."""
    w = Window.partitionBy(*by)
    gap = F.col(value) - F.lag(value).over(w.orderBy(value))
    own = df.withColumn("_gap", gap).withColumn("_least", F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).over(w))
    return own.withColumn(out, F.col(value) + F.coalesce("_least", F.lit(0.0)) * (0.1 + 0.15 * C.uniform(*by, *keys, seed=seed))).drop("_gap", "_least")


def bin_widths(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Freedman-Diaconis widths, Scott's where the quartiles meet."""
    def width(v: str) -> Column:
        n = F.pow(F.count(v), F.lit(-1 / 3))
        spread = 2 * (F.percentile(v, 0.75) - F.percentile(v, 0.25)) * n
        return F.when(spread == 0, 3.49 * F.stddev_pop(v) * n).otherwise(spread).alias(v)

    return df.groupBy(*by).agg(*map(width, values))


def histogram(df: DataFrame, widths: dict[str, float], origin: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, bins, centres, frequency): the filled cells of a grid over several columns."""
    own = df.dropna(subset=list(widths))
    cell = [F.floor((F.col(v) - origin) / w).alias(f"bin_{v}") for v, w in widths.items()]
    names = [f"bin_{v}" for v in widths]
    out = own.groupBy(*by, *cell).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return out.select(*by, *names, *(((F.col(f"bin_{v}") + 0.5) * w + origin).alias(f"centre_{v}") for v, w in widths.items()), (F.col("n") / total).alias("frequency"))


def first_known(value: str, time: str = "time") -> Column:
    """The earliest value that isn't NULL, as an aggregate."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(time)))


def last_known(value: str, time: str = "time") -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time)))


def fitted(df: DataFrame, dist: str, method: str = "ML", by: Sequence[str] = (), value: str = "value", loc: float | None = None) -> DataFrame:
    """(by, shape, loc, scale): a distribution fitted to the values of each part, see kernels.fit(); NULL where there is no fit."""
    if dist not in K.DENSITIES:
        raise ValueError(f"dist is one of {sorted(K.DENSITIES)}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[list(by)].head(1).reset_index(drop=True).copy() if by else pd.DataFrame(index=[0])
        found = K.fit(pdf[value].to_numpy(float), dist, method, loc)
        for name, x in zip(("shape", "loc", "scale"), found):
            out[name] = None if math.isnan(x) else x
        return out

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "shape double, loc double, scale double"])
    return df.select(*by, value).groupBy(*(by or [F.lit("all")])).applyInPandas(run, schema)
