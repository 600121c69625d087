"""Trends of series: each function adds a `trend` column, which detrended() and retrended() take off and put back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import columns as C
from tidemark.functions.kernels import loess
from tidemark.operators.grouping import Grouper, grouped


def detrended(df: DataFrame, kind: str = "+", value: str = "value", skip_zeros: bool = False) -> DataFrame:
    """skip_zeros keeps values where a trend of kind * is 0."""
    out = C.corrected(F.col(value), C.inverse(F.col("trend"), kind), kind)
    return df.withColumn(value, F.when(F.col("trend") == 0, F.col(value)).otherwise(out) if skip_zeros and kind == "*" else out)


def retrended(df: DataFrame, kind: str = "+", value: str = "value", skip_zeros: bool = False) -> DataFrame:
    out = C.corrected(F.col(value), F.col("trend"), kind)
    return df.withColumn(value, F.when(F.col("trend") == 0, F.col(value)).otherwise(out) if skip_zeros and kind == "*" else out)


def none(df: DataFrame, kind: str = "+") -> DataFrame:
    return df.withColumn("trend", F.lit(0.0 if kind == "+" else 1.0))


def mean(df: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    g = Grouper.of(group)
    if g.window == 1:
        return df.withColumn("trend", F.avg(value).over(Window.partitionBy(*by, g.key())))
    norms = grouped(df, g, by).groupBy(*by, "grp").agg(F.avg(value).alias("trend"))
    return df.withColumn("grp", g.key()).join(norms, [*by, "grp"], "left").drop("grp")


def polynomial(df: DataFrame, group: str | Grouper = "time", kind: str = "+", degree: int = 4, by: Sequence[str] = (), value: str = "value", preserve_mean: bool = False) -> DataFrame:
    """Least squares over days, by group, for groups of more than `degree` different known times.

    The trend is a sum of polynomials orthogonal over the known times of the group, each from the two before
    it; their products are window sums over one partitioning, so that no row leaves the JVM.
    """
    w = Window.partitionBy(*by, "_g")
    known = F.col(value).isNotNull()
    days = F.unix_timestamp(F.col("time").cast("timestamp")) / 86400.0
    own = df.withColumn("_g", Grouper.of(group).key()).withColumn("_t", days)
    first, last = F.min(F.when(known, F.col("_t"))).over(w), F.max(F.when(known, F.col("_t"))).over(w)
    own = own.withColumn("_x", F.coalesce(F.try_divide(2 * (F.col("_t") - first), last - first), F.lit(0.0)) - 1)
    at = F.when(known, F.col("_x"))
    own = own.withColumn("_p", F.lit(1.0)).withColumn("_before", F.lit(0.0)).withColumn("_norm_before", F.lit(1.0)).withColumn("trend", F.avg(value).over(w))
    for _ in range(degree):
        own = own.withColumn("_norm", F.sum(F.when(known, F.col("_p") * F.col("_p"))).over(w))
        own = own.withColumn("_a", F.try_divide(F.sum(at * F.col("_p") * F.col("_p")).over(w), F.col("_norm")))
        own = own.withColumn("_next", (F.col("_x") - F.col("_a")) * F.col("_p") - F.col("_norm") / F.col("_norm_before") * F.col("_before"))
        own = own.withColumn("_before", F.col("_p")).withColumn("_norm_before", F.col("_norm")).withColumn("_p", F.col("_next"))
        share = F.try_divide(F.sum(F.col(value) * F.col("_p")).over(w), F.sum(F.when(known, F.col("_p") * F.col("_p"))).over(w))
        own = own.withColumn("trend", F.col("trend") + share * F.col("_p"))
    enough = F.count(value).over(w) > degree
    out = own.withColumn("trend", F.when(enough, F.col("trend"))).drop("_t", "_x", "_p", "_before", "_norm_before", "_norm", "_a", "_next")
    if preserve_mean:
        out = out.withColumn("trend", C.corrected(F.col("trend"), C.inverse(F.avg("trend").over(w), kind), kind))
    return out.drop("_g")


def rolling_mean(df: DataFrame, win: int = 30, weights: Sequence[float] | None = None, min_periods: int | None = None, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Centred rolling mean: complete windows only, or of min_periods values; weights are normalised."""
    if weights is not None and (min_periods is not None or len(weights) != win):
        raise ValueError("weights need a window of their length, and no min_periods")
    before, after = win // 2, win - 1 - win // 2
    frame = Window.partitionBy(*by).orderBy("time").rowsBetween(-before, after)
    if weights is None:
        return df.withColumn("trend", F.when(F.count(value).over(frame) >= (min_periods or win), F.avg(value).over(frame)))
    total = float(sum(weights))
    order = Window.partitionBy(*by).orderBy("time")
    parts = [F.lag(value, before - i).over(order) * (w / total) for i, w in enumerate(weights)]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return df.withColumn("trend", out)


def local_regression(df: DataFrame, by: Sequence[str] = (), value: str = "value", f: float = 0.2, niter: int = 1, d: int = 0, weights: str = "tricube", equal_spacing: bool | None = None, group: str | Grouper = "time", skipna: bool = True) -> DataFrame:
    """LOESS of the series of each site and group; one series is one task's work.

    skipna leaves missing values out; without it a series that misses any has no trend.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        t = pd.to_datetime(pdf["time"]).to_numpy().astype("datetime64[s]").astype(float)
        y = pdf[value].to_numpy(float)
        if not skipna and np.isnan(y).any():
            return pdf.assign(trend=np.nan)
        return pdf.assign(trend=loess(t, y, f=f, niter=niter, d=d, weights=weights, equal_spacing=equal_spacing))

    own = df.withColumn("_g", Grouper.of(group).key())
    schema = StructType([*own.schema.fields, StructField("trend", DoubleType())])
    return own.groupBy(*by, "_g").applyInPandas(fit, schema).withColumn("trend", F.nanvl("trend", F.lit(None).cast("double"))).drop("_g")
