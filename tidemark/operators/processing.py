"""Work on series before and after an adjustment."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.kernels import total_distance
from tidemark.operators import stats
from tidemark.operators.grouping import Grouper, grouped


def jitter(df: DataFrame, value: str = "value", lower: float | None = None, upper: float | None = None, minimum: float = 0.0, maximum: float | None = None, keys: Sequence[str] = ("time",), seed: int = 0) -> DataFrame:
    """Values under `lower` drawn anew from above `minimum` to `lower`, those at `upper` or more from `upper` to `maximum`."""
    if upper is not None and maximum is None:
        raise ValueError("an upper threshold needs a maximum")
    x = F.col(value)
    out = x
    if lower is not None:
        low = math.nextafter(minimum, math.inf)
        out = F.when(x < lower, low + (lower - low) * C.uniform(*keys, seed=seed)).otherwise(out)
    if upper is not None:
        out = F.when(x >= upper, upper + (maximum - upper) * C.uniform(*keys, seed=seed + 1)).otherwise(out)
    return df.withColumn(value, out)


def noise(low: float = 1e-6, high: float = 1e-3, keys: Sequence[str] = ("time",), seed: int = 0) -> Column:
    return low + (high - low) * C.uniform(*keys, seed=seed)


def dry_shares(ref: DataFrame, sim: DataFrame, group: str | Grouper, thresh: float, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, grp, P0_ref, P0_hist, dP0, pth): shares of values up to the threshold, how far they differ, and the value of ref that the excess of sim reaches."""
    def share(df: DataFrame, name: str) -> DataFrame:
        return grouped(df, group, by).groupBy(*by, "grp").agg(F.avg(F.when(F.col(value).isNotNull(), (F.col(value) <= thresh).cast("double"))).alias(name))

    both = share(ref, "P0_ref").join(share(sim, "P0_hist"), [*by, "grp"]).withColumn("dP0", F.try_divide(F.col("P0_hist") - F.col("P0_ref"), F.col("P0_hist")))
    asked = grouped(ref, group, by).join(both.where("dP0 > 0").select(*by, "grp", "P0_hist"), [*by, "grp"])
    return both.join(stats.at_quantile(asked, "P0_hist", [*by, "grp"], value, "pth"), [*by, "grp"], "left")


def adapt_with(sim: DataFrame, shares: DataFrame, group: str, thresh: float, by: Sequence[str] = (), value: str = "value", keys: Sequence[str] = ("time",), seed: int = 0) -> DataFrame:
    """sim with the dry values that it has beyond ref's share drawn anew from the threshold to pth; shares as of dry_shares()."""
    own = grouped(sim, Grouper.of(group).group, by).drop("main")
    part = Window.partitionBy(*by, "grp")
    own = own.withColumn("_p0", F.avg(F.when(F.col(value).isNotNull(), (F.col(value) <= thresh).cast("double"))).over(part))
    own = stats.percent_rank(own, value, [*by, "grp"], "_place", tie_break=[*by, *keys], seed=seed)
    own = own.join(shares.select(*by, "grp", "P0_ref", "P0_hist", "dP0", "pth"), [*by, "grp"], "left")
    drawn = (F.col("dP0") > 0) & (F.col("_place") >= F.try_divide(F.col("P0_ref"), F.col("P0_hist")) * F.col("_p0")) & (F.col("_place") <= F.col("_p0"))
    out = F.when(drawn, thresh + (F.col("pth") - thresh) * C.uniform(*by, *keys, seed=seed + 1)).otherwise(F.col(value))
    return own.withColumn(value, out).drop("_p0", "_place", "P0_ref", "P0_hist", "dP0", "pth")


def adapt_freq(ref: DataFrame | None, sim: DataFrame, group: str | Grouper, thresh: float, by: Sequence[str] = (), value: str = "value", seed: int = 0, shares: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sim with `grp`, shares): frequency adaptation of dry values.

    In place of ref, shares (by, grp, P0_ref, P0_hist, pth) of an earlier adaptation may be given, all of them or none.
    """
    if (ref is None) == (shares is None):
        raise ValueError("either ref or shares are given")
    if shares is not None:
        if missing := {*by, "grp", "P0_ref", "P0_hist", "pth"} - set(shares.columns):
            raise ValueError(f"shares lack {sorted(missing)}")
        shares = shares.withColumn("dP0", F.try_divide(F.col("P0_hist") - F.col("P0_ref"), F.col("P0_hist")))
    else:
        shares = dry_shares(ref, sim, group, thresh, by, value)
    return adapt_with(sim, shares, group, thresh, by, value, seed=seed), shares


def normalize(df: DataFrame, group: str | Grouper, kind: str = "+", by: Sequence[str] = (), value: str = "value", norm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(anomalies with `norm`, norms by group): x less, or over, the mean of its group; other norms may be given."""
    if norm is None:
        norm = grouped(df, group, by).groupBy(*by, "grp").agg(F.avg(value).alias("norm"))
    own = df.withColumn("grp", Grouper.of(group).key()).join(norm, [*by, "grp"], "left")
    return own.withColumn(value, C.corrected(F.col(value), C.inverse(F.col("norm"), kind), kind)), norm


def standardize(df: DataFrame, by: Sequence[str] = (), value: str = "value", moments: DataFrame | None = None) -> DataFrame:
    """df with `mean`, `std` (of the population) and the standardised value; other moments (by, mean, std) may be given."""
    if moments is None:
        moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    # without sites the moments are one row, and no window sends all rows to one task
    own = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))
    return own.withColumn(value, F.try_divide(F.col(value) - F.col("mean"), F.col("std")))


def unstandardize(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def reordering(ref: DataFrame, sim: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, time, value): the sorted values of sim in the order of ranks of ref, within each group.

    A window sorts each group with its neighbours; the value of a time is that of its own group.
    """
    def placed(df: DataFrame, name: str) -> DataFrame:
        own = grouped(df, group, by)
        return own.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "grp").orderBy(F.col(value).asc_nulls_last(), "time", "main"))).select(*by, "grp", "_k", F.col("time").alias(f"_{name}_time"), F.col(value).alias(f"_{name}"), F.col("main").alias(f"_{name}_main"))

    both = placed(ref, "ref").where("_ref_main").join(placed(sim, "sim"), [*by, "grp", "_k"])
    return both.select(*by, F.col("_ref_time").alias("time"), F.col("_sim").alias(value))


def stack_variables(df: DataFrame, variables: Sequence[str], keep: Sequence[str], dim: str = "multivar", value: str = "value") -> DataFrame:
    """A row for each variable, in order of their names."""
    return df.unpivot(list(keep), sorted(variables), dim, value)


def unstack_variables(df: DataFrame, variables: Sequence[str], keep: Sequence[str], dim: str = "multivar", value: str = "value") -> DataFrame:
    return df.groupBy(*keep).pivot(dim, sorted(variables)).agg(F.first(value))


#: Points of a cloud that meet another block of points in one task.
POINTS = 4096


def escore(tgt: DataFrame, sim: DataFrame, variables: Sequence[str], by: Sequence[str] = (), n: int = 0, scale: bool = False) -> DataFrame:
    """(by, escore): energy distance of two clouds of points; n > 0 takes about n points of each, evenly spaced in time, 0 all.

    Every point meets every other, as the measure is defined, in cells of two blocks of points: a task gives
    one sum of distances, and no pair of points is ever a row. scale: in spreads of tgt; a variable that is
    constant there has none, and leaves the score NULL.
    """
    variables = list(variables)

    def points(df: DataFrame, name: str) -> DataFrame:
        out = df.dropna(subset=variables)
        if scale:
            moments = tgt.dropna(subset=variables).groupBy(*by).agg(*(f(v).alias(f"_{k}_{v}") for v in variables for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
            out = out.join(moments, list(by)) if by else out.crossJoin(F.broadcast(moments))
            out = out.select(*by, "time", *(F.try_divide(F.col(v) - F.col(f"_mean_{v}"), F.col(f"_std_{v}")).alias(v) for v in variables))
        if n:
            w = Window.partitionBy(*by)
            every = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / n))
            out = out.withColumn("_k", F.row_number().over(w.orderBy("time")) - 1).withColumn("_every", every).where(F.col("_k") % F.col("_every") == 0)
        return out.select(*by, F.lit(name).alias("_which"), *(F.col(v).cast("double").alias(v) for v in variables))

    both = points(tgt, "x").unionByName(points(sim, "y"))
    sizes = both.groupBy(*by).agg(F.count_if(F.col("_which") == "x").alias("_n"), F.count_if(F.col("_which") == "y").alias("_m"))
    own = both.join(sizes, list(by)) if by else both.crossJoin(F.broadcast(sizes))
    blocks = F.ceil(F.greatest("_n", "_m") / POINTS).cast("int")
    own = own.withColumn("_b", F.pmod(F.xxhash64(*variables), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.select(*by, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "_which", *variables)
    schema = ", ".join([*(f"`{c}` {tgt.schema[c].dataType.simpleString()}" for c in by), "_xy double, _xx double, _yy double"])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        cloud = lambda which, b: pdf[(pdf["_which"] == which) & (pdf["_b"] == b)][variables].to_numpy(float).T
        cross = [(i, j)] if i == j else [(i, j), (j, i)]
        out = pdf[list(by)].head(1).copy()
        for name, (a, b) in {"_xy": "xy", "_xx": "xx", "_yy": "yy"}.items():
            out[name] = sum(total_distance(cloud(a, k), cloud(b, m)) for k, m in cross)
        return out

    cells = own.groupBy(*by, "_i", "_j").applyInPandas(sums, schema).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("_xy", "_xx", "_yy")))
    out = cells.join(sizes, list(by)) if by else cells.crossJoin(F.broadcast(sizes))
    n_, m_ = F.col("_n"), F.col("_m")
    mean = 2 * F.try_divide(F.col("_xy"), n_ * m_) - F.try_divide(F.col("_xx"), n_ * n_) - F.try_divide(F.col("_yy"), m_ * m_)
    return out.select(*by, F.nanvl(n_ * m_ / (n_ + m_) * mean / 2, F.lit(None).cast("double")).alias("escore"))


def spectral_filter(df: DataFrame, sizes: tuple[int, int], low: float | None = None, high: float | None = None, by: Sequence[str] = (), y: str = "y", x: str = "x", value: str = "value", lam_long: float | None = None, lam_short: float | None = None, delta: float | None = None, mask: Callable[[Column, float, float], Column] = C.cos2_mask) -> DataFrame:
    """Fields of a whole grid less their waves of normalised wavenumbers beyond a soft mask: cosine transform, mask, inverse.

    low and high are wavenumbers, or come from the wavelengths lam_long and lam_short on a grid of spacing
    delta (of the same unit). mask(wavenumber, low, high) gives the share of a wave that stays.
    Each transform is a join with a cosine table of one axis and a sum; y and x count from 0.
    """
    if (low is None) == (lam_long is None) or (high is None) == (lam_short is None):
        raise ValueError("each bound is a wavenumber or a wavelength")
    if lam_long is not None or lam_short is not None:
        if delta is None:
            raise ValueError("wavelengths need the spacing of the grid")
        low, high = (2 * delta / lam if lam is not None else k for lam, k in ((lam_long, low), (lam_short, high)))
    alpha = F.sqrt(F.pow(F.col("_i") / sizes[0], 2) + F.pow(F.col("_j") / sizes[1], 2))
    waves = dct(df, sizes, by, y, x, value).withColumn("wave", F.col("wave") * mask(alpha, low, high))
    return inverse_dct(waves, sizes, by, y, x, value)


def cosines(spark, n: int, space: str, wave: str, name: str) -> DataFrame:
    """The orthonormal cosine table of an axis."""
    k, p = F.col(wave), F.col(space)
    scale = F.when(k == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias(space), F.floor(F.col("id") / n).cast("int").alias(wave)).withColumn(name, scale * F.cos(math.pi * (2 * p + 1) * k / (2 * n)))


def dct(df: DataFrame, sizes: tuple[int, int], by: Sequence[str] = (), y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    """(by, _i, _j, wave): two-dimensional orthonormal cosine transform."""
    spark = df.sparkSession
    half = df.join(cosines(spark, sizes[0], y, "_i", "_c"), y).groupBy(*by, "_i", x).agg(F.sum(F.col(value) * F.col("_c")).alias("_h"))
    return half.join(cosines(spark, sizes[1], x, "_j", "_c"), x).groupBy(*by, "_i", "_j").agg(F.sum(F.col("_h") * F.col("_c")).alias("wave"))


def inverse_dct(waves: DataFrame, sizes: tuple[int, int], by: Sequence[str] = (), y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    spark = waves.sparkSession
    half = waves.join(cosines(spark, sizes[0], y, "_i", "_c"), "_i").groupBy(*by, y, "_j").agg(F.sum(F.col("wave") * F.col("_c")).alias("_h"))
    return half.join(cosines(spark, sizes[1], x, "_j", "_c"), "_j").groupBy(*by, y, x).agg(F.sum(F.col("_h") * F.col("_c")).alias(value))


def grid_spacing(df: DataFrame, coordinate: str, degrees: bool = True) -> DataFrame:
    """(delta): distance of the first two sorted coordinates, in km where they are degrees."""
    first = df.select(coordinate).distinct().orderBy(coordinate).limit(2)
    return first.agg(((F.max(coordinate) - F.min(coordinate)) * (111.2 if degrees else 1.0)).alias("delta"))
