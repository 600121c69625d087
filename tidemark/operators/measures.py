"""Measures: how a property or a series of sim differs from that of ref. Rows meet by an inner join on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import properties
from tidemark.operators.grouping import Grouper, grouped


def paired(sim: DataFrame, ref: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    return sim.select(*on, F.col(value).alias("sim")).join(ref.select(*on, F.col(value).alias("ref")), list(on))


def pointwise(name: str) -> Column:
    sim, ref = F.col("sim"), F.col("ref")
    return {"bias": lambda: sim - ref, "relative_bias": lambda: F.try_divide(sim - ref, ref), "circular_bias": lambda: C.circular_difference(sim, ref), "ratio": lambda: F.try_divide(sim, ref)}[name]()


def compare(name: str, sim: DataFrame, ref: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """bias, relative_bias, circular_bias or ratio of two tables of a property."""
    return paired(sim, ref, on, value).withColumn(name, pointwise(name)).drop("sim", "ref")


def of_property(name: str, sim: DataFrame, ref: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The property's default measure."""
    return compare(properties.MEASURES[name], sim, ref, on, value)


def rmse(sim: DataFrame, ref: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    own = grouped(paired(sim, ref, [*by, "time"], value), group, by)
    return own.groupBy(*by, "grp").agg(F.sqrt(F.avg(F.pow(F.col("sim") - F.col("ref"), 2))).alias("rmse"))


def mae(sim: DataFrame, ref: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    own = grouped(paired(sim, ref, [*by, "time"], value), group, by)
    return own.groupBy(*by, "grp").agg(F.avg(F.abs(F.col("sim") - F.col("ref"))).alias("mae"))


def annual_cycle_correlation(sim: DataFrame, ref: DataFrame, window: int = 15, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    cycle = lambda df: properties.mean(df, Grouper("time.dayofyear", window), by, value)
    return paired(cycle(sim), cycle(ref), [*by, "grp"], "mean").groupBy(*by).agg(F.corr("sim", "ref").alias("correlation"))


def scorr(sim: DataFrame, ref: DataFrame, site: str = "site", value: str = "value") -> DataFrame:
    """Sum of the differences of all rank correlations of two sites."""
    both = paired(properties.pairwise_spearman(sim, site, value), properties.pairwise_spearman(ref, site, value), ["a", "b"], "corr")
    return both.agg(F.sum(F.col("sim") - F.col("ref")).alias("scorr"))


def taylor_diagram(sim: DataFrame, ref: DataFrame, by: Sequence[str] = (), value: str = "value", normalize: bool = False) -> DataFrame:
    """(by, taylor_param, out): ref_std, sim_std and corr. Normalised ones fail where ref_std is 0."""
    own = paired(sim, ref, [*by, "time"], value).groupBy(*by).agg(F.stddev_pop("ref").alias("ref_std"), F.stddev_pop("sim").alias("sim_std"), F.corr("sim", "ref").alias("corr"))
    if normalize:
        zero = F.raise_error(F.lit("ref_std is 0: no normalisation is possible")).cast("double")
        own = own.withColumn("sim_std", F.when(F.col("ref_std") == 0, zero).otherwise(F.col("sim_std") / F.col("ref_std"))).withColumn("ref_std", F.lit(1.0))
    return own.unpivot(list(by), ["ref_std", "sim_std", "corr"], "taylor_param", "out")
