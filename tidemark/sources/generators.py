"""Series to try things out on; every number is a hash of its place, so that a frame is the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import provenance


def days(spark: SparkSession, n: int, start: str = "2000-01-01", sites: int = 1) -> DataFrame:
    """(site, time): n days of some sites."""
    own = spark.range(n * sites)
    return own.select(F.floor(F.col("id") / n).cast("int").alias("site"), F.date_add(F.lit(start).cast("date"), (F.col("id") % n).cast("int")).alias("time"))


def normal(*keys: str, seed: int = 0):
    """A standard normal number that depends on the keys alone."""
    u, v = C.uniform(*keys, seed=seed), C.uniform(*keys, seed=seed + 1)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def temperature(spark: SparkSession, n: int = 3650, mean: float = 280.0, cycle: float = 10.0, spread: float = 3.0, trend: float = 0.0, sites: int = 1, start: str = "2000-01-01", seed: int = 0) -> DataFrame:
    """Daily values in K: an annual cycle, a trend a year and noise."""
    own = days(spark, n, start, sites)
    year = F.datediff("time", F.lit(start)) / 365.25
    x = mean - cycle * F.cos(2 * math.pi * F.dayofyear("time") / 365.25) + trend * year + spread * normal("site", "time", seed=seed)
    return provenance.attach(own.withColumn("value", x), "value", units="K", standard_name="air_temperature")


def precipitation(spark: SparkSession, n: int = 3650, wet: float = 0.4, mean: float = 5.0, sites: int = 1, start: str = "2000-01-01", seed: int = 0) -> DataFrame:
    """Daily values in mm/d: a share of wet days with exponential amounts."""
    own = days(spark, n, start, sites)
    x = F.when(C.uniform("site", "time", seed=seed) < wet, -mean * F.ln(1 - C.uniform("site", "time", seed=seed + 1))).otherwise(0.0)
    return provenance.attach(own.withColumn("value", x), "value", units="mm/d", standard_name="precipitation_flux")
