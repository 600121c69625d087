"""The queries of the driver's contract: name, Spark plan, and SQL that gives the same rows.

Series come from the driver's tables: `ref` and `hist` are daily sums of prices of lines of status O and F
before 1999, `sim` those of F from 1999 on, by return flag as the site. Sums are taken over whole cents, so
that they don't depend on the order of rows; results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """daily AS (SELECT l_returnflag AS site, l_linestatus AS st, CAST(l_shipdate AS DATE) AS time,
    CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100000 AS value,
    CAST(SUM(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 AS qty,
    CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 AS disc
    FROM lineitem GROUP BY 1, 2, 3),
ref AS (SELECT site, time, value, qty, disc FROM daily WHERE st = 'O' AND time < DATE '1999-01-01'),
hist AS (SELECT site, time, value, qty, disc FROM daily WHERE st = 'F' AND time < DATE '1999-01-01'),
sim AS (SELECT site, time, value, qty, disc FROM daily WHERE st = 'F' AND time >= DATE '1999-01-01')"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan; its SQL continues the common tables of BASE."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {BASE}{',' if sql.lstrip()[:4].upper() == 'WITH' else ''} {sql.lstrip()[4:] if sql.lstrip()[:4].upper() == 'WITH' else sql}"
        return f

    return add


class Series:
    """The series of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        self.daily = lines.groupBy(F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("st"), F.col("l_shipdate").cast("date").alias("time")).agg((cents("l_extendedprice") / 100000).alias("value"), (cents("l_quantity") / 100).alias("qty"), (cents("l_discount") / 100).alias("disc"))
        before = F.col("time") < F.lit("1999-01-01").cast("date")
        own = ["site", "time", "value", "qty", "disc"]
        self.ref = self.daily.where((F.col("st") == "O") & before).select(own)
        self.hist = self.daily.where((F.col("st") == "F") & before).select(own)
        self.sim = self.daily.where((F.col("st") == "F") & ~before).select(own)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Exact ties are shifted off the edge, as engines differ there; -0.0 is made 0.0."""
    return df.withColumns({c: F.round(F.col(c) + 3.7e-10, digits) + 0.0 for c in columns})
