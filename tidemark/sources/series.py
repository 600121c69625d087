"""Series from files and to files, with their roles, units and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.functions import units as U

FORMATS = ("parquet", "orc", "csv", "json")


@dataclass(frozen=True)
class SeriesFrame:
    """A long frame: site columns `by`, a time column, value columns with their units."""

    df: DataFrame
    by: tuple[str, ...] = ()
    time: str = "time"
    values: tuple[str, ...] = ("value",)
    units: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if missing := {*self.by, self.time, *self.values} - set(self.df.columns):
            raise ValueError(f"the frame has no columns {sorted(missing)}")

    def converted(self, value: str, unit: str) -> SeriesFrame:
        df = self.df.withColumn(value, U.convert(F.col(value), self.units[value], unit))
        return replace(self, df=df, units={**self.units, value: unit})


def nulled(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating columns, which become doubles."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in floats})


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | StructType | None = None, by: Sequence[str] = (), time: str = "time", values: Sequence[str] = ("value",), units: dict[str, str] | None = None, **options: str) -> SeriesFrame:
    """Only the columns named are read; text formats need a schema, so that no pass goes into guessing it."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path).select(*by, time, *values)
    return SeriesFrame(nulled(df), tuple(by), time, tuple(values), units or {})


def write(series: SeriesFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    series.df.write.mode("overwrite").format(format).partitionBy(*partition_by).save(path)


def check(ref: SeriesFrame, hist: SeriesFrame, same_times: bool = False, same_size: bool = False) -> None:
    """What adjustments ask for: the same variables, units that convert, and on request equal times or numbers of times."""
    if ref.values != hist.values or ref.by != hist.by:
        raise ValueError("ref and hist have different variables or sites")
    for v in ref.values:
        U.harmonised([ref.units.get(v), hist.units.get(v)])
    if same_times:
        a, b = (s.df.select(*s.by, F.col(s.time).alias("_t")).distinct() for s in (ref, hist))
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            raise ValueError("ref and hist have different times")
    if same_size and ref.df.select(ref.time).distinct().count() != hist.df.select(hist.time).distinct().count():
        raise ValueError("ref and hist have different numbers of times")
