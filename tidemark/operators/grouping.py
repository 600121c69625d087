"""Groups of times: keys, moving windows over groups, cyclic neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.kernels import bends
from tidemark.operators.periods import rescale_days


@dataclass(frozen=True)
class Grouper:
    """A way to group times: "time" is the whole series; `window` widens each group by neighbouring steps.

    add_dims: site columns whose series count together in a group, as members of an ensemble.
    """

    group: str = "time"
    window: int = 1
    add_dims: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "add_dims", tuple(self.add_dims))
        if self.group not in C.GROUPS:
            raise ValueError(f"group {self.group!r} isn't one of {C.GROUPS}")
        if self.window < 1 or self.group == "time" and self.window > 1:
            raise ValueError("a window needs groups within the year, and at least one step")

    @classmethod
    def of(cls, group: str | Grouper, allowed: Sequence[str] | None = None) -> Grouper:
        out = group if isinstance(group, Grouper) else cls(group)
        if allowed is not None and out.group not in allowed:
            raise ValueError(f"group {out.group!r} isn't one of {list(allowed)}")
        return out

    @classmethod
    def from_kwargs(cls, **kwargs) -> tuple[Grouper, dict]:
        """A Grouper from `group`, `window` and `add_dims`, and the other arguments."""
        rest = dict(kwargs)
        own = {k: rest.pop(k) for k in ("group", "window", "add_dims") if k in rest}
        group = own.pop("group", "time")
        if isinstance(group, cls):
            if own:
                raise ValueError("a Grouper holds window and add_dims itself")
            return group, rest
        return cls(group, **own), rest

    def sites(self, by: Sequence[str]) -> list[str]:
        """The site columns that tell groups apart."""
        if missing := set(self.add_dims) - set(by):
            raise ValueError(f"{sorted(missing)} are no site columns")
        return [b for b in by if b not in self.add_dims]

    def key(self, time: Column | str = "time") -> Column:
        return C.group_key(F.col(time) if isinstance(time, str) else time, self.group)

    def index(self, time: Column | str = "time") -> Column:
        return C.group_index(F.col(time) if isinstance(time, str) else time, self.group)

    @property
    def labels(self) -> list[int]:
        first = 0 if self.group == "time.season" else 1
        return list(range(first, first + C.group_count(self.group)))


def grouped(df: DataFrame, group: str | Grouper, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """df with `grp` and `main`: a row for each group that it counts in, `main` where that is its own.

    A window of w steps puts the value at step s into the groups of the steps s - (w - 1 - w // 2) to
    s + w // 2, as far as the record goes. The neighbours' keys come from one window frame, without a join.
    """
    g = Grouper.of(group)
    if g.window == 1:
        return df.withColumn("grp", g.key(time)).withColumn("main", F.lit(True))
    before, after = g.window - 1 - g.window // 2, g.window // 2
    frame = Window.partitionBy(*by).orderBy(time)
    around = F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_step").alias("step"))).over(frame.rowsBetween(-before, after))
    out = df.withColumn("_key", g.key(time)).withColumn("_step", F.row_number().over(frame)).withColumn("_near", around)
    out = out.withColumn("_one", F.explode("_near"))
    return out.withColumn("grp", F.col("_one.key")).withColumn("main", F.col("_one.step") == F.col("_step")).drop("_key", "_step", "_near", "_one")


def cyclic(df: DataFrame, group: str | Grouper) -> DataFrame:
    """A table of groups with its last and first group again at either end, one step out."""
    labels = Grouper.of(group).labels
    first, last = labels[0], labels[-1]
    places = F.array_compact(F.array(F.col("grp"), F.when(F.col("grp") == last, first - 1), F.when(F.col("grp") == first, last + 1)))
    return df.withColumn("grp", F.explode(places))


def broadcast_groups(df: DataFrame, table: DataFrame, group: str | Grouper, value: str, by: Sequence[str] = (), time: str = "time", interp: str = "nearest", out: str = "factor") -> DataFrame:
    """df with `out`: the value of its group, or interpolated between groups over the cyclic group axis.

    The table is one row a group and site; it is left to the optimiser to broadcast it by its size.
    """
    g = Grouper.of(group)
    if interp == "nearest" or g.group == "time":
        return df.withColumn("grp", g.key(time)).join(table.select(*by, "grp", F.col(value).alias(out)), [*by, "grp"], "left").drop("grp")
    if interp == "cubic":
        knots = cyclic(table.select(*by, "grp", F.col(value).cast("double").alias("_v")), g).where("_v IS NOT NULL").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("grp").cast("double").alias("x"), F.col("_v").alias("y")))).alias("_k"))
        knots = with_bends(knots.select(*by, F.col("_k.x").alias("_xq"), F.col("_k.y").alias("_yq")))
        own = df.withColumn("_index", g.index(time))
        own = own.join(knots, list(by), "left") if by else own.crossJoin(F.broadcast(knots))
        return own.withColumn(out, C.cubic(F.col("_index"), F.col("_xq")["x"], F.col("_xq")["y"], F.col("_xq")["m"])).drop("_index", "_xq", "_yq")
    if interp != "linear":
        raise ValueError(f"interp is nearest, linear or cubic, not {interp!r}")
    padded = cyclic(table.select(*by, "grp", F.col(value).alias("_v")), g)
    low = F.floor("_index").cast("int")
    own = df.withColumn("_index", g.index(time)).withColumn("_low", low)
    own = own.join(padded.select(*by, F.col("grp").alias("_low"), F.col("_v").alias("_v0")), [*by, "_low"], "left")
    own = own.withColumn("_high", F.col("_low") + 1).join(padded.select(*by, F.col("grp").alias("_high"), F.col("_v").alias("_v1")), [*by, "_high"], "left")
    part = F.col("_index") - F.col("_low")
    value_at = F.when(part == 0, F.col("_v0")).otherwise(F.col("_v0") + part * (F.col("_v1") - F.col("_v0")))
    return own.withColumn(out, value_at).drop("_index", "_low", "_high", "_v0", "_v1")


def with_bends(knots: DataFrame) -> DataFrame:
    """The small table of knots with `_xq` as a struct of distinct knots, their values and the spline's second derivatives."""

    @F.pandas_udf("x array<double>, y array<double>, m array<double>")
    def bend(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys):
            x, first = np.unique(np.asarray(x, float), return_index=True)
            y = np.asarray(y, float)[first]
            rows.append((x, y, bends(x, y)))
        return pd.DataFrame(rows, columns=["x", "y", "m"])

    return knots.withColumn("_xq", bend("_xq", "_yq"))


def longest_days(*tables: DataFrame, by: Sequence[str] = (), doy: str = "grp", value: str = "value") -> list[DataFrame]:
    """Tables by day of the year on the calendar of the longest of them: shorter ones are stretched."""
    most = [t.agg(F.max(doy)).first()[0] or 0 for t in tables]
    return [t if n == max(most) else rescale_days(t, max(most), by, doy, value, n) for t, n in zip(tables, most)]


def time_blocks(df: DataFrame, group: str, window: int = 1, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """df with `block`: the whole series, days of the year, or the 73 blocks of five days ("5D"), each with its window.

    The window counts days for days of the year and blocks for "5D", and is odd there. Rows of February 29
    go with block 73's day numbering of 365-day years: the day of the year is cut off at 365.
    """
    if group == "time":
        return df.withColumn("block", F.lit(1)).withColumn("main", F.lit(True))
    if group == "time.dayofyear":
        return grouped(df, Grouper(group, window), by, time).withColumnRenamed("grp", "block")
    if group != "5D":
        raise ValueError("blocks are time, time.dayofyear or 5D")
    if window % 2 == 0:
        raise ValueError("the window of 5D blocks is odd")
    own = F.floor((F.least(F.dayofyear(time), F.lit(365)) - 1) / 5).cast("int")
    half = window // 2
    out = df.withColumn("_offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("block", F.pmod(own + F.col("_offset"), F.lit(73)) + 1)
    return out.withColumn("main", F.col("_offset") == 0).drop("_offset")
