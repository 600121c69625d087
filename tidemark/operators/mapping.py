"""Functions of one's own over the series of a site, or of a site and group.

A Column is an aggregate and stays in the JVM. A function gets pandas frames, one task a site or group, and
gives a frame of the schema it was declared with; `main` tells a group's own rows from its window's.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouping import Grouper, grouped

Function = Callable[..., pd.DataFrame]


def apply(df: DataFrame, function: Column | Function | dict[str, Column], group: str | Grouper = "time", by: Sequence[str] = (), schema: str | None = None, main_only: bool = False) -> DataFrame:
    """An aggregate of each group (several by name), or function(frame) over each.

    main_only leaves the neighbours of a window out of what a function gives back, by its column `main`.
    """
    g = Grouper.of(group)
    own = grouped(df, g, by)
    keys = [*g.sites(by), "grp"]
    if isinstance(function, Column):
        return own.groupBy(*keys).agg(function.alias("out"))
    if isinstance(function, dict):
        return own.groupBy(*keys).agg(*(f.alias(name) for name, f in function.items()))
    if schema is None:
        raise ValueError("a function needs the schema of what it gives")
    run = (lambda pdf: (lambda out: out[out.pop("main").astype(bool)])(function(pdf).copy())) if main_only else function
    return own.groupBy(*keys).applyInPandas(run, schema)


def _together(frames: dict[str, DataFrame]) -> DataFrame:
    """The frames one under the other, told apart by `_which`; columns that one lacks are NULL there."""
    own = [df.withColumn("_which", F.lit(name)) for name, df in frames.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def _apart(function: Function, names: Sequence[str], params: dict) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(**{n: pdf[pdf["_which"] == n].drop(columns="_which").sort_values("time") for n in names}, **params)

    return run


def map_blocks(schema: str, by: Sequence[str] = ()) -> Callable[[Function], Callable[..., DataFrame]]:
    """Makes a function of pandas frames, given by name, one of DataFrames: called once a site with all of its series."""
    def wrap(function: Function) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def call(*, params: dict | None = None, **frames: DataFrame) -> DataFrame:
            return _together(frames).groupBy(*(by or [F.lit("all")])).applyInPandas(_apart(function, list(frames), params or {}), schema)

        return call

    return wrap


def map_groups(schema: str, by: Sequence[str] = ()) -> Callable[[Function], Callable[..., DataFrame]]:
    """As map_blocks(), but called once a site and group; `group` is a Grouper, a name, or comes with `window` and `add_dims`.

    The frames hold `grp` and `main`.
    """
    def wrap(function: Function) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def call(*, params: dict | None = None, group: str | Grouper = "time", window: int | None = None, add_dims: Sequence[str] | None = None, **frames: DataFrame) -> DataFrame:
            more = {k: v for k, v in (("window", window), ("add_dims", add_dims)) if v is not None}
            g, _ = Grouper.from_kwargs(group=group, **more)
            own = grouped(_together(frames), g, [*by, "_which"])
            return own.groupBy(*g.sites(by), "grp").applyInPandas(_apart(function, list(frames), params or {}), schema)

        return call

    return wrap


def takes_group(function: Callable, allowed: Sequence[str] | None = None) -> Callable:
    """A function whose argument `group` may be given as a name with `window` and `add_dims`; it gets a Grouper."""
    @functools.wraps(function)
    def call(*args, **kwargs):
        group, rest = Grouper.from_kwargs(**kwargs)
        return function(*args, group=Grouper.of(group, allowed), **rest)

    return call
