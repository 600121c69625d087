"""What was done to a column, and options: metadata goes with the column, expressions drop it, so operators attach it again."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_options: ContextVar[dict] = ContextVar("tidemark_options", default={"extra_output": False, "as_dataset": False})


@contextlib.contextmanager
def options(**new: bool) -> Iterator[None]:
    """extra_output: adjustments keep their working columns; as_dataset: results come as frames of several variables."""
    if unknown := set(new) - set(_options.get()):
        raise ValueError(f"unknown options {sorted(unknown)}")
    token = _options.set(_options.get() | new)
    try:
        yield
    finally:
        _options.reset(token)


def option(name: str) -> bool:
    return _options.get()[name]


def call(name: str, **arguments: object) -> str:
    return f"{name}({', '.join(f'{k}={v!r}' for k, v in arguments.items())})"


def attributes(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


def attach(df: DataFrame, column: str, **new: object) -> DataFrame:
    return df.withColumn(column, F.col(column).alias(column, metadata={**attributes(df, column), **new}))


def record(df: DataFrame, column: str, what: str, when: datetime | None = None) -> DataFrame:
    """Puts a line before the column's history."""
    stamp = (when or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S")
    old = attributes(df, column).get("history", "")
    return attach(df, column, history=f"[{stamp}] {what}" + (f"\n{old}" if old else ""))


def copied(df: DataFrame, source: DataFrame) -> DataFrame:
    """df with the metadata that columns of the same names have in source."""
    for f in source.schema.fields:
        if f.metadata and f.name in df.columns:
            df = attach(df, f.name, **f.metadata)
    return df
