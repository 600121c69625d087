"""Kinds of arguments, from the annotations of functions."""

from __future__ import annotations

import enum
import inspect
import types
import typing
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from tidemark.operators.grouping import Grouper


class Kind(enum.Enum):
    FRAME = "a DataFrame"
    OPTIONAL_FRAME = "a DataFrame, or none"
    COLUMN = "a column"
    NUMBER = "a number"
    STRING = "a text"
    BOOL = "yes or no"
    SEQUENCE = "several values"
    DICT = "values by name"
    GROUP = "a grouping of times"
    FUNCTION = "a function"
    KEYWORDS = "further arguments by name"
    OTHER = "something else"


def kind_of(annotation: object) -> Kind:
    parts = typing.get_args(annotation) if isinstance(annotation, types.UnionType) or typing.get_origin(annotation) is typing.Union else (annotation,)
    known = [p for p in parts if p is not type(None)]
    bare = {typing.get_origin(p) or p for p in known}
    if DataFrame in bare:
        return Kind.OPTIONAL_FRAME if len(known) < len(parts) else Kind.FRAME
    for kind, wanted in ((Kind.GROUP, {Grouper}), (Kind.COLUMN, {Column}), (Kind.BOOL, {bool}), (Kind.DICT, {dict}), (Kind.FUNCTION, {Callable}), (Kind.SEQUENCE, {Sequence, list, tuple}), (Kind.NUMBER, {int, float}), (Kind.STRING, {str})):
        if bare & wanted:
            return kind
    return Kind.OTHER


def kinds(function: Callable) -> dict[str, Kind]:
    """The kind of each argument of a function."""
    hints = typing.get_type_hints(function)
    return {n: Kind.KEYWORDS if p.kind is p.VAR_KEYWORD else kind_of(hints.get(n, object)) for n, p in inspect.signature(function).parameters.items()}
