"""Trained models on streams: methods whose plan is a join with the model's table need no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.adjust import Model

#: Methods that look at one row at a time; the others rank or detrend whole series.
STATELESS = ("eqm", "scaling", "loci")


def adjust_stream(model: Model, stream: DataFrame, **options) -> DataFrame:
    """The stream with `scen`, in append mode as its rows come."""
    if model.method not in STATELESS:
        raise ValueError(f"{model.method!r} needs whole series; on a stream there are {STATELESS}")
    if model.params.get("adapt_freq_thresh") is not None:
        raise ValueError("frequency adaptation needs whole series")
    return model.adjust(stream, **options)
