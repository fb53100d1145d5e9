"""Values that are computed once per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


def built_once(build: Callable[..., T]) -> Callable[..., T]:
    """Keep the Columns a function builds, per arguments, while the application runs.

    Putting a large expression together takes thousands of calls into the JVM, more than
    it takes to run it on a small table; a Column can be used in any number of plans.
    """
    kept: dict[tuple, T] = {}

    @wraps(build)
    def cached(*args) -> T:
        app = SparkContext._active_spark_context.applicationId
        if kept and next(iter(kept))[0] != app:
            kept.clear()  # Columns of a session that has ended
        key = (app, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As `withColumns`, for costly values that later steps refer to several times.

    The optimizer copies a projected expression into the filters and projections that use
    it, and so multiplies both its size and its cost. It does not copy what comes out of
    a generator; `inline` over a one-element array is one, and works in place, row by row.
    """
    value = F.struct(*(c.alias(name) for name, c in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(value)))
