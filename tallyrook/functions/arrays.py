"""Arrays of structs as rows, and values that are used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(frame: DataFrame, items: Column | str, *keep: Column | str, place: str | None = None) -> DataFrame:
    """One row for each struct of an array: the columns kept, place (from 0) if it has a name, and the struct's fields; none for an array that
    is empty or null.

    A plain explode makes Spark infer a filter on the array's size, which is pushed down to the scan and computes the array, and all
    that it follows from, a second time. The outer form infers none, and the filter on the place stays above it.
    """
    kept = frame.select(*keep)
    rows = frame.select(*keep, F.posexplode_outer(items).alias("_place", "_item")).where(F.col("_place").isNotNull())
    return rows.select(*kept.columns, *([F.col("_place").alias(place)] if place else []), "_item.*")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written and computed once; inside a lambda Spark computes every mention anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
