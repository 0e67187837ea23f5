"""Small helpers to write expressions with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def none_of(example: Column) -> Column:
    """An empty array of example's type."""
    return F.filter(F.array(example), lambda x: F.lit(False))
