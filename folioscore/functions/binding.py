"""Names for values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value made once. The optimizer merges projections and would
    write a column's expression out wherever it is used, inside lambdas even for every item."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with more columns that are made once a row. A projection isn't enough: those with
    Python functions in them are written out in the next one, as often as they are used there."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))
