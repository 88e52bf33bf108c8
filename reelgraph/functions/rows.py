"""Keeping costly expressions from being computed more than once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside array functions, whose
    bodies would otherwise compute it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows meeting a condition on a costly computed column.

    A filter is pushed below the projection that computes the column, which
    then runs for the filter and again for the output. A generator giving one
    or no row stays above it.
    """
    one = F.explode(F.when(condition, F.array(F.lit(0)))).alias("_kept_row")
    return df.select("*", one).drop("_kept_row")
