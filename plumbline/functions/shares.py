"""Aggregate building blocks shared by the sensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rows() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column, empty: float) -> Column:
    """100 * part / whole, or `empty` when there is nothing to measure."""
    return F.when(whole == 0, F.lit(float(empty))).otherwise(F.lit(100.0) * part / whole)


def share(predicate: Column, empty: float) -> Column:
    """Percentage of all rows for which the predicate holds."""
    return percent(F.count_if(predicate), rows(), empty)


def share_of_present(column: Column, predicate: Column, empty: float) -> Column:
    """Percentage of the rows with a value for which the predicate holds."""
    return percent(F.count_if(column.isNotNull() & predicate), F.count(column), empty)


def relative_change(value: Column, base: float) -> Column:
    """Unsigned percentage change against a baseline number."""
    if base == 0:
        return F.when(value.isNull() | (value == 0), F.lit(0.0)).otherwise(F.lit(100.0))
    return F.when(value.isNull(), F.lit(100.0)).otherwise(
        F.abs(F.lit(100.0) * (value - F.lit(float(base))) / F.lit(float(base)))
    )


def at_timestamp(as_of: str | None) -> Column:
    """The moment a time sensor measures from: a fixed one, or now."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def seconds_since(moment: Column, as_of: str | None) -> Column:
    """Whole seconds between a timestamp and the moment of measurement."""
    return F.unix_seconds(at_timestamp(as_of)) - F.unix_seconds(moment.cast("timestamp"))
