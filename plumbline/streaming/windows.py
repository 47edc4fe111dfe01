"""Sensors over the windows of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.joins import lookup_join
from plumbline.operators.measure import Probe
from plumbline.operators.measure import _scan_column as scan_column
from plumbline.operators.sensors import Target


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with its event time as a zoned timestamp and a watermark `delay` behind it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _window(time: str, width: str, slide: str | None) -> Column:
    return F.window(time, width, slide) if slide else F.window(time, width)


def window_sensors(
    stream: DataFrame,
    time: str,
    probes: list[Probe],
    *,
    width: str,
    slide: str | None = None,
    delay: str = "1 hour",
    by: list[str] | None = None,
) -> DataFrame:
    """Readings per window (tumbling, or sliding with `slide`): window bounds, by, probe_id, sensor_value.

    All sensors of a window share one stateful aggregate with a few counters per
    window and group. Distinct counts are sketches here: an exact one would keep
    every value of an open window as state.
    """
    by = by or []
    aggregates, values = [], []
    for i, p in enumerate(probes):
        family = p.definition.family
        if family == "scan":
            column = scan_column(stream, p)
        elif p.sensor == "distinct_count":
            column = F.approx_count_distinct(p.column).cast("double")
        elif p.sensor == "distinct_percent":
            present = F.count(p.column)
            column = F.when(present == 0, F.lit(0.0)).otherwise(100.0 * F.approx_count_distinct(p.column) / present)
        elif family == "percentile":
            number = Target(p.column, stream.schema[p.column].dataType.simpleString()).number.cast("double")
            column = p.definition.build(F.percentile_approx(number, float(p.settings["percentile"])), p.settings)
        else:
            raise ValueError(f"{p.sensor} cannot be measured on a stream")
        aggregates.append(column.cast("double").alias(f"m{i}"))
        values.append(F.struct(F.lit(p.probe_id).alias("probe_id"), F.col(f"m{i}").alias("sensor_value")))
    wide = timed(stream, time, delay).groupBy(_window(time, width, slide), *by).agg(*aggregates)
    return wide.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, F.inline(F.array(*values))
    )


def orphan_windows(
    stream: DataFrame,
    time: str,
    column: str,
    reference: DataFrame,
    reference_column: str,
    *,
    width: str,
    delay: str = "1 hour",
) -> DataFrame:
    """Per window: rows with a key, and how many of those keys the reference table lacks."""
    known = reference.select(F.col(reference_column).alias(column)).dropna().distinct().withColumn("known", F.lit(True))
    rows = timed(stream, time, delay)
    looked_up = lookup_join(rows, known, [column], "left")
    missing = F.col(column).isNotNull() & F.col("known").isNull()
    return (
        looked_up.groupBy(F.window(time, width))
        .agg(F.count(column).alias("present"), F.count_if(missing).alias("orphans"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "present", "orphans")
    )


def unique_windows(
    stream: DataFrame, time: str, keys: list[str], *, width: str, delay: str = "1 hour"
) -> DataFrame:
    """Per window the rows that are the first with their key; against the plain row count it tells the duplicates.

    A key is remembered for as long as the watermark allows repeats, no longer.
    """
    first = timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)
    return (
        first.groupBy(F.window(time, width))
        .agg(F.count(F.lit(1)).alias("unique_rows"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "unique_rows")
    )
