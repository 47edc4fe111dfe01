"""Distinct counts over any stretch of days, from one stored sketch per day and column.

A day's sketch (HyperLogLog of the DataSketches library, built into Spark) is a few
kilobytes, whatever the day's rows. The distinct values of a month, or the change of
one week against the week before, are unions of stored rows: the table is read once a
day, never again (`plumbline.sources.results.store_days` keeps the rows). Estimates
have a relative standard error of `standard_error(lg_k)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import named

LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def day_sketches(df: DataFrame, table: str, day: Column, columns: list[str], *, lg_k: int = LG_K) -> DataFrame:
    """One row per day and column, in one pass. NULLs are counted apart; rows without a day have the day NULL.

    Values are told apart by their 64-bit hash, so every type that has one will do.
    """
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col("_rows") - F.col(f"_present{i}")).alias("nulls"),
            F.col(f"_sketch{i}").alias("sketch"),
        )
        for i, c in enumerate(columns)
    ]
    hashed = [F.when(named(c).isNotNull(), F.xxhash64(named(c))).alias(f"_value{i}") for i, c in enumerate(columns)]
    aggregates = [
        a
        for i in range(len(columns))
        for a in (
            F.count(f"_value{i}").alias(f"_present{i}"),
            F.hll_sketch_agg(f"_value{i}", lg_k).alias(f"_sketch{i}"),
        )
    ]
    wide = df.select(day.cast("date").alias("day"), *hashed).groupBy("day").agg(
        F.count(F.lit(1)).alias("_rows"), *aggregates
    )
    return wide.select(
        F.lit(table).alias("table_name"), F.col("_rows").alias("rows"), "day", F.inline(F.array(*parts))
    ).select("table_name", "column_name", "rows", "nulls", "sketch", "day")


def distinct_over(sketches: DataFrame, stretch: Column, *, lg_k: int = LG_K) -> DataFrame:
    """stretch, rows, nulls, distinct_estimate and its standard error for every table, column and stretch of days."""
    return (
        sketches.groupBy("table_name", "column_name", stretch.alias("stretch"))
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("nulls").alias("nulls"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
        )
        .withColumn("standard_error", F.col("distinct_estimate") * F.lit(standard_error(lg_k)))
    )


def change_over(counted: DataFrame, step: Column) -> DataFrame:
    """The change of each stretch's estimate against the stretch before it (`step` gives its name), in percent.

    NULL where the earlier stretch is not stored or had no value. A window within a
    table's column holds one row per stretch.
    """
    key = ["table_name", "column_name"]
    before = Window.partitionBy(*key).orderBy("stretch")
    earlier = F.when(F.lag("stretch").over(before).eqNullSafe(step), F.lag("distinct_estimate").over(before))
    return counted.withColumn("earlier_estimate", earlier).withColumn(
        "change_percent",
        (F.col("distinct_estimate") - F.col("earlier_estimate")) / F.nullif(F.col("earlier_estimate"), F.lit(0)) * 100,
    )
