"""Referential integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import named, quoted
from plumbline.functions.shares import percent


def key_lookup(
    df: DataFrame, column: str | Column, reference: DataFrame, reference_column: str, by: list[str] | None = None
) -> DataFrame:
    """How many rows carry a key, and how many of those keys the reference holds.

    Rows are counted per key before the join, so both join sides have one row per
    key: a key that fills a third of the table is a single row here.
    """
    by = by or []
    key = named(column) if isinstance(column, str) else column
    counted = (
        df.select(*by, key.alias("lookup_key"))
        .filter(F.col("lookup_key").isNotNull())
        .groupBy(*by, "lookup_key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    known = (
        reference.select(named(reference_column).alias("lookup_key"))
        .filter(F.col("lookup_key").isNotNull())
        .distinct()
        .withColumn("known", F.lit(True))
    )
    found = F.when(F.col("known"), F.col("copies")).otherwise(0)
    return (
        counted.join(known, "lookup_key", "left")
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("present"),
            F.coalesce(F.sum(found), F.lit(0)).alias("found"),
        )
    )


def missing_count() -> Column:
    return F.col("present") - F.col("found")


def found_percent() -> Column:
    return percent(F.col("found"), F.col("present"), 100)


def orphan_keys(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """The keys the reference lacks, each with the number of rows that carry it."""
    counted = df.filter(named(column).isNotNull()).groupBy(named(column)).agg(F.count(F.lit(1)).alias("rows"))
    known = reference.select(named(reference_column).alias(column)).distinct()
    return counted.join(known, counted[quoted(column)] == known[quoted(column)], "left_anti")
