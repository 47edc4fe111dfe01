"""Duplicate rows and keys, counted exactly.

Whole rows are wide, so they are first compared by a 64-bit hash: only a hash and
a counter per distinct row are shuffled. Rows whose hash occurs more than once -
true duplicates, or the rare hash collision - are then compared column by
column. Equal rows collapse into a counter before each shuffle, so one row
repeated over a third of the table is no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import named


def duplicate_rows(
    df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, *, broadcast_up_to: int = 2_000_000
) -> DataFrame:
    """Per partition: `rows`, and `duplicates` = rows beyond the first of each distinct row.

    Runs one job to learn how many hashes repeat. None: done. At most
    `broadcast_up_to`: they are broadcast and only the suspects move. More: all rows
    are grouped, equal ones collapsed into counters before they move.
    """
    by = by or []
    columns = [c for c in (columns or df.columns) if c not in by]
    # The flags keep (NULL, 'a') and ('a', NULL) apart: the hash itself skips NULLs.
    places = [f"c{i} of the row" for i in range(len(columns))]  # names of its own: any name may be in `by`
    values = [*map(named, by), *map(named, columns)]
    flags = [value.isNull() for value in values]
    compared = [named(c).alias(place) for c, place in zip(columns, places)]
    hashed = df.select(*map(named, by), *compared, F.xxhash64(*values, *flags).alias("row_hash"))
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("duplicates")
    )
    repeated = (
        hashed.groupBy("row_hash")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("row_hash")
    )
    n = repeated.count()
    if n == 0:
        return totals
    suspects = hashed.join(F.broadcast(repeated), "row_hash", "left_semi") if n <= broadcast_up_to else hashed
    extra = (
        suspects.groupBy(*map(named, [*by, *places]))
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy(*by)
        .agg(F.lit(0).cast("bigint").alias("rows"), F.sum("extra").alias("duplicates"))
    )
    return (
        totals.unionByName(extra)
        .groupBy(*by)
        .agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    )


def key_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct key with the number of rows that carry it."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def share_of_unique_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, rows whose key occurs once, and their ratio; keys with a NULL part are left out."""
    present = df.dropna(subset=columns)
    return (
        key_groups(present, columns)
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.count_if(F.col("copies") == 1).alias("unique_rows"),
        )
        .withColumn(
            "unique_share",
            F.when(F.col("rows") == 0, F.lit(1.0)).otherwise(F.col("unique_rows") / F.col("rows")),
        )
    )
