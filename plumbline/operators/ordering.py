"""Are values in order? Without sorting a table in one task.

Rows are range-partitioned and sorted by the order columns; each task counts its
own neighbouring pairs in Arrow batches and reports its first and last value.
The pairs that straddle two tasks are then judged from those edges: one row per
task, however large the table. A group that holds a third of the rows spans many
tasks like any other stretch of the sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.names import named


def _in_order(before: Column, after: Column, descending: bool, strictly: bool) -> Column:
    if descending:
        return before > after if strictly else before >= after
    return before < after if strictly else before <= after


def _pair_counter(descending: bool, strictly: bool):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = ordered = 0
        first = last = None
        for batch in batches:
            if batch.empty:
                continue
            if last is not None:
                batch = pd.concat([last, batch], ignore_index=True)
            else:
                first = batch.iloc[[0]]
            value, group = batch["v"], batch["grp"]
            same = (group == group.shift())[1:].to_numpy()
            a, b = value[:-1].to_numpy(), value[1:].to_numpy()
            if descending:
                a, b = b, a
            good = a < b if strictly else a <= b
            pairs += int(same.sum())
            ordered += int((same & good).sum())
            last = batch.iloc[[-1]]
        if last is not None:
            yield pd.DataFrame(
                {
                    "task": [TaskContext.get().partitionId()],
                    "pairs": [pairs],
                    "ordered": [ordered],
                    "first_grp": first["grp"].tolist(),
                    "first_v": first["v"].tolist(),
                    "last_grp": last["grp"].tolist(),
                    "last_v": last["v"].tolist(),
                }
            )

    return count


def ordered_pairs(
    df: DataFrame,
    column: str,
    order_by: list[str],
    *,
    by: list[str] | None = None,
    descending: bool = False,
    strictly: bool = False,
) -> DataFrame:
    """One row: neighbouring `pairs` and how many of them are `ordered`.

    Neighbours are consecutive rows with a value, within a `by` group, in the order
    of `order_by`. Rows that tie there are taken in the order of their values.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    keys = [f"o{i}" for i in range(len(order_by))]
    rows = df.filter(named(column).isNotNull()).select(
        group.alias("grp"), *[named(c).alias(k) for c, k in zip(order_by, keys)], named(column).alias("v")
    )
    tie = F.desc("v") if descending else F.asc("v")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, "grp", *keys, tie).sortWithinPartitions("grp", *keys, tie)
    kind = rows.schema["v"].dataType.simpleString()
    tally = placed.select("grp", "v").mapInPandas(
        _pair_counter(descending, strictly),
        f"task int, pairs bigint, ordered bigint, first_grp string, first_v {kind}, last_grp string, last_v {kind}",
    )
    # One row per task: this window is as small as the number of partitions.
    before = Window.orderBy("task")
    straddles = F.coalesce(F.lag("last_grp").over(before) == F.col("first_grp"), F.lit(False))
    good = _in_order(F.lag("last_v").over(before), F.col("first_v"), descending, strictly)
    edged = tally.withColumn("edge", straddles).withColumn("good_edge", straddles & F.coalesce(good, F.lit(False)))
    return edged.agg(
        (F.coalesce(F.sum("pairs"), F.lit(0)) + F.count_if("edge")).alias("pairs"),
        (F.coalesce(F.sum("ordered"), F.lit(0)) + F.count_if("good_edge")).alias("ordered"),
    )
