"""What is done with every micro-batch: graded results, window changes, freshness.

Each writer owns a folder and puts batch n into its `batch_id=n` subfolder,
overwriting it, so that a batch repeated after a failure leaves no second copy.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.run import Check, run_checks

BatchWriter = Callable[[DataFrame, int], None]


def put(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(os.path.join(folder, f"batch_id={batch_id}"))


def slot(folder: str, batch_id: int) -> str:
    """Where batch n leaves its state: two slots in turn, so n never overwrites what n - 1 left."""
    return os.path.join(folder, f"slot={batch_id % 2}")


def state_before(spark: SparkSession, folder: str, schema: str, batch_id: int) -> DataFrame:
    """The state that the newest batch before this one has left; no rows before the first."""
    try:
        left = spark.read.schema(f"{schema}, of_batch long").parquet(slot(folder, batch_id - 1))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return left.filter(F.col("of_batch") < batch_id).drop("of_batch")


def leave(state: DataFrame, folder: str, batch_id: int) -> None:
    state.withColumn("of_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(slot(folder, batch_id))


def graded_batches(checks: list[Check], table: str, folder: str, **options) -> BatchWriter:
    """Run checks on every micro-batch and keep the results."""

    def write(batch: DataFrame, batch_id: int) -> None:
        put(run_checks(batch.sparkSession, checks, {table: batch}, **options), folder, batch_id)

    return write


_VALUES = ("window_start", "window_end", "sensor_value")


def window_changes(folder: str) -> BatchWriter:
    """Compare every closed window with the one before it of the same probe and group, in this or an earlier batch.

    What is kept from batch to batch is the last window of each probe and group.
    """
    state, changes = os.path.join(folder, "state"), os.path.join(folder, "changes")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = [c for c in batch.columns if c not in _VALUES]
        fresh = batch.select("window_start", "window_end", "sensor_value", *keys)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
        known = state_before(spark, state, schema, batch_id).unionByName(fresh)
        newest_first = Window.partitionBy(*keys).orderBy(F.desc("window_end"))
        before = known.select(F.col("window_end").alias("window_start"), F.col("sensor_value").alias("previous_value"), *keys)
        same = reduce(lambda a, b: a & b, [F.col(f"f.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in ["window_start", *keys]])
        gap = (F.col("sensor_value") - F.col("previous_value")) / F.col("previous_value") * 100
        compared = (
            fresh.alias("f")
            .join(before.alias("b"), same, "left")
            .select("f.*", "b.previous_value")
            .withColumn("change_percent", F.when(F.col("previous_value").isNull() | (F.col("previous_value") == 0), None).otherwise(gap))
        )
        put(compared, changes, batch_id)
        last = known.withColumn("_nth", F.row_number().over(newest_first)).filter("_nth = 1").drop("_nth")
        leave(last, state, batch_id)

    return write


def freshness_of_batches(time: str, delay: str, folder: str, as_of: str | None = None) -> BatchWriter:
    """Per batch: newest event, seconds behind the clock, and rows older than the watermark.

    The watermark a batch meets is the newest event of all earlier batches less the
    delay; rows behind it are what a windowed aggregate would drop. Only that event's
    time is kept from batch to batch.
    """
    state, out = os.path.join(folder, "state"), os.path.join(folder, "batches")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # One value: the newest event so far.
        newest = state_before(spark, state, "newest timestamp", batch_id).agg(F.max("newest")).first()[0]
        moment = F.col(time).cast("timestamp")
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        row = batch.agg(
            F.max(moment).alias("newest"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(moment < limit).alias("late_rows"),
        ).withColumn("lag_seconds", F.unix_seconds(now) - F.unix_seconds("newest"))
        put(row, out, batch_id)
        own = spark.read.parquet(os.path.join(out, f"batch_id={batch_id}"))
        leave(own.select(F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest")), state, batch_id)

    return write


def drain(stream: DataFrame, writer: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available with a batch writer, then stop."""
    (
        stream.writeStream.foreachBatch(writer)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def drain_to_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process everything that is available into Parquet files, then stop."""
    (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
