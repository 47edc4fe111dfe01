"""Incidents kept up to date from a stream of results.

The state is a table: the incidents open after each micro-batch. A batch is folded
together with it by the same distributed fold as a whole history, so a check that
sends a third of all results is spread over tasks, which one state entry per check
would not allow. Open incidents lie in two alternating folders, however many batches
there were: batch n reads what batch n - 1 left and overwrites the other, so a repeated
batch gives the same incidents again. Results of one check are
expected batch by batch in time order; a straggler counts from when it arrives.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.incidents import fold
from plumbline.streaming.batches import BatchWriter, leave, put, state_before

INCIDENT_SCHEMA = (
    "check_id string, incident_id string, status string, severity string, title string, description string, "
    "first_failure_at timestamp, last_failure_at timestamp, failure_count bigint, resolved_at timestamp"
)


def incident_batches(folder: str) -> BatchWriter:
    """Fold every micro-batch of results: open incidents are carried on, resolved ones are kept."""
    still_open, resolved, done = (os.path.join(folder, kind) for kind in ("open", "resolved", "done"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folded = fold(batch, state_before(spark, still_open, INCIDENT_SCHEMA, batch_id)).persist()
        leave(folded.filter("status = 'open'"), still_open, batch_id)
        put(folded.filter("status = 'resolved'"), resolved, batch_id)
        folded.unpersist()
        # Tells a batch that left nothing open from one that was not finished.
        leave(spark.range(1), done, batch_id)

    return write


def current_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """All resolved incidents, and those open after the newest finished batch."""
    of_batch = f"{INCIDENT_SCHEMA}, of_batch long"
    resolved = spark.read.schema(INCIDENT_SCHEMA).parquet(os.path.join(folder, "resolved"))
    # At most two rows: the marks of the last two batches.
    newest = spark.read.schema("of_batch long").parquet(os.path.join(folder, "done")).agg(F.max("of_batch")).first()[0]
    left = spark.read.schema(of_batch).parquet(os.path.join(folder, "open")).filter(F.col("of_batch") == newest)
    return resolved.drop("batch_id").unionByName(left.drop("of_batch", "slot"))
