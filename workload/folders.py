"""Where queries put what they write on the way."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from plumbline.sources import results


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared one; a single machine without one uses a folder of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-"))
    return results.shared_folder(spark, purpose)
