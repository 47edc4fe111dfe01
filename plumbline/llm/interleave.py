"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within their source, every row gets its
fractional rank (rank - 1/2) / rows of the source, and the rows sorted by that rank
are cut into shards of equal length. Every stretch of the order, and so every shard,
holds the sources in the proportions of the whole.

Ranks come from counted buckets: the order key is uniform, so equal slices of it
hold about `bucket_rows` rows, whatever the source; only rows of one slice are
sorted in one task, and slices are joined by running totals of their counts.

Defined results: a null text has size 8 and the checksum of the empty text; a null
source is a source of its own; a null doc_id sorts first; repeated rows are placed
like others, and as they are equal it does not matter which gets which slot. An
empty table gives no rows. Counts of shards differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shared_folder, table

BUCKET_ROWS = 5_000


def _running(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, and of the whole group."""
    group = Window.partitionBy(*by)
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn(
        "_all", F.sum("_rows").over(group)
    )


def interleave(
    docs: DataFrame,
    n_shards: int = 24,
    *,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_columns: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... within the shard) of every row.

    With `keep_columns` the input columns travel along as a struct `row`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_source"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_columns else []),
    ).withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    # The upper 53 bits of the draw as a number in [0, 1), in unsigned order.
    rows = cut(rows.withColumn("_u", F.shiftrightunsigned("_draw", 11) / F.lit(float(1 << 53))))
    total = rows.count()
    buckets = max(1, math.ceil(total / bucket_rows))
    order = ["_u", "doc_id", "text_crc32", "size"]

    rows = rows.withColumn("_slice", F.floor(F.col("_u") * buckets))
    counts = rows.groupBy("_source", "_slice").agg(F.count("*").alias("_rows"))
    ranked = (
        rows.join(_running(counts, ["_source"], "_slice"), ["_source", "_slice"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_slice").orderBy(*order)))
        .withColumn("_fraction", (F.col("_rank") - 0.5) / F.col("_all"))
        .withColumn("_part", F.floor(F.col("_fraction") * buckets))
        .drop("_before", "_all", "_rows", "_slice")
    )
    counts = ranked.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_one", F.lit(1))
    placed = ranked.join(_running(counts, ["_one"], "_part"), "_part").withColumn(
        "_position",
        F.col("_before")
        + F.row_number().over(Window.partitionBy("_part").orderBy("_fraction", "_source", *order))
        - 1,
    )
    shard = f"(_position * {n_shards}) div _all"
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_source").alias("stratum"),
        F.expr(shard).cast("int").alias("shard"),
        (F.col("_position") - F.expr(f"(({shard}) * _all + {n_shards} - 1) div {n_shards}")).alias("slot"),
        *(["row"] if keep_columns else []),
    )


def write_shards(docs: DataFrame, n_shards: int, folder: str | None = None, **options) -> str:
    """Write the whole rows as Parquet, a folder per shard, in slot order; returns the folder."""
    folder = folder or shared_folder(docs.sparkSession, "shards")
    placed = interleave(docs, n_shards, keep_columns=True, **options)
    (
        placed.select("shard", "slot", "row.*")
        .repartition("shard", F.expr("slot div 50000"))  # a long shard is several files
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(folder)
    )
    return folder


def op6_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`: counts differ by one at most."""
    placed = interleave(table(spark, sf_dir, "documents"), 24, seed=17)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
    )
