"""The results table: Parquet files, one folder per run date."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.history import newest_per_bucket
from plumbline.operators.sample import repeatable_sample
from plumbline.plans.run import RESULT_COLUMNS, Check, reason_of, run_checks

RESULTS_SCHEMA = ", ".join(f"{n} {t}" for n, t in RESULT_COLUMNS.items()) + ", run_date date"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder all executors can reach: below spark.checkpoint.dir, which has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def append_results(results: DataFrame, path: str) -> None:
    """Append graded results to the table, in the folder of their date."""
    (
        results.withColumn("run_date", F.to_date("executed_at"))
        .write.mode("append")
        .partitionBy("run_date")
        .parquet(path)
    )


def expressions(check: Check) -> list[str]:
    """What a user wrote in SQL for a check: the only parts of a plan that can fail on the values of a table."""
    return [text for text in (check.where, *check.params.values()) if isinstance(text, str)]


def culprits(error: PySparkException, checks: list[Check], fails: Callable[[list[Check]], bool]) -> list[Check]:
    """Which checks raised an error of the data.

    The error names the piece of SQL that raised it. One check with this piece: that one.
    Several (the piece may be harmless behind another filter), or none: those that fail
    when tried, halves first; the others are not run again.
    """
    pieces = [context.fragment() for context in error.getQueryContext() or []]
    suspects = [c for c in checks if any(piece and piece in text for text in expressions(c) for piece in pieces)] or checks

    def failing(some: list[Check]) -> list[Check]:
        if len(some) == 1:
            return some
        half = len(some) // 2
        return [c for part in (some[:half], some[half:]) if fails(part) for c in failing(part)]

    return failing(suspects)


def run_and_append(
    spark: SparkSession, checks: list[Check], tables: dict[str, DataFrame], path: str, *, retries: int = 1, **options
) -> dict[str, str]:
    """Run checks and append their results, written once; an error of the data costs its own check only.

    All run together. An error that an expression raised on the data is traced to the checks
    that hold it (see `culprits`); they get failed rows and the rest runs again. Every other
    error, such as a lost executor or a full disk, blames no check: the run is tried
    `retries` more times, and raised. A failed run writes nothing, and all rows have the
    time of the first attempt. The reasons are returned by check id; `options` go to `run_checks`.
    """
    if not options.get("executed_at"):
        options["executed_at"] = str(spark.sql("SELECT current_timestamp()").first()[0])
    broken: dict[str, str] = dict(options.pop("broken", None) or {})

    def fails(some: list[Check]) -> bool:
        try:
            run_checks(spark, some, tables, **options).write.format("noop").mode("overwrite").save()
        except PySparkException as error:
            if not of_the_data(error):
                raise
            return True
        return False

    while True:
        try:
            append_results(run_checks(spark, checks, tables, broken=broken, **options), path)
            return broken
        except (PySparkException, Py4JJavaError) as error:
            if isinstance(error, PySparkException) and of_the_data(error):
                found = culprits(error, [c for c in checks if c.check_id not in broken and c.active], fails)
                if found:
                    reason = reason_of(error)
                    broken |= {c.check_id: reason for c in found}
                    continue
            if not retries:
                raise
            retries -= 1


def of_the_data(error: PySparkException) -> bool:
    """Whether an expression raised the error on the values it was given: Spark gives such errors a SQLSTATE of class 22 or P0001."""
    state = error.getSqlState() or ""
    return state.startswith("22") or state == "P0001"


def merge_by_folder(rows: DataFrame, path: str, folder: str, keys: list[str], newest: tuple[str, ...] = ()) -> None:
    """Store rows in a table with a folder per value of `folder`, one row per key within it.

    Of rows with equal keys the one with the greatest `newest` columns is stored; where
    these are equal too, the one given last. Stored rows of the folders in question are
    read, merged, and only those folders are replaced, all in one commit at the end of the
    job. So the same rows given again, by a repeated run or batch, change nothing. A failed
    run leaves the stored rows as they were until the commit; writers of the same folder
    have to take turns.
    """
    spark = rows.sparkSession
    staged = shared_folder(spark, "staged")
    rows.write.parquet(staged)  # computed once, though read twice
    new = spark.read.schema(rows.schema).parquet(staged).withColumn("_given", F.lit(1))
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        both = new
    else:
        touched = stored.join(new.select(folder).distinct(), folder, "left_semi").select(*rows.columns)
        both = touched.withColumn("_given", F.lit(0)).unionByName(new)
    # The whole row comes last, so that ties end alike in every run.
    order = F.struct(*newest, "_given", F.to_json(F.struct(*rows.columns)))
    merged = both.groupBy(*dict.fromkeys([*keys, folder])).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    (
        merged.select("_row.*")
        .repartition(folder)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(folder)
        .parquet(path)
    )


def store_per_bucket(results: DataFrame, path: str, scale: str, keys: tuple[str, ...] = ("check_id", "partition")) -> None:
    """Keep one stored result per key and bucket (`day`, `month`, ...): the newest, in a folder per bucket.

    A later run replaces its bucket's rows, a straggler replaces none, a repeated run stores nothing twice.
    """
    kept = newest_per_bucket(results, list(keys), scale)
    merge_by_folder(kept, path, "bucket", list(keys), ("executed_at",))


def store_days(sketches: DataFrame, path: str) -> None:
    """Store the sketches of days (`day_sketches`), a folder a month; a day that is stored again replaces its rows."""
    by_month = sketches.withColumn("month", F.date_trunc("month", "day").cast("date"))
    merge_by_folder(by_month, path, "month", ["table_name", "column_name", "day"])


def read_buckets(spark: SparkSession, path: str, *, since: str | None = None) -> DataFrame:
    """What `store_per_bucket` stored, its folders pruned by `since`."""
    results = spark.read.parquet(path)
    return results.filter(F.col("bucket") >= F.lit(since).cast("date")) if since else results


def read_results(spark: SparkSession, path: str, *, since: str | None = None) -> DataFrame:
    """The results table, its date folders pruned by `since`."""
    results = spark.read.schema(RESULTS_SCHEMA).parquet(path)
    return results.filter(F.col("run_date") >= F.lit(since).cast("date")) if since else results


def cached_sample(
    df: DataFrame, table: str, key: list[str], seed: int, rows: int, folder: str, *, pii: tuple[str, ...] = ()
) -> DataFrame:
    """The repeatable sample, taken once per schema: a changed column list makes a new one."""
    from pyspark.errors import AnalysisException

    from plumbline.operators.catalog import schema_fingerprint

    spark = df.sparkSession
    name = f"{schema_fingerprint(df)[:16]}-{seed}-{rows}-{'-'.join(sorted(pii))}"
    path = os.path.join(folder, table, name)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        repeatable_sample(df, key, seed, rows, pii=pii).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
