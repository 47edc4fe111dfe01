"""Scores per quality dimension, and the reports over a results history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.checks import CHECKS, dimension_of
from plumbline.operators.history import latest

_SEVERITIES = list(fixed.SEVERITY_WEIGHT)


def check_dimensions(spark: SparkSession) -> DataFrame:
    """check_type and dimension of every check type; NULL for what is not scored."""
    from plumbline.operators.expectations import EXPECTATIONS

    names = [*CHECKS, *[n for n in EXPECTATIONS if n not in CHECKS]]
    return spark.createDataFrame([(n, dimension_of(n)) for n in names], "check_type string, dimension string")


def with_dimension(checks: DataFrame) -> DataFrame:
    """Checks with the dimension of their type. The map has one row per check type, so it is broadcast."""
    known = check_dimensions(checks.sparkSession)
    return checks.drop("dimension").join(F.broadcast(known), "check_type", "left")


def _counts(severity: Column) -> list[Column]:
    return [F.count_if(severity == s).alias(s) for s in _SEVERITIES]


def score(passed: Column, warning: Column, error: Column, fatal: Column) -> Column:
    """100 less the weighted share of failures, one decimal, halves to even; NULL when nothing ran."""
    counts = dict(zip(_SEVERITIES, (passed, warning, error, fatal)))
    total = passed + warning + error + fatal
    penalty = sum((F.lit(w) * counts[s] for s, w in fixed.SEVERITY_WEIGHT.items()), F.lit(0.0))
    worst = total * fixed.SEVERITY_WEIGHT["fatal"]
    return F.when(total > 0, F.bround(F.greatest(F.lit(0.0), 100.0 * (1.0 - penalty / worst)), 1))


def traffic_light(points: Column) -> Column:
    return (
        F.when(points.isNull(), "not_assessed")
        .when(points >= fixed.GREEN_FROM, "green")
        .when(points >= fixed.AMBER_FROM, "amber")
        .otherwise("red")
    )


def latest_of_checks(checks: DataFrame, results: DataFrame, **window: str) -> DataFrame:
    """Active checks, each with its latest result; the result columns are NULL when it never ran.

    A check that runs by partition (the results have that column) has a row for each partition.
    """
    keys = ["check_id", "partition"] if "partition" in results.columns else ["check_id"]
    newest = latest(results.select(*keys, "executed_at", "actual_value", "passed", "severity"), keys, **window)
    return checks.filter("is_active").join(newest, "check_id", "left")


def dimension_scores(checks: DataFrame, results: DataFrame, **window: str) -> DataFrame:
    """One row per quality dimension, from the latest result of each active check."""
    current = with_dimension(latest_of_checks(checks, results, **window))
    counted = current.filter(F.col("dimension").isNotNull()).groupBy("dimension").agg(
        F.count_distinct("check_id").alias("checks"), F.count_if(F.col("executed_at").isNull()).alias("not_run"), *_counts(F.col("severity"))
    )
    spark = checks.sparkSession
    all_dimensions = spark.createDataFrame([(d,) for d in fixed.DIMENSIONS], "dimension string")
    full = F.broadcast(all_dimensions).join(counted, "dimension", "left").fillna(0)
    points = score(*[F.col(s) for s in _SEVERITIES])
    return full.withColumn("score", points).withColumn("status", traffic_light(F.col("score")))


def overall_score(scores: DataFrame) -> DataFrame:
    """Mean of the assessed dimensions' scores and how many were assessed."""
    return scores.agg(
        F.bround(F.avg("score"), 1).alias("overall_score"), F.count("score").alias("assessed_dimensions")
    )


def daily_trend(checks: DataFrame, results: DataFrame, as_of: str, days: int = 30, dimension: str | None = None) -> DataFrame:
    """Score per dimension and day over all results of the last days, not only the latest."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    wanted = with_dimension(checks.filter("is_active").select("check_id", "check_type"))
    wanted = wanted.filter(F.col("dimension").isNotNull() if dimension is None else F.col("dimension") == dimension)
    recent = results.filter(F.col("executed_at") >= since).select("check_id", "executed_at", "severity")
    # Results are counted per check and day first; the join sees one row per check and day.
    per_check = recent.groupBy("check_id", F.to_date("executed_at").alias("day")).agg(*_counts(F.col("severity")))
    per_day = per_check.join(wanted.select("check_id", "dimension"), "check_id").groupBy("dimension", "day").agg(
        *[F.sum(s).alias(s) for s in _SEVERITIES]
    )
    return per_day.select("dimension", "day", score(*[F.col(s) for s in _SEVERITIES]).alias("score"))


def checks_of(checks: DataFrame, results: DataFrame, dimension: str) -> DataFrame:
    """The active checks of a dimension with their latest result."""
    return with_dimension(latest_of_checks(checks, results)).filter(F.col("dimension") == dimension)


def find_results(
    results: DataFrame,
    *,
    check_id: str | None = None,
    table_name: str | None = None,
    passed: bool | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Results that meet the given conditions; time bounds reach the partition filter."""
    if check_id is not None:
        results = results.filter(F.col("check_id") == check_id)
    if table_name is not None:
        results = results.filter(F.col("table_name") == table_name)
    if passed is not None:
        results = results.filter(F.col("passed") == F.lit(passed))
    for bound, day_test, test in (
        (since, lambda d, b: d >= b, lambda t, b: t >= b),
        (until, lambda d, b: d <= b, lambda t, b: t <= b),
    ):
        if bound is not None:
            moment = F.lit(bound).cast("timestamp")
            results = results.filter(test(F.col("executed_at"), moment))
            if "run_date" in results.columns:
                results = results.filter(day_test(F.col("run_date"), moment.cast("date")))
    return results


def page_of(results: DataFrame, page: int, size: int, newest_by: str = "executed_at", tie: str = "check_id") -> DataFrame:
    """One page, newest first."""
    return results.orderBy(F.desc(newest_by), F.asc(tie)).offset((page - 1) * size).limit(size)


def summary(results: DataFrame) -> DataFrame:
    """Totals of a set of results; the pass rate of nothing is 0."""
    total, good = F.count(F.lit(1)), F.count_if("passed")
    return results.agg(
        total.alias("total"),
        good.alias("passed_count"),
        (total - good).alias("failed_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_results") for s in _SEVERITIES],
        F.when(total == 0, F.lit(0.0)).otherwise(100.0 * good / total).alias("pass_rate"),
        F.avg("execution_time_ms").alias("mean_time_ms")
        if "execution_time_ms" in results.columns
        else F.lit(None).cast("double").alias("mean_time_ms"),
    )


def pass_rate_by(results: DataFrame, keys: list[str], *, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Runs, passes and pass rate (percent, one decimal) per group, optionally of the last days only."""
    if days is not None:
        since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
        results = results.filter(F.col("executed_at") > since)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("passed").alias("passed_runs"),
        F.round(100.0 * F.count_if("passed") / F.count(F.lit(1)), 1).alias("pass_rate"),
    )
