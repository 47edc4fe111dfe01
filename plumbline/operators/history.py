"""The results history: latest, earlier, per bucket, and its usual spread.

A history has one row per run: `check_id`, `executed_at`, `actual_value` and
whatever the results table adds. One check may own a large part of it, so
nothing here sorts a whole check's history in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.percentiles import log_bucket

_HOUR = 3600 * 1_000_000
_DAY = 24 * _HOUR


def latest(results: DataFrame, keys: list[str], *, since: str | None = None, until: str | None = None) -> DataFrame:
    """The newest row of each key in a date range; equal times are decided by the whole row."""
    if since is not None:
        results = results.filter(F.col("executed_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        results = results.filter(F.col("executed_at") <= F.lit(until).cast("timestamp"))
    others = [c for c in results.columns if c not in (*keys, "executed_at")]
    newest = F.max(F.struct("executed_at", *others)).alias("newest")
    return results.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*results.columns)


def newest_per_bucket(results: DataFrame, keys: list[str], scale: str) -> DataFrame:
    """One row per key and day or month: the newest one."""
    bucket = F.date_trunc(scale, F.col("executed_at").cast("timestamp")).cast("date")
    return latest(results.withColumn("bucket", bucket), [*keys, "bucket"])


def with_earlier(current: DataFrame, history: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Add `earlier_value`: the newest reading of the key in the hour that ends 23 hours (or n days less 1 hour) ago.

    The band is [t - days, t - days + 1 h). History readings are moved forward by
    `days`, so the question becomes: the last reading before t + 1 h, if it is not
    before t. Rows are split by hour, every reading is placed in its own hour and
    the next, and a running `last` answers it in one sort of each key's hour.
    """
    micros = F.unix_micros(F.col("executed_at").cast("timestamp"))
    asked = current.withColumn("at", micros + F.lit(_HOUR)).select(
        *keys, "at", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("reading"), F.struct(*current.columns).alias("row")
    ).withColumn("hour", F.floor(F.col("at") / _HOUR))
    row_type = asked.schema["row"].dataType
    known = (
        history.filter(F.col("actual_value").isNotNull())
        .withColumn("at", micros + F.lit(days * _DAY))
        .select(
            *keys,
            "at",
            F.lit(1).alias("kind"),
            F.col("actual_value").cast("double").alias("reading"),
            F.lit(None).cast(row_type).alias("row"),
            F.explode(F.array(F.floor(F.col("at") / _HOUR), F.floor(F.col("at") / _HOUR) + 1)).alias("hour"),
        )
    )
    # At equal times the question (kind 0) sorts first: the band's upper end is open.
    ordered = (
        Window.partitionBy(*keys, "hour").orderBy("at", "kind", "reading").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = F.last(F.when(F.col("kind") == 1, F.struct("at", "reading")), ignorenulls=True).over(ordered)
    return (
        asked.unionByName(known)
        .withColumn("last", last)
        .filter("kind = 0")
        .select(
            "row.*",
            F.when(F.col("last.at") >= F.col("at") - F.lit(_HOUR), F.col("last.reading")).alias("earlier_value"),
        )
    )


def _band(as_of: str | Column | None, days: int | Column) -> tuple[Column, Column]:
    """The hour that ends 23 hours (or n days less 1 hour) before a moment: [t - days, t - days + 1 h)."""
    moment = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    days = days if isinstance(days, Column) else F.lit(days)
    low = moment - F.make_dt_interval(days)
    return low, low + F.expr("INTERVAL 1 HOUR")


def earlier_readings(history: DataFrame, questions: DataFrame, bands: list[tuple[str | None, int]], by: list[str]) -> DataFrame:
    """The newest reading in the band of each question: probe_id, partition, earlier_value; none where there is none.

    `questions` are rows of (probe_id, metric_id, as_of, days), few; `bands` their distinct
    (as_of, days). The bounds of all bands are known when the plan is made, so they are
    filters of one scan of the history: on `executed_at`, which reaches the files'
    statistics, and on `run_date`, where the history is stored by day, which leaves out
    all other folders. Only the hours in question are read, for all gaps at once.
    """
    at = F.col("executed_at").cast("timestamp")
    wanted = F.lit(False)
    for as_of, days in bands:
        low, high = _band(as_of, days)
        inside = (at >= low) & (at < high)
        if "run_date" in history.columns:  # a day more on both sides: the folder's day is that of the writer's time zone
            inside &= F.col("run_date").between(F.date_sub(low.cast("date"), 1), F.date_add(high.cast("date"), 1))
        wanted |= inside
    low, high = _band(F.coalesce(F.col("as_of").cast("timestamp"), F.current_timestamp()), F.col("days"))
    limits = questions.select("probe_id", "metric_id", low.alias("low"), high.alias("high"))
    known = history.filter(wanted & F.col("actual_value").isNotNull()).select(
        "metric_id", *by, at.alias("at"), F.col("actual_value").cast("double").alias("reading")
    )
    # Bounded by the caller's list of probes.
    asked = known.join(F.broadcast(limits), "metric_id").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    newest = F.max(F.struct("at", "reading"))
    return asked.groupBy("probe_id", *by).agg(newest["reading"].alias("earlier_value"))


def percent_change(value: Column, earlier: Column, absolute: bool) -> Column:
    """Signed change in percent; NULL without an earlier reading or when it is 0."""
    base = F.abs(earlier) if absolute else earlier
    return F.when(earlier.isNull() | (earlier == 0), None).otherwise((value - earlier) / base * 100)


def _ranked(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add how many readings of the key come before each row, and all of the key's."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(group))


def anomaly_fence(
    history: DataFrame, keys: list[str], as_of: str | Column, *, days: int = fixed.ANOMALY_DAYS, newest: int | None = None
) -> DataFrame:
    """The range a reading is expected in: quartiles of its last `days` days, widened by 1.5 spans.

    `newest` keeps only so many of the newest readings of a key; without it all count.
    Quartiles are found by counting: readings per bucket of values first, then single
    values within the bucket that holds the rank, so a key of any length is no burden.
    """
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    recent = history.filter(
        F.col("actual_value").isNotNull()
        & (F.col("executed_at").cast("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS"))
        & (F.col("executed_at").cast("timestamp") < now)
    ).select(*keys, "executed_at", F.col("actual_value").cast("double").alias("reading"))
    if newest is not None:
        order = Window.partitionBy(*keys).orderBy(F.desc("executed_at"), "reading")
        recent = recent.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= newest)
    values = recent.groupBy(*keys, "reading").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", log_bucket(F.col("reading")))
    buckets = _ranked(values.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")), keys, "bucket")
    # Ranks count from 0: a quarter and three quarters of the way.
    ranks = F.array(
        F.struct(F.lit("q1").alias("name"), F.floor(F.col("total") / 4).alias("rank")),
        F.struct(F.lit("q3").alias("name"), F.floor(F.col("total") * 3 / 4).alias("rank")),
    )
    holders = (
        buckets.withColumn("quartile", F.explode(ranks))
        .filter("quartile.rank >= before AND quartile.rank < before + n")
        .select(*keys, "bucket", "quartile.name", (F.col("quartile.rank") - F.col("before")).alias("rank"), F.col("total").alias("all"))
    )
    same = reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "bucket"]])
    inside = values.alias("v").join(holders.alias("h"), same).select("v.*", "h.name", "h.rank", "h.all")
    found = _ranked(inside, [*keys, "name"], "reading").filter("rank >= before AND rank < before + n")
    span = F.col("q3") - F.col("q1")
    return (
        found.groupBy(*keys)
        .agg(
            F.max("all").cast("int").alias("history_count"),
            F.max(F.when(F.col("name") == "q1", F.col("reading"))).alias("q1"),
            F.max(F.when(F.col("name") == "q3", F.col("reading"))).alias("q3"),
        )
        .withColumn("fence_low", F.col("q1") - fixed.ANOMALY_WIDTH * span)
        .withColumn("fence_high", F.col("q3") + fixed.ANOMALY_WIDTH * span)
    )


def unchecked_partitions(partitions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions without a result yet: what an incremental run has to measure."""
    return partitions.join(results.select(*keys).distinct(), keys, "left_anti")
