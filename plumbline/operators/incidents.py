"""Incidents: runs of failures of a check, and where to announce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.joins import lookup_join

def _lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    value = F.lit(default)
    for name, mapped in mapping.items():
        value = F.when(key == name, mapped).otherwise(value)
    return value


def fold(results: DataFrame, open_before: DataFrame | None = None) -> DataFrame:
    """Fold a results history into incidents.

    `open_before` are incidents (as returned here) still open from an earlier part
    of the history; each counts as one failure that stands for all of its failures.

    A failure opens an incident or extends the open one; a pass resolves it. The
    failures between two passes share the number of passes before them, so that
    number names the incident. It is counted hour by hour: passes per check and hour,
    a running total over the hours, and a running count inside each hour. A check
    that runs all the time is spread over its hours. If the results have a
    `partition`, every partition of a check has incidents of its own.
    """
    keys = ["check_id", "partition"] if "partition" in results.columns else ["check_id"]
    results, open_before = (
        df if df is None or len(keys) == 1 else df.withColumn("partition", F.coalesce("partition", F.lit(""))) for df in (results, open_before)
    )
    rows = results.select(
        *keys,
        F.col("executed_at").cast("timestamp").alias("executed_at"),
        "passed",
        "severity",
        "message",
        F.lit(1).cast("bigint").alias("weight"),
        F.col("executed_at").cast("timestamp").alias("since"),
    )
    if open_before is not None:
        by_incident = {v: k for k, v in fixed.INCIDENT_SEVERITY.items()}
        rows = rows.unionByName(
            open_before.select(
                *keys,
                F.col("last_failure_at").alias("executed_at"),
                F.lit(False).alias("passed"),
                _lookup(by_incident, F.col("severity"), "error").alias("severity"),
                F.col("description").alias("message"),
                F.col("failure_count").alias("weight"),
                F.col("first_failure_at").alias("since"),
            )
        )
    rows = rows.withColumn("hour", F.date_trunc("hour", "executed_at"))
    per_hour = rows.groupBy(*keys, "hour").agg(F.count_if("passed").alias("passes"))
    hours = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_hour.select(*keys, "hour", F.coalesce(F.sum("passes").over(hours), F.lit(0)).alias("earlier"))
    within = (
        Window.partitionBy(*keys, "hour")
        .orderBy("executed_at", "passed", "severity", "message")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = (
        rows.withColumn("so_far", F.sum(F.col("passed").cast("int")).over(within))
        .join(earlier, [*keys, "hour"])
        # A pass closes the incident before it, so it carries that incident's number.
        .withColumn("incident", F.col("earlier") + F.col("so_far") - F.col("passed").cast("int"))
    )
    failed = ~F.col("passed")
    spoken = F.struct("executed_at", "severity", "message")
    folded = numbered.groupBy(*keys, "incident").agg(
        F.coalesce(F.sum(F.when(failed, F.col("weight"))), F.lit(0)).alias("failure_count"),
        F.min(F.when(failed, F.col("since"))).alias("first_failure_at"),
        F.max(F.when(failed, F.col("executed_at"))).alias("last_failure_at"),
        F.min(F.when(failed, spoken)).alias("first"),
        F.max(F.when(failed, spoken)).alias("last"),
        F.min(F.when(F.col("passed"), F.col("executed_at"))).alias("resolved_at"),
    )
    named = [F.col("check_id"), *([F.when(F.col("partition") != "", F.col("partition"))] if len(keys) > 1 else [])]
    return folded.filter("failure_count > 0").select(
        "check_id",
        *([named[1].alias("partition")] if len(keys) > 1 else []),
        F.concat_ws("/", *named, F.date_format("first_failure_at", "yyyy-MM-dd HH:mm:ss")).alias("incident_id"),
        F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved").alias("status"),
        _lookup(fixed.INCIDENT_SEVERITY, F.col("first.severity"), "medium").alias("severity"),
        F.concat(F.lit("Check failed: "), F.concat_ws(" ", *named)).alias("title"),
        F.col("last.message").alias("description"),
        "first_failure_at",
        "last_failure_at",
        "failure_count",
        "resolved_at",
    )


def previous_by_hour(df: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """Add the key's previous value in time order, working hour by hour.

    Inside an hour it is the row before; the first row of an hour takes the last
    value of the key's previous hour.
    """
    placed = df.withColumn("_hour", F.date_trunc("hour", time))
    within = Window.partitionBy(key, "_hour").orderBy(time, value)
    closing = placed.groupBy(key, "_hour").agg(F.max(F.struct(time, value)).alias("closing"))
    across = closing.select(
        key, "_hour", F.lag(F.col("closing")[value]).over(Window.partitionBy(key).orderBy("_hour")).alias("_before")
    )
    return (
        placed.withColumn("_nth", F.row_number().over(within))
        .withColumn("_inside", F.lag(value).over(within))
        .join(across, [key, "_hour"])
        .withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_inside")))
        .drop("_hour", "_nth", "_inside", "_before")
    )


def illegal_moves(changes: DataFrame) -> DataFrame:
    """Status changes an incident may not make; a first status other than open is one.

    `changes` has incident_id, changed_at, status.
    """
    moved = previous_by_hour(changes, "incident_id", "changed_at", "status", "from_status")
    allowed = F.col("from_status").isNull() & (F.col("status") == "open")
    for before, after in fixed.INCIDENT_MOVES:
        allowed = allowed | ((F.col("from_status") == before) & (F.col("status") == after))
    return moved.filter(~F.coalesce(allowed, F.lit(False)))


def find_incidents(
    incidents: DataFrame, *, check_id: str | None = None, status: str | None = None, severity: str | None = None
) -> DataFrame:
    for name, wanted in (("check_id", check_id), ("status", status), ("severity", severity)):
        if wanted is not None:
            incidents = incidents.filter(F.col(name) == wanted)
    return incidents


def open_incidents(incidents: DataFrame, checks: DataFrame) -> DataFrame:
    """Unresolved incidents with their checks, gravest first, then newest."""
    rank = _lookup({"critical": "1", "high": "1", "medium": "2"}, F.col("severity"), "3").cast("int")
    return (
        incidents.filter(F.col("status").isin("open", "acknowledged"))
        .join(checks.select("check_id", "check_type", "table_name"), "check_id")
        .withColumn("rank", rank)
        .orderBy("rank", F.desc("first_failure_at"), "incident_id")
    )


def alerts(incidents: DataFrame, channels: DataFrame) -> DataFrame:
    """The outbox: one row per incident event and channel that wants it, with its payload.

    `incidents` has event (incident.opened, incident.resolved) next to the incident's
    columns; `channels` has channel_id, events, min_severity (NULL = all), is_active.
    Channels are taken apart into (event, severity) subscriptions, so this is an
    equality join; the subscriptions are broadcast when there are few of them.
    """
    heard = _lookup(fixed.ALERT_SEVERITY, F.col("severity"), "error")
    levels = F.array(*[F.lit(s) for s in fixed.ALERT_RANK])

    def rank(severity: Column) -> Column:
        ranks = [x for s, r in fixed.ALERT_RANK.items() for x in (F.lit(s), F.lit(r))]
        return F.coalesce(F.create_map(*ranks)[severity], F.lit(0))

    subscriptions = (
        channels.filter("is_active")
        .select("channel_id", F.explode(F.array_distinct("events")).alias("event"), "min_severity")
        .withColumn("heard", F.explode(levels))
        .filter(F.col("min_severity").isNull() | (rank(F.col("heard")) >= rank(F.col("min_severity"))))
        .select("channel_id", "event", "heard")
    )
    payload = F.to_json(
        F.struct(
            "event",
            F.struct(
                F.col("incident_id").alias("id"), "title", "severity", "status", "failure_count", "check_id", "description"
            ).alias("incident"),
        )
    )
    routed = lookup_join(incidents.withColumn("heard", heard), subscriptions, ["event", "heard"])
    return routed.select("channel_id", "incident_id", "event", payload.alias("payload"))
