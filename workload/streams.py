"""Queries that read the events as a stream and drain it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.measure import Probe
from plumbline.plans.run import Check
from plumbline.streaming import batches, windows
from plumbline.streaming.incidents import current_incidents, incident_batches
from workload import history
from workload.folders import shared_folder
from workload.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = shared_folder(spark, "stream")
    batches.drain_to_files(stream, os.path.join(folder, "out"), os.path.join(folder, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(os.path.join(folder, "out"))


def _starts(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd HH:mm:ss"))
    return df


_PROBES = [
    Probe("rows", "row_count"),
    Probe("mean", "mean_value", "value"),
    Probe("clicks", "text_in_set_percent", "event_type", {"expected_values": ["click"]}),
    Probe("nulls", "nulls_percent", "value"),
]
_PROBE_SQL = (
    "UNPIVOT (SELECT w, count(*)::DOUBLE AS rows, avg(value) AS mean, "
    "100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*) AS clicks, "
    "100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) AS nulls FROM {source} GROUP BY w) "
    "ON rows, mean, clicks, nulls INTO NAME probe_id VALUE v"
)


def _tumbling(spark, sf_dir):
    stream = windows.window_sensors(_events(spark, sf_dir), "ts", _PROBES, width="1 day", delay="2 hours")
    return _starts(_drained(spark, stream), "window_start").select(
        "window_start", "probe_id", F.round("sensor_value", 6).alias("sensor_value")
    )


QUERIES["stream_daily_sensors"] = _tumbling
SQL["stream_daily_sensors"] = f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, probe_id, round(v, 6) AS sensor_value FROM (
{_PROBE_SQL.format(source="(SELECT *, date_trunc('day', ts) AS w FROM events)")})
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""


def _sliding(spark, sf_dir):
    stream = windows.window_sensors(
        _events(spark, sf_dir), "ts", _PROBES[:2], width="1 hour", slide="30 minutes", delay="1 hour"
    )
    return _starts(_drained(spark, stream), "window_start").select(
        "window_start", "probe_id", F.round("sensor_value", 6).alias("sensor_value")
    )


QUERIES["stream_sliding_sensors"] = _sliding
SQL["stream_sliding_sensors"] = """
WITH e AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events),
s AS (SELECT value, b AS w FROM e UNION ALL SELECT value, b - INTERVAL 30 MINUTE FROM e),
a AS (SELECT w, count(*)::DOUBLE AS rows, avg(value) AS mean FROM s GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, probe_id, round(v, 6) AS sensor_value
FROM (UNPIVOT a ON rows, mean INTO NAME probe_id VALUE v)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def _changes(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    stream = windows.window_sensors(_events(spark, sf_dir), "ts", _PROBES[:1], width="1 day", delay="2 hours")
    batches.drain(stream, batches.window_changes(folder), os.path.join(folder, "checkpoint"))
    changes = spark.read.parquet(os.path.join(folder, "changes"))
    return _starts(changes, "window_start").select(
        "window_start", "sensor_value", "previous_value", F.round("change_percent", 6).alias("change_percent")
    )


QUERIES["stream_row_count_changes"] = _changes
SQL["stream_row_count_changes"] = """
WITH d AS (SELECT date_trunc('day', ts) AS w, count(*)::DOUBLE AS n FROM events GROUP BY 1),
c AS (SELECT * FROM d WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)
SELECT strftime(c.w, '%Y-%m-%d %H:%M:%S') AS window_start, c.n AS sensor_value, p.n AS previous_value,
  round((c.n - p.n) / p.n * 100, 6) AS change_percent FROM c LEFT JOIN c p ON p.w = c.w - INTERVAL 1 DAY"""


def _changes_per_type(spark, sf_dir):
    """Every event type's days compared with the day before of the same type."""
    folder = shared_folder(spark, "stream")
    stream = windows.window_sensors(
        _events(spark, sf_dir), "ts", _PROBES[:1], width="1 day", delay="2 hours", by=["event_type"]
    )
    batches.drain(stream, batches.window_changes(folder), os.path.join(folder, "checkpoint"))
    changes = spark.read.parquet(os.path.join(folder, "changes"))
    return _starts(changes, "window_start").select(
        "event_type", "window_start", "sensor_value", "previous_value", F.round("change_percent", 6).alias("change_percent")
    )


QUERIES["stream_changes_per_type"] = _changes_per_type
SQL["stream_changes_per_type"] = """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS w, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
c AS (SELECT * FROM d WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)
SELECT c.event_type, strftime(c.w, '%Y-%m-%d %H:%M:%S') AS window_start, c.n AS sensor_value, p.n AS previous_value,
  round((c.n - p.n) / p.n * 100, 6) AS change_percent
FROM c LEFT JOIN c p ON p.event_type = c.event_type AND p.w = c.w - INTERVAL 1 DAY"""


def _orphans(spark, sf_dir):
    known = load(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("c_custkey"))
    stream = windows.orphan_windows(_events(spark, sf_dir), "ts", "user_id", known, "c_custkey", width="1 day", delay="2 hours")
    return _starts(_drained(spark, stream), "window_start").select("window_start", "present", "orphans")


QUERIES["stream_orphan_keys"] = _orphans
SQL["stream_orphan_keys"] = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(user_id) AS present, count(*) FILTER (WHERE c_custkey IS NULL) AS orphans
FROM (SELECT *, date_trunc('day', ts) AS w FROM events) LEFT JOIN (SELECT 2 * c_custkey AS c_custkey FROM customer) ON user_id = c_custkey
GROUP BY w HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""


def _unique(spark, sf_dir):
    doubled = _events(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    stream = windows.unique_windows(doubled, "ts", ["event_id"], width="1 day", delay="2 hours")
    return _starts(_drained(spark, stream), "window_start").select("window_start", "unique_rows")


QUERIES["stream_duplicate_keys"] = _unique
SQL["stream_duplicate_keys"] = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT event_id) AS unique_rows
FROM (SELECT *, date_trunc('day', ts) AS w FROM events) GROUP BY w
HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""


def _freshness(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    writer = batches.freshness_of_batches("ts", "2 HOURS", os.path.join(folder, "out"), "2024-02-01 00:00:00")
    batches.drain(_events(spark, sf_dir), writer, os.path.join(folder, "checkpoint"))
    found = spark.read.parquet(os.path.join(folder, "out", "batches"))
    return found.agg(
        F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"), F.min("lag_seconds").alias("lag_seconds")
    )


QUERIES["stream_freshness"] = _freshness
SQL["stream_freshness"] = """
SELECT count(*) AS rows, 0::BIGINT AS late_rows,
  (floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) - floor(epoch(max(ts))))::BIGINT AS lag_seconds FROM events"""


def _continuous(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    checks = [
        Check("positive", "negative_values", "events", "value"),
        Check("known type", "text_found_in_set_percent", "events", "event_type", {"expected_values": ["click", "view", "error"]}),
    ]
    writer = batches.graded_batches(checks, "events", os.path.join(folder, "out"), executed_at="2024-02-01 00:00:00")
    batches.drain(_events(spark, sf_dir), writer, os.path.join(folder, "checkpoint"))
    found = spark.read.parquet(os.path.join(folder, "out"))
    return found.select("check_id", F.round("actual_value", 6).alias("actual_value"), "severity", "rows_scanned")


QUERIES["stream_continuous_results"] = _continuous
SQL["stream_continuous_results"] = """
SELECT 'positive' AS check_id, count(*) FILTER (WHERE value < 0)::DOUBLE AS actual_value,
  CASE WHEN count(*) FILTER (WHERE value < 0) > 0 THEN 'error' ELSE 'passed' END AS severity, count(*) AS rows_scanned FROM events
UNION ALL SELECT 'known type', round(100.0 * count(*) FILTER (WHERE event_type IN ('click', 'view', 'error')) / count(*), 6),
  CASE WHEN 100.0 * count(*) FILTER (WHERE event_type IN ('click', 'view', 'error')) / count(*) < 95 THEN 'error' ELSE 'passed' END, count(*) FROM events"""


def _incident_state(spark, sf_dir):
    """The results history, arriving as a stream in three pieces; each run goes on where the last one stopped."""
    folder = shared_folder(spark, "stream")
    whole, past = os.path.join(folder, "whole"), os.path.join(folder, "results")
    history.results(spark, sf_dir).write.parquet(whole)
    written = spark.read.parquet(whole)
    for since, until in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-22"), ("2024-01-22", "2030-01-01")):
        part = (F.col("executed_at") >= F.lit(since).cast("timestamp")) & (F.col("executed_at") < F.lit(until).cast("timestamp"))
        written.filter(part).write.mode("append").parquet(past)
        stream = spark.readStream.schema(written.schema).parquet(past)
        batches.drain(stream, incident_batches(os.path.join(folder, "incidents")), os.path.join(folder, "checkpoint"))
    found = current_incidents(spark, os.path.join(folder, "incidents"))
    return _starts(found, "first_failure_at", "last_failure_at", "resolved_at").select(
        "check_id", "status", "severity", "description", "first_failure_at", "last_failure_at", "failure_count", "resolved_at"
    )


def _ts(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


QUERIES["stream_incident_state"] = _incident_state
SQL["stream_incident_state"] = (
    f"WITH {history.INCIDENTS_SQL} SELECT check_id, status, severity, description, {_ts('first_failure_at')}, "
    f"{_ts('last_failure_at')}, failure_count, {_ts('resolved_at')} FROM incidents"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
