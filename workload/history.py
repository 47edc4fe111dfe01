"""Queries over a results history: the checks of every event type, run on every day."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import day_sketches, history, incidents, scoring
from plumbline.operators.measure import Probe, measure
from plumbline.plans.run import Check, run_checks
from plumbline.sources import results as stored
from workload.folders import shared_folder
from workload.tables import load

AS_OF = "2024-01-31 00:30:00"

_CHECKS = [
    Check("mean_in_range", "mean_in_range", "events", "value",
          thresholds={"warning": {"max_value": 48.0}, "error": {"max_value": 50.0}, "fatal": {"max_value": 52.0}}),
    Check("row_count", "row_count", "events", thresholds={"warning": {"min_count": 66}, "error": {"min_count": 55}}),
    Check("distinct_count", "distinct_count", "events", "user_id", thresholds={"error": {"min_count": 50}}),
    Check("nulls_percent", "nulls_percent", "events", "value"),
    Check("number_found_in_set_percent", "number_found_in_set_percent", "events", "user_id",
          {"expected_values": list(range(0, 150, 2))}, {"fatal": {"min_percent": 40}, "error": {"min_percent": 45}}),
]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graded result per event type, check and day, executed half an hour after the day."""
    events = load(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    graded = run_checks(spark, _CHECKS, {"events": events}, by=lambda t: ["event_type", "day"], cascade=True)
    kind = F.get_json_object("partition", "$.event_type")
    return graded.withColumn("day", F.to_date(F.get_json_object("partition", "$.day"))).select(
        F.concat_ws(":", kind, "check_type").alias("check_id"),
        "check_type",
        kind.alias("table_name"),
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 1470 MINUTES")).alias("executed_at"),
        F.round("actual_value", 6).alias("actual_value"),
        "passed",
        "severity",
        F.concat(F.col("check_type"), F.lit(" is "), F.col("severity")).alias("message"),
    )


RESULTS_SQL = """
d AS (
  SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS m, count(*) AS n, count(DISTINCT user_id) AS u,
    100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) AS z,
    100.0 * count(*) FILTER (WHERE user_id % 2 = 0 AND user_id BETWEEN 0 AND 148) / count(*) AS e
  FROM events GROUP BY 1, 2),
graded AS (
  SELECT event_type, day, 'mean_in_range' AS check_type, m AS v,
    CASE WHEN m > 52 THEN 'fatal' WHEN m > 50 THEN 'error' WHEN m > 48 THEN 'warning' ELSE 'passed' END AS severity FROM d
  UNION ALL SELECT event_type, day, 'row_count', n, CASE WHEN n < 55 THEN 'error' WHEN n < 66 THEN 'warning' ELSE 'passed' END FROM d
  UNION ALL SELECT event_type, day, 'distinct_count', u, CASE WHEN u < 50 THEN 'error' ELSE 'passed' END FROM d
  UNION ALL SELECT event_type, day, 'nulls_percent', z, CASE WHEN z > 5 THEN 'error' ELSE 'passed' END FROM d
  UNION ALL SELECT event_type, day, 'number_found_in_set_percent', e,
    CASE WHEN e < 40 THEN 'fatal' WHEN e < 45 THEN 'error' ELSE 'passed' END FROM d),
results AS (
  SELECT event_type || ':' || check_type AS check_id, check_type, event_type AS table_name,
    CAST(day AS TIMESTAMP) + INTERVAL 1470 MINUTE AS executed_at, round(CAST(v AS DOUBLE), 6) AS actual_value,
    severity = 'passed' AS passed, severity, check_type || ' is ' || severity AS message,
    CASE check_type WHEN 'mean_in_range' THEN 'conformity' WHEN 'row_count' THEN 'coverage'
      WHEN 'distinct_count' THEN 'uniqueness' WHEN 'nulls_percent' THEN 'completeness' ELSE 'validity' END AS dimension
  FROM graded)
"""


def checks(history_: DataFrame) -> DataFrame:
    """The checks behind a history; the signup checks are switched off, one more never ran."""
    known = history_.groupBy("check_id", "check_type", "table_name").agg(F.lit(1)).select(
        "check_id", "check_type", "table_name", (F.col("table_name") != "signup").alias("is_active")
    )
    never = known.filter("check_type = 'row_count'").select(
        F.concat("table_name", F.lit(":data_freshness")).alias("check_id"),
        F.lit("data_freshness").alias("check_type"),
        "table_name",
        "is_active",
    )
    return known.unionByName(never)


CHECKS_SQL = RESULTS_SQL + """,
checks AS (
  SELECT DISTINCT check_id, check_type, table_name, table_name <> 'signup' AS is_active, dimension FROM results
  UNION ALL SELECT DISTINCT table_name || ':data_freshness', 'data_freshness', table_name, table_name <> 'signup', 'timeliness'
  FROM results),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY executed_at DESC) AS nth FROM results) WHERE nth = 1)
"""
_SCORE = """round_even(greatest(0.0, 100.0 * (1.0 - (1.0 * w + 2.5 * e + 5.0 * f) / (5.0 * (p + w + e + f)))), 1)"""
_COUNTS = (
    "count(*) FILTER (WHERE severity = 'passed') AS p, count(*) FILTER (WHERE severity = 'warning') AS w, "
    "count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'fatal') AS f"
)
SCORES_SQL = CHECKS_SQL + f""",
counted AS (
  SELECT c.dimension, count(*) AS checks, count(*) FILTER (WHERE l.check_id IS NULL) AS not_run, {_COUNTS}
  FROM checks c LEFT JOIN latest l ON c.check_id = l.check_id WHERE c.is_active GROUP BY 1),
dims AS (SELECT unnest(['accuracy', 'completeness', 'conformity', 'consistency', 'coverage', 'timeliness', 'validity', 'uniqueness']) AS dimension),
scores AS (
  SELECT d.dimension, coalesce(checks, 0) AS checks, coalesce(not_run, 0) AS not_run, coalesce(p, 0) AS passed,
    coalesce(w, 0) AS warning, coalesce(e, 0) AS error, coalesce(f, 0) AS fatal,
    CASE WHEN p + w + e + f > 0 THEN {_SCORE} END AS score
  FROM dims d LEFT JOIN counted c ON d.dimension = c.dimension)
"""


def _timestamps(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd HH:mm:ss"))
    return df


def _ts(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@_query(f"WITH {RESULTS_SQL} SELECT check_id, {_ts('executed_at')}, actual_value, passed, severity FROM results")
def results_history(spark, sf_dir):
    """The whole history, graded."""
    return _timestamps(results(spark, sf_dir), "executed_at").select(
        "check_id", "executed_at", "actual_value", "passed", "severity"
    )


@_query(f"WITH {CHECKS_SQL} SELECT check_id, {_ts('executed_at')}, actual_value, severity FROM latest")
def latest_result_per_check(spark, sf_dir):
    return _timestamps(history.latest(results(spark, sf_dir), ["check_id"]), "executed_at").select(
        "check_id", "executed_at", "actual_value", "severity"
    )


def _earlier(days: int):
    def run(spark, sf_dir):
        past = results(spark, sf_dir)
        now = past.select("check_id", "executed_at", "actual_value")
        compared = history.with_earlier(now, past, ["check_id"], days)
        change = history.percent_change(F.col("actual_value"), F.col("earlier_value"), False)
        return _timestamps(compared, "executed_at").select(
            "check_id", "executed_at", "actual_value", "earlier_value", F.round(change, 6).alias("change_percent")
        )

    return run


for _days in (1, 7, 30):
    QUERIES[f"change_against_{_days}_days_before"] = _earlier(_days)
    SQL[f"change_against_{_days}_days_before"] = f"""
WITH {RESULTS_SQL}, r AS (SELECT * FROM results),
j AS (SELECT a.check_id, a.executed_at, a.actual_value, max_by(b.actual_value, b.executed_at) AS earlier_value
  FROM r a LEFT JOIN r b ON a.check_id = b.check_id AND b.executed_at >= a.executed_at - INTERVAL {_days} DAY
    AND b.executed_at < a.executed_at - INTERVAL {_days} DAY + INTERVAL 1 HOUR GROUP BY 1, 2, 3)
SELECT check_id, {_ts('executed_at')}, actual_value, earlier_value,
  round((actual_value - earlier_value) / nullif(earlier_value, 0) * 100, 6) AS change_percent FROM j"""


@_query(f"""
WITH {RESULTS_SQL}, h AS (SELECT check_id, list_sort(list(actual_value)) AS r FROM results
  WHERE executed_at < TIMESTAMP '{AS_OF}' GROUP BY 1),
q AS (SELECT check_id, len(r) AS history_count, r[len(r) // 4 + 1] AS q1, r[(3 * len(r)) // 4 + 1] AS q3 FROM h)
SELECT check_id, history_count::INT AS history_count, q1, q3, round(q1 - 1.5 * (q3 - q1), 6) AS fence_low, round(q3 + 1.5 * (q3 - q1), 6) AS fence_high FROM q""")
def anomaly_fences(spark, sf_dir):
    fences = history.anomaly_fence(results(spark, sf_dir), ["check_id"], AS_OF)
    return fences.withColumn("fence_low", F.round("fence_low", 6)).withColumn("fence_high", F.round("fence_high", 6))


@_query(f"""WITH {RESULTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY check_id, date_trunc('month', executed_at) ORDER BY executed_at DESC) AS nth FROM results)
SELECT check_id, strftime(date_trunc('month', executed_at), '%Y-%m-%d') AS bucket, {_ts('executed_at')}, actual_value FROM b WHERE nth = 1""")
def newest_result_per_month(spark, sf_dir):
    kept = history.newest_per_bucket(results(spark, sf_dir), ["check_id"], "month")
    return _timestamps(kept, "executed_at").select(
        "check_id", F.col("bucket").cast("string").alias("bucket"), "executed_at", "actual_value"
    )


@_query(f"""WITH {RESULTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY check_id, date_trunc('month', executed_at) ORDER BY executed_at DESC) AS nth FROM results)
SELECT check_id, strftime(date_trunc('month', executed_at), '%Y-%m-%d') AS bucket, {_ts('executed_at')}, actual_value FROM b WHERE nth = 1""")
def results_stored_once_per_month(spark, sf_dir):
    """Runs up to the 20th of January, then all, then all of them repeated: one stored row per check and month."""
    folder = shared_folder(spark, "results")
    past = results(spark, sf_dir)
    early = past.filter(F.col("executed_at") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    for run in (early, past, past):
        stored.store_per_bucket(run, folder, "month", ("check_id",))
    return _timestamps(stored.read_buckets(spark, folder), "executed_at").select(
        "check_id", F.col("bucket").cast("string").alias("bucket"), "executed_at", "actual_value"
    )


_SKETCHED = {"events": ("ts", ["event_id", "user_id", "event_type", "value", "props"]),
             "orders": ("o_orderdate", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])}


def _stored_days(spark, sf_dir) -> DataFrame:
    folder = shared_folder(spark, "sketches")
    parts = [
        day_sketches.day_sketches(load(spark, sf_dir, name), name, F.col(day), columns)
        for name, (day, columns) in _SKETCHED.items()
    ]
    stored.store_days(reduce(DataFrame.unionByName, parts), folder)
    return spark.read.parquet(folder)


def _exact_sql(scale: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, strftime(date_trunc('{scale}', {day}), '%Y-%m-%d') AS stretch, "
        f"count(*) AS n_rows, (count(*) - count({c}))::BIGINT AS nulls, count(DISTINCT {c}) AS distinct_exact, true AS within_bound "
        f"FROM {t} GROUP BY date_trunc('{scale}', {day})"
        for t, (day, columns) in _SKETCHED.items() for c in columns
    )


def _distinct_over(scale: str):
    def run(spark, sf_dir):
        """Estimates from the stored days next to exact counts: within six standard errors and one."""
        stretch = F.date_format(F.date_trunc(scale, F.col("day")), "yyyy-MM-dd")
        estimated = day_sketches.distinct_over(_stored_days(spark, sf_dir), stretch).alias("e")
        exact = []
        for name, (day, columns) in _SKETCHED.items():
            df = load(spark, sf_dir, name).withColumn("_stretch", F.date_format(F.date_trunc(scale, F.col(day)), "yyyy-MM-dd"))
            probes = [Probe(c, "distinct_count", c) for c in columns]
            exact.append(measure(df, probes, by=["_stretch"]).withColumn("table_name", F.lit(name)))
        x = reduce(DataFrame.unionByName, exact).alias("x")
        same = (
            (F.col("e.table_name") == F.col("x.table_name"))
            & (F.col("e.column_name") == F.col("x.probe_id"))
            & F.col("e.stretch").eqNullSafe(F.col("x._stretch"))
        )
        off = F.abs(F.col("distinct_estimate") - F.col("sensor_value"))
        return estimated.join(x, same).select(
            "e.table_name", "column_name", "stretch", F.col("rows").alias("n_rows"), "nulls",
            F.col("sensor_value").cast("long").alias("distinct_exact"),
            (off <= 1 + 6 * F.col("standard_error")).alias("within_bound"),
        )

    return run


for _scale in ("day", "month"):
    QUERIES[f"distinct_values_per_{_scale}_from_stored_days"] = _distinct_over(_scale)
    SQL[f"distinct_values_per_{_scale}_from_stored_days"] = _exact_sql(_scale)


@_query(f"""WITH {RESULTS_SQL}
SELECT DISTINCT event_type AS table_name, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events
WHERE (event_type, CAST(ts AS DATE)) NOT IN (SELECT table_name, CAST(executed_at - INTERVAL 1470 MINUTE AS DATE) FROM results
  WHERE executed_at < TIMESTAMP '2024-01-20 00:00:00')""")
def partitions_without_a_result(spark, sf_dir):
    done = results(spark, sf_dir).filter(F.col("executed_at") < F.lit("2024-01-20 00:00:00").cast("timestamp")).select(
        "table_name", F.to_date(F.col("executed_at") - F.expr("INTERVAL 1470 MINUTES")).alias("day")
    )
    partitions = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("table_name"), F.col("ts").cast("date").alias("day")
    ).distinct()
    todo = history.unchecked_partitions(partitions, done, ["table_name", "day"])
    return todo.select("table_name", F.col("day").cast("string").alias("day"))


@_query(f"WITH {SCORES_SQL} SELECT *, CASE WHEN score IS NULL THEN 'not_assessed' WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'amber' ELSE 'red' END AS status FROM scores")
def dimension_scores(spark, sf_dir):
    past = results(spark, sf_dir)
    return scoring.dimension_scores(checks(past), past)


@_query(f"WITH {SCORES_SQL} SELECT round_even(avg(score), 1) AS overall_score, count(score) AS assessed_dimensions FROM scores")
def overall_score(spark, sf_dir):
    past = results(spark, sf_dir)
    return scoring.overall_score(scoring.dimension_scores(checks(past), past))


_TREND_SQL = f"""
WITH {CHECKS_SQL}, t AS (SELECT c.dimension, CAST(r.executed_at AS DATE) AS day, {_COUNTS.replace('severity', 'r.severity')}
  FROM results r JOIN checks c ON r.check_id = c.check_id
  WHERE c.is_active AND r.executed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1, 2)
SELECT dimension, strftime(day, '%Y-%m-%d') AS day, {_SCORE} AS score FROM t"""


@_query(_TREND_SQL)
def trend_of_all_dimensions(spark, sf_dir):
    past = results(spark, sf_dir)
    trend = scoring.daily_trend(checks(past), past, AS_OF, 14)
    return trend.withColumn("day", F.col("day").cast("string"))


@_query(_TREND_SQL + " WHERE dimension = 'conformity'")
def trend_of_one_dimension(spark, sf_dir):
    past = results(spark, sf_dir)
    trend = scoring.daily_trend(checks(past), past, AS_OF, 14, "conformity")
    return trend.withColumn("day", F.col("day").cast("string"))


@_query(f"WITH {CHECKS_SQL} SELECT c.check_id, l.passed, l.severity, strftime(l.executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at FROM checks c LEFT JOIN latest l ON c.check_id = l.check_id WHERE c.is_active AND c.dimension = 'coverage'")
def checks_of_a_dimension(spark, sf_dir):
    past = results(spark, sf_dir)
    return _timestamps(scoring.checks_of(checks(past), past, "coverage"), "executed_at").select(
        "check_id", "passed", "severity", "executed_at"
    )


@_query(f"WITH {CHECKS_SQL} SELECT count(*) FILTER (WHERE l.check_id IS NULL) AS not_run, count(*) AS checks FROM checks c LEFT JOIN latest l ON c.check_id = l.check_id WHERE c.is_active")
def checks_never_run(spark, sf_dir):
    past = results(spark, sf_dir)
    current = scoring.latest_of_checks(checks(past), past)
    return current.agg(F.count_if(F.col("executed_at").isNull()).alias("not_run"), F.count(F.lit(1)).alias("checks"))


@_query(f"WITH {CHECKS_SQL} SELECT c.check_id, c.table_name, c.check_type, strftime(l.executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at, l.passed, l.actual_value FROM checks c LEFT JOIN latest l ON c.check_id = l.check_id WHERE c.is_active")
def active_checks_with_latest_result(spark, sf_dir):
    past = results(spark, sf_dir)
    current = scoring.latest_of_checks(checks(past), past)
    return _timestamps(current, "executed_at").select(
        "check_id", "table_name", "check_type", "executed_at", "passed", "actual_value"
    )


@_query(f"""WITH {RESULTS_SQL} SELECT check_id, {_ts('executed_at')}, severity FROM
(SELECT * FROM results WHERE NOT passed AND table_name = 'click' AND executed_at >= TIMESTAMP '2024-01-10 00:00:00'
 AND executed_at <= TIMESTAMP '2024-01-28 00:00:00' ORDER BY executed_at DESC, check_id LIMIT 10 OFFSET 10)""")
def second_page_of_failures(spark, sf_dir):
    found = scoring.find_results(
        results(spark, sf_dir), table_name="click", passed=False, since="2024-01-10 00:00:00", until="2024-01-28 00:00:00"
    )
    return _timestamps(scoring.page_of(found, 2, 10), "executed_at").select("check_id", "executed_at", "severity")


@_query(f"""WITH {RESULTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed_count,
count(*) FILTER (WHERE NOT passed) AS failed_count, count(*) FILTER (WHERE severity = 'passed') AS passed_results,
count(*) FILTER (WHERE severity = 'warning') AS warning_results, count(*) FILTER (WHERE severity = 'error') AS error_results,
count(*) FILTER (WHERE severity = 'fatal') AS fatal_results, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate FROM results""")
def result_summary(spark, sf_dir):
    return scoring.summary(results(spark, sf_dir)).drop("mean_time_ms").withColumn("pass_rate", F.round("pass_rate", 6))


_PASS_RATE = "count(*) AS total_runs, count(*) FILTER (WHERE passed) AS passed_runs, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 1) AS pass_rate"


@_query(f"WITH {RESULTS_SQL} SELECT table_name, {_PASS_RATE} FROM results WHERE executed_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1")
def pass_rate_per_table_last_week(spark, sf_dir):
    return scoring.pass_rate_by(results(spark, sf_dir), ["table_name"], as_of=AS_OF, days=7)


@_query(f"WITH {RESULTS_SQL} SELECT check_type, {_PASS_RATE} FROM results GROUP BY 1")
def quality_score_per_check_type(spark, sf_dir):
    return scoring.pass_rate_by(results(spark, sf_dir), ["check_type"])


INCIDENTS_SQL = RESULTS_SQL + """,
n AS (SELECT *, sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY check_id ORDER BY executed_at) - CASE WHEN passed THEN 1 ELSE 0 END AS i FROM results),
incidents AS (SELECT check_id, check_id || '/' || strftime(min(executed_at) FILTER (WHERE NOT passed), '%Y-%m-%d %H:%M:%S') AS incident_id,
  CASE WHEN count(*) FILTER (WHERE passed) = 0 THEN 'open' ELSE 'resolved' END AS status,
  CASE min_by(severity, executed_at) FILTER (WHERE NOT passed) WHEN 'warning' THEN 'low' WHEN 'fatal' THEN 'high' ELSE 'medium' END AS severity,
  max_by(message, executed_at) FILTER (WHERE NOT passed) AS description,
  min(executed_at) FILTER (WHERE NOT passed) AS first_failure_at, max(executed_at) FILTER (WHERE NOT passed) AS last_failure_at,
  count(*) FILTER (WHERE NOT passed) AS failure_count, min(executed_at) FILTER (WHERE passed) AS resolved_at
  FROM n GROUP BY check_id, i HAVING count(*) FILTER (WHERE NOT passed) > 0)
"""


@_query(f"WITH {INCIDENTS_SQL} SELECT check_id, incident_id, status, severity, description, {_ts('first_failure_at')}, {_ts('last_failure_at')}, failure_count, {_ts('resolved_at')} FROM incidents")
def incidents_of_the_history(spark, sf_dir):
    folded = incidents.fold(results(spark, sf_dir))
    return _timestamps(folded, "first_failure_at", "last_failure_at", "resolved_at").drop("title")


@_query(f"WITH {INCIDENTS_SQL} SELECT incident_id, i.severity, failure_count, table_name, check_type FROM incidents i JOIN (SELECT DISTINCT check_id, table_name, check_type FROM results) c ON i.check_id = c.check_id WHERE status = 'open'")
def open_incidents_with_checks(spark, sf_dir):
    past = results(spark, sf_dir)
    found = incidents.open_incidents(incidents.fold(past), checks(past))
    return found.select("incident_id", "severity", "failure_count", "table_name", "check_type")


@_query(f"WITH {INCIDENTS_SQL} SELECT incident_id, failure_count FROM incidents WHERE status = 'resolved' AND severity = 'high'")
def resolved_incidents_of_high_severity(spark, sf_dir):
    found = incidents.find_incidents(incidents.fold(results(spark, sf_dir)), status="resolved", severity="high")
    return found.select("incident_id", "failure_count")


@_query(f"""WITH {INCIDENTS_SQL}, o AS (SELECT *, CASE status WHEN 'open' THEN 'incident.opened' ELSE 'incident.resolved' END AS event FROM incidents),
ch AS (SELECT * FROM (VALUES ('all', ['incident.opened', 'incident.resolved'], 0), ('grave', ['incident.resolved'], 3), ('medium', ['incident.opened'], 2)) v(channel_id, events, least))
SELECT channel_id, incident_id, event FROM o JOIN ch ON list_contains(events, event) AND CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END >= least""")
def alerts_to_send(spark, sf_dir):
    folded = incidents.fold(results(spark, sf_dir)).withColumn(
        "event", F.when(F.col("status") == "open", "incident.opened").otherwise("incident.resolved")
    )
    channels = spark.createDataFrame(
        [
            ("all", ["incident.opened", "incident.resolved"], None, True),
            ("grave", ["incident.resolved"], "fatal", True),
            ("medium", ["incident.opened"], "error", True),
            ("off", ["incident.opened"], None, False),
        ],
        "channel_id string, events array<string>, min_severity string, is_active boolean",
    )
    return incidents.alerts(folded, channels).select("channel_id", "incident_id", "event")


@_query("""WITH c AS (SELECT user_id AS incident_id, ts AS changed_at, CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'resolved' ELSE 'open' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY incident_id ORDER BY changed_at) AS from_status FROM c)
SELECT CAST(incident_id AS VARCHAR) AS incident_id, from_status, status, count(*) AS n FROM p
WHERE NOT coalesce((from_status IS NULL AND status = 'open') OR (from_status || '>' || status) IN
 ('open>acknowledged', 'open>resolved', 'acknowledged>resolved', 'acknowledged>open', 'resolved>open'), false) GROUP BY 1, 2, 3""")
def illegal_status_moves(spark, sf_dir):
    changes = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("incident_id"),
        F.col("ts").alias("changed_at"),
        F.when(F.col("event_type") == "click", "acknowledged")
        .when(F.col("event_type") == "view", "resolved")
        .otherwise("open")
        .alias("status"),
    )
    return incidents.illegal_moves(changes).groupBy("incident_id", "from_status", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
