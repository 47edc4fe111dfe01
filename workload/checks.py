"""Every check type, run in one suite per table and graded."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import rules
from plumbline.operators.checks import CHECKS, CheckType
from plumbline.operators.measure import Probe, measure
from plumbline.operators.rules import SEVERITIES
from plumbline.operators.sensors import SENSORS
from plumbline.plans.run import Check, preview, run_checks
from plumbline.sources.results import append_results, read_results, run_and_append
from workload.sensor_cases import CASES, DAY, DAY_AS_OF, pct
from workload.sensors import daily_readings
from workload.folders import shared_folder
from workload.tables import load, relation

_NOW = "2024-02-01 00:00:00"

# Thresholds for checks that have no default, and some that show severities.
_THRESHOLDS = {
    "row_count": {"warning": {"min_count": 1}, "fatal": {"min_count": 1000}},
    "row_count_change": {"error": {"max_change_percent": 25}},
    "column_count": {"error": {"min_count": 4, "max_count": 6}},
    "column_count_changed": {"error": {"forbidden_value": 5}},
    "sql_aggregate_expression_on_table": {"error": {"max_value": 100000}},
    "distinct_count": {"warning": {"min_count": 5000}},
    "distinct_percent": {"error": {"min_percent": 5, "max_percent": 50}},
    "duplicate_percent": {"error": {"max_percent": 10}},
    "min_in_range": {"error": {"min_value": 0}},
    "max_in_range": {"error": {"max_value": 100000}},
    "sum_in_range": {"error": {"min_value": 1, "max_value": 1000}},
    "mean_in_range": {"warning": {"min_value": 25, "max_value": 26}},
    "median_in_range": {"error": {"min_value": 200000, "max_value": 300000}},
    "number_below_min_value": {"error": {"min_value": 900}},
    "number_above_max_value": {"fatal": {"max_value": 5000}},
    "text_min_length": {"error": {"min_value": 1}},
    "text_max_length": {"error": {"max_value": 1000}},
    "text_mean_length": {"error": {"min_value": 100, "max_value": 100000}},
    "min_word_count": {"error": {"min_value": 1}},
    "max_word_count": {"error": {"max_value": 10}},
    "sample_stddev_in_range": {"error": {"max_value": 20}},
    "population_stddev_in_range": {"error": {"max_value": 2}},
    "sample_variance_in_range": {"error": {"max_value": 500}},
    "population_variance_in_range": {"error": {"max_value": 5}},
    "percentile_in_range": {"error": {"min_value": 0}},
    "percentile_10_in_range": {"error": {"max_value": 20000}},
    "percentile_25_in_range": {"error": {"max_value": 20000}},
    "percentile_75_in_range": {"error": {"min_value": 70000}},
    "percentile_90_in_range": {"error": {"min_value": 100000}},
    "true_percent": {"error": {"min_percent": 10, "max_percent": 30}},
    "false_percent": {"error": {"min_percent": 80}},
    "sql_aggregate_expression_on_column": {"error": {"min_value": 1}},
    "import_custom_result_on_table": {"error": {"min_value": 95, "max_value": 100}},
    "import_custom_result_on_column": {"error": {"max_value": 2}},
    "detected_datatype_in_text": {"error": {"expected_value": 1}},
}

_MATCHES = {n for n, c in CHECKS.items() if n.endswith("_match") and c.category == "comparison"}
_ANOMALIES = {n for n, c in CHECKS.items() if c.category == "anomaly"}
_EARLIER = {n for n, c in CHECKS.items() if SENSORS[c.sensor].family == "history"}


def _suites() -> dict[str, list[CheckType]]:
    """Check types by the table their sensor's case is about."""
    found = defaultdict(list)
    for name, kind in CHECKS.items():
        if name in _MATCHES | _ANOMALIES | _EARLIER | {"reload_lag"}:
            continue
        found[CASES[kind.sensor].table].append(kind)
    return found


def _check(kind: CheckType, where: str | None = None) -> Check:
    case = CASES[kind.sensor]
    return Check(kind.name, kind.name, case.table, case.column, case.params, _THRESHOLDS.get(kind.name, {}), where)


def _shown(results: DataFrame) -> DataFrame:
    return results.select(
        "check_type", "dimension", F.round("actual_value", 6).alias("actual_value"), "passed", "severity"
    )


def _suite(table: str, kinds: list[CheckType]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checks = [_check(k) for k in kinds]
        names = {table} | {c.params["reference_table"] for c in checks if "reference_table" in c.params}
        tables = {n: load(spark, sf_dir, n) for n in names}
        return _shown(run_checks(spark, checks, tables, executed_at=_NOW))

    return run


def _limit(kind: CheckType) -> tuple[str, dict[str, float]]:
    """The deciding severity and its limits: most severe one first, defaults below."""
    own = _THRESHOLDS.get(kind.name, {"error": {}})
    severity = next(s for s in SEVERITIES if s in own)
    return severity, {**kind.thresholds, **own[severity]}


def rule_sql(rule: str, t: dict[str, float], v: str = "v") -> str:
    """Whether a reading passes, in SQL."""

    def band(low: str, high: str) -> str:
        parts = [f"{v} IS NOT NULL"]
        if low in t:
            parts.append(f"{v} >= {t[low]}")
        if high in t:
            parts.append(f"{v} <= {t[high]}")
        return " AND ".join(parts)

    def one(name: str, op: str) -> str:
        return f"{v} {op} {t[name]}" if name in t else "false"

    text = {
        "min_value": lambda: one("min_value", ">="),
        "max_value": lambda: one("max_value", "<="),
        "min_max_value": lambda: band("min_value", "max_value"),
        "min_percent": lambda: one("min_percent", ">="),
        "max_percent": lambda: one("max_percent", "<="),
        "min_max_percent": lambda: band("min_percent", "max_percent"),
        "max_change_percent": lambda: f"abs({v}) <= {t['max_change_percent']}" if "max_change_percent" in t else "false",
        "min_count": lambda: one("min_count", ">="),
        "max_count": lambda: one("max_count", "<="),
        "min_max_count": lambda: band("min_count", "max_count"),
        "equal_to": lambda: one("expected_value", "="),
        "not_equal_to": lambda: f"coalesce({v} <> {t['forbidden_value']}, true)" if "forbidden_value" in t else "true",
        "is_true": lambda: f"{v} <> 0",
        "is_false": lambda: f"coalesce({v} = 0, true)",
    }
    return f"coalesce({text[rule]()}, false)"


def _graded_sql(kind: CheckType, scalar: str) -> str:
    severity, limits = _limit(kind)
    passed = rule_sql(kind.rule, limits)
    dimension = f"'{kind.dimension}'" if kind.dimension else "NULL"
    return (
        f"SELECT '{kind.name}' AS check_type, {dimension} AS dimension, round(CAST(v AS DOUBLE), 6) AS actual_value, "
        f"{passed} AS passed, CASE WHEN {passed} THEN 'passed' ELSE '{severity}' END AS severity FROM ({scalar})"
    )


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 checks against the reading of 1, 7 and 30 days before."""
    orders = load(spark, sf_dir, "orders")
    where = f"CAST(o_orderdate AS DATE) = DATE'{DAY}'"
    checks = [_check(CHECKS[n], where) for n in sorted(_EARLIER)]
    return _shown(
        run_checks(spark, checks, {"orders": orders}, readings=daily_readings(orders), executed_at=DAY_AS_OF)
    )


_ANOMALY_COLUMN = {
    "row_count_anomaly": None,
    "data_freshness_anomaly": "o_orderdate",
    "nulls_percent_anomaly": "o_custkey",
    "distinct_count_anomaly": "o_custkey",
    "distinct_percent_anomaly": "o_custkey",
}
_ANOMALY_AT = "1998-08-03 02:00:00"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks against a metric's own last 90 days."""
    orders = load(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    columns = {n: _ANOMALY_COLUMN.get(n, "o_totalprice") for n in sorted(_ANOMALIES)}
    past = measure(
        orders,
        [Probe(n, CHECKS[n].sensor, c, {"as_of": _ANOMALY_AT}) for n, c in columns.items()],
        by=["day"],
    ).select(
        F.col("probe_id").alias("check_id"),
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 25 HOURS")).alias("executed_at"),
        F.col("sensor_value").alias("actual_value"),
    )
    checks = [
        Check(n, n, "orders", c, {"as_of": _ANOMALY_AT}, where=f"day = DATE'{DAY}'") for n, c in columns.items()
    ]
    return _shown(run_checks(spark, checks, {"orders": orders}, results=past, executed_at=_ANOMALY_AT))


_ANOMALY_SQL = {
    "row_count": "count(*)",
    "data_freshness": f"floor(epoch(TIMESTAMP '{_ANOMALY_AT}')) - floor(epoch(max(o_orderdate)))",
    "nulls_percent": pct("o_custkey IS NULL", 0),
    "distinct_count": "count(DISTINCT o_custkey)",
    "distinct_percent": "CASE WHEN count(o_custkey) = 0 THEN 0.0 ELSE 100.0 * count(DISTINCT o_custkey) / count(o_custkey) END",
    "sum": "sum(o_totalprice)",
    "mean": "avg(o_totalprice)",
    "median": "quantile_cont(o_totalprice, 0.5)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
}


def _anomaly_sql() -> str:
    parts, now = [], []
    for metric, expression in _ANOMALY_SQL.items():
        parts.append(
            f"SELECT '{metric}_anomaly' AS check_type, CAST(o_orderdate AS DATE) AS day, CAST({expression} AS DOUBLE) AS v "
            "FROM orders GROUP BY 2"
        )
        now.append(
            f"SELECT '{metric}_anomaly' AS check_type, CAST({expression} AS DOUBLE) AS v FROM orders "
            f"WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'"
        )
    return f"""
WITH readings AS ({' UNION ALL '.join(parts)}),
now AS ({' UNION ALL '.join(now)}),
past AS (
  SELECT check_type, list_sort(list(v)) AS r FROM readings
  WHERE day BETWEEN DATE '1998-05-05' AND DATE '{DAY}' AND v IS NOT NULL GROUP BY 1),
fence AS (
  SELECT check_type, len(r) AS n, r[len(r) // 4 + 1] AS q1, r[(3 * len(r)) // 4 + 1] AS q3 FROM past),
graded AS (
  SELECT c.check_type, c.v,
    coalesce(n, 0) < 7 OR coalesce(c.v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false) AS passed
  FROM now c LEFT JOIN fence f ON c.check_type = f.check_type)
SELECT check_type, CAST(NULL AS VARCHAR) AS dimension, round(v, 6) AS actual_value, passed,
  CASE WHEN passed THEN 'passed' ELSE 'error' END AS severity FROM graded"""


_MATCH_COLUMN = {"row_count_match": None, "column_count_match": None}


def _match_checks() -> list[Check]:
    return [
        Check(n, n, "orders", _MATCH_COLUMN.get(n, "o_totalprice"), {"reference_table": "finished_orders"},
              {"error": {"min_percent": 33}} if n == "row_count_match" else {})
        for n in sorted(_MATCHES)
    ]


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks that run one sensor on two sources."""
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "finished_orders")}
    return _shown(run_checks(spark, _match_checks(), tables, executed_at=_NOW))


_MATCH_SQL = {
    "row_count_match": "count(*)",
    "column_count_match": "6 + 0 * count(*)",
    "sum_match": "sum(o_totalprice)",
    "min_match": "min(o_totalprice)",
    "max_match": "max(o_totalprice)",
    "mean_match": "avg(o_totalprice)",
    "not_null_count_match": "count(o_totalprice)",
    "null_count_match": "count(*) FILTER (WHERE o_totalprice IS NULL)",
    "distinct_count_match": "count(DISTINCT o_totalprice)",
}


def _match_sql() -> str:
    parts = []
    for name, expression in _MATCH_SQL.items():
        least = 33 if name == "row_count_match" else 100
        pair = f"(SELECT CAST({expression} AS DOUBLE) AS a FROM orders), (SELECT CAST({expression} AS DOUBLE) AS b FROM {relation('finished_orders')})"
        parts.append(
            f"SELECT '{name}' AS check_type, 'accuracy' AS dimension, round(v, 6) AS actual_value, "
            f"coalesce(v >= {least}, false) AS passed, CASE WHEN coalesce(v >= {least}, false) THEN 'passed' ELSE 'error' END AS severity "
            f"FROM (SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(abs(a), abs(b)) = 0 THEN 100.0 "
            f"ELSE least(abs(a), abs(b)) / greatest(abs(a), abs(b)) * 100 END AS v FROM {pair})"
        )
    return " UNION ALL ".join(parts)


def _matches_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared under a filter that holds for both; row counts come from the first."""
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "finished_orders")}
    checks = [
        Check(n, n, "orders", _MATCH_COLUMN.get(n, "o_totalprice"), {"reference_table": "finished_orders"}, {},
              "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
        for n in ("row_count_match", "sum_match", "distinct_count_match")
    ]
    return _shown_with_rows(run_checks(spark, checks, tables, executed_at=_NOW))


def _matches_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared per order priority and state."""
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "finished_orders")}
    checks = [
        Check(n, n, "orders", _MATCH_COLUMN.get(n, "o_totalprice"), {"reference_table": "finished_orders"})
        for n in ("row_count_match", "sum_match", "distinct_count_match")
    ]
    by = ["o_orderpriority", "o_orderstatus"]
    return _shown_with_rows(run_checks(spark, checks, tables, by=lambda table: by, executed_at=_NOW))


def _shown_with_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "check_type",
        F.get_json_object("partition", "$.o_orderpriority").alias("priority"),
        F.get_json_object("partition", "$.o_orderstatus").alias("status"),
        F.round("actual_value", 6).alias("actual_value"),
        "passed",
        "rows_scanned",
    )


def _match_rows_sql(where: str, by: list[str]) -> str:
    """The three agreements under a filter, per group."""
    keys = "".join(f"{k}, " for k in by)
    grouped = f" GROUP BY {', '.join(by)}" if by else ""
    side = (
        f"SELECT {keys}count(*) AS n, CAST(count(*) AS DOUBLE) AS row_count_match, sum(o_totalprice) AS sum_match, "
        f"CAST(count(DISTINCT o_totalprice) AS DOUBLE) AS distinct_count_match FROM {{}} WHERE {where}{grouped}"
    )
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in by) or "true"
    shown = [f"coalesce(a.{k}, b.{k})" for k in by] or ["CAST(NULL AS VARCHAR)"] * 2
    parts = []
    for name in ("row_count_match", "sum_match", "distinct_count_match"):
        a, b = f"a.{name}", f"b.{name}"
        parts.append(
            f"SELECT '{name}' AS check_type, {shown[0]} AS priority, {shown[1]} AS status, a.n AS rows_scanned, "
            f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN greatest(abs({a}), abs({b})) = 0 THEN 100.0 "
            f"ELSE least(abs({a}), abs({b})) / greatest(abs({a}), abs({b})) * 100 END AS v FROM a FULL JOIN b ON {same}"
        )
    return (
        f"WITH a AS ({side.format('orders')}), b AS ({side.format(relation('finished_orders'))}) "
        f"SELECT check_type, priority, status, round(v, 6) AS actual_value, coalesce(v >= 100, false) AS passed, rows_scanned "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and expectations in one run; a statement about an unknown column is refused alone."""
    checks = [
        Check("rows", "row_count_min", "orders", None, {"min_value": 10_000_000}, {"fatal": {}}),
        Check("unique", "unique", "orders", "o_orderkey"),
        Check("share", "uniqueness_percent", "orders", "o_custkey", {"min_value": 0.9}, where="o_orderstatus = 'F'"),
        Check("median", "column_median", "orders", "o_totalprice", {"min_value": 200000, "max_value": 300000}),
        Check("nulls", "nulls_percent", "orders", "o_custkey"),
        Check("unknown", "not_null", "orders", "no_such"),
    ]
    return run_checks(spark, checks, {"orders": load(spark, sf_dir, "orders")}, executed_at=_NOW).select(
        "check_id", "dimension", F.round("actual_value", 6).alias("actual_value"), "passed", "severity", "rows_scanned",
        F.col("error_message").isNotNull().alias("refused"),
    )


_MIXED_SQL = """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
  (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS d,
  count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') / CAST(count(o_custkey) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS u,
  quantile_cont(o_totalprice, 0.5) AS m, 100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / count(*) AS z FROM orders),
r AS (
  SELECT 'rows' AS check_id, 'coverage' AS dimension, n::DOUBLE AS v, n >= 10000000 AS passed, 'fatal' AS broken, n AS rows_scanned FROM o
  UNION ALL SELECT 'unique', 'uniqueness', d, d = 0, 'error', n FROM o
  UNION ALL SELECT 'share', 'uniqueness', u, u >= 0.9, 'error', f FROM o
  UNION ALL SELECT 'median', 'conformity', m, m BETWEEN 200000 AND 300000, 'error', n FROM o
  UNION ALL SELECT 'nulls', 'completeness', z, z <= 5, 'error', n FROM o)
SELECT check_id, dimension, round(v, 6) AS actual_value, passed, CASE WHEN passed THEN 'passed' ELSE broken END AS severity, rows_scanned, false AS refused FROM r
UNION ALL SELECT 'unknown', NULL, NULL, false, 'error', NULL, true"""


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that fail while they run, next to good ones: all are stored, and the good ones are graded."""
    folder = shared_folder(spark, "results")
    checks = [
        Check("rows", "row_count", "customer"),
        Check("zero", "sql_condition_failed_on_table", "customer", None, {"sql_condition": "1 / (c_nationkey - c_nationkey) > 0"}),
        Check("negative", "negative_values", "customer", "c_acctbal"),
        Check("no number", "sql_aggregate_expression_on_table", "customer", None, {"sql_expression": "sum(CAST(c_name AS INT))"}),
        Check("nations", "distinct_count", "customer", "c_nationkey"),
        Check("guarded", "sql_condition_failed_on_table", "customer", None, {"sql_condition": "1 / c_nationkey > 0"}, {}, "c_nationkey > 0"),
        Check("open", "sql_condition_failed_on_table", "customer", None, {"sql_condition": "1 / c_nationkey > 0"}),
    ]
    run_and_append(spark, checks, {"customer": load(spark, sf_dir, "customer")}, folder, executed_at=_NOW)
    return read_results(spark, folder).select("check_id", "actual_value", "passed", F.col("error_message").isNotNull().alias("failed"))


_FAILING_SQL = """
SELECT 'rows' AS check_id, count(*)::DOUBLE AS actual_value, true AS passed, false AS failed FROM customer
UNION ALL SELECT 'negative', count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE, count(*) FILTER (WHERE c_acctbal < 0) = 0, false FROM customer
UNION ALL SELECT 'nations', count(DISTINCT c_nationkey)::DOUBLE, count(DISTINCT c_nationkey) >= 1, false FROM customer
UNION ALL SELECT 'guarded', 0.0, true, false
UNION ALL SELECT unnest(['zero', 'no number', 'open']), NULL, false, true"""


def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is there, and one that is not, next to a check of the first."""
    checks = [
        Check("orders there", "table_availability", "orders"),
        Check("clients there", "table_availability", "clients"),
        Check("rows", "row_count", "orders"),
    ]
    return run_checks(spark, checks, {"orders": load(spark, sf_dir, "orders")}, executed_at=_NOW).select(
        "check_id", "actual_value", "passed", "rows_scanned", F.col("error_message").isNotNull().alias("refused")
    )


_AVAILABILITY_SQL = """
SELECT 'orders there' AS check_id, 1.0::DOUBLE AS actual_value, true AS passed, count(*) AS rows_scanned, false AS refused FROM orders
UNION ALL SELECT 'rows', count(*)::DOUBLE, count(*) >= 1, count(*), false FROM orders
UNION ALL SELECT 'clients there', 0.0, false, 0, false"""


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check tried out, nothing stored."""
    check = Check("tried", "distinct_percent", "orders", "o_custkey", thresholds={"warning": {"min_percent": 1}})
    return preview(spark, check, {"orders": load(spark, sf_dir, "orders")}, executed_at=_NOW).select(
        "check_id", F.round("actual_value", 6).alias("actual_value"), "passed", "severity", "rows_scanned"
    )


_PREVIEWED_SQL = """
SELECT 'tried' AS check_id, round(100.0 * count(DISTINCT o_custkey) / count(o_custkey), 6) AS actual_value,
  100.0 * count(DISTINCT o_custkey) / count(o_custkey) >= 1 AS passed,
  CASE WHEN 100.0 * count(DISTINCT o_custkey) / count(o_custkey) >= 1 THEN 'passed' ELSE 'warning' END AS severity,
  count(*) AS rows_scanned FROM orders"""


_LEVELS = {"fatal": {"max_value": 52.0}, "error": {"max_value": 50.0}, "warning": {"max_value": 48.0}}


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of every event type on every day, graded by the worst limit it breaks."""
    events = load(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    checks = [
        Check("mean", "mean_in_range", "events", "value", thresholds=_LEVELS),
        Check("rows", "row_count", "events", thresholds={"warning": {"min_count": 66}, "error": {"min_count": 55}}),
    ]
    graded = run_checks(
        spark, checks, {"events": events}, by=lambda t: ["event_type", "day"], cascade=True, executed_at=_NOW
    )
    return graded.select(
        "check_id",
        F.get_json_object("partition", "$.event_type").alias("event_type"),
        F.get_json_object("partition", "$.day").alias("day"),
        F.round("actual_value", 6).alias("actual_value"),
        "rows_scanned",
        "severity",
    )


_CASCADE_SQL = """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'mean' AS check_id, event_type, day, round(m, 6) AS actual_value, n AS rows_scanned,
  CASE WHEN m > 52 THEN 'fatal' WHEN m > 50 THEN 'error' WHEN m > 48 THEN 'warning' ELSE 'passed' END AS severity FROM d
UNION ALL
SELECT 'rows', event_type, day, CAST(n AS DOUBLE), n,
  CASE WHEN n < 55 THEN 'error' WHEN n < 66 THEN 'warning' ELSE 'passed' END FROM d"""


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken checks become failed rows; the good ones still run, and outside readings are graded too."""
    checks = [
        Check("good", "negative_values", "customer", "c_acctbal"),
        Check("no column", "nulls_count", "customer"),
        Check("bad column", "nulls_count", "customer", "c_fax"),
        Check("bad condition", "sql_condition_failed_on_table", "customer", None, {"sql_condition": "c_fax > 1"}),
        Check("no condition", "sql_condition_failed_on_table", "customer"),
        Check("bad type", "no_such_check", "customer"),
        Check("no table", "row_count", "clients"),
        Check("no reference", "foreign_key_not_found", "customer", "c_nationkey"),
        Check("unknown key", "foreign_key_not_found", "customer", "c_nationkey",
              {"reference_table": "customer", "reference_column": "no_such"}),
        Check("unknown total", "total_sum_match_percent", "customer", "c_acctbal",
              {"reference_table": "customer", "reference_column": "no_such"}),
        Check("unknown match", "sum_match", "customer", "c_fax", {"reference_table": "customer"}),
        Check("unknown source", "sum_match", "customer", "c_acctbal", {"reference_table": "clients"}),
        Check("no readings", "row_count_change_1_day", "customer"),
        Check("odd values", "number_found_in_set_percent", "customer", "c_nationkey", {"expected_values": ["abc"]}),
        Check("imported", "import_custom_result_on_table", "customer", None, {}, {"error": {"min_value": 10}}, active=False),
        Check("unknown part", "duplicate_record_count", "customer", None, {"columns": ["c_fax"]}),
        Check("rows with a map", "duplicate_record_count", "mapped"),
        Check("no share", "percentile_in_range", "customer", "c_acctbal", {"percentile": "abc"}),
        Check("no limit", "row_count", "customer", None, {}, {"error": {"min_count": "abc"}}),
        Check("no number of values", "expected_texts_in_top_values_count", "customer", "c_mktsegment",
              {"expected_values": ["BUILDING"], "top_n": "z"}),
        Check("dotted name", "duplicate_record_count", "dotted"),
    ]
    customer = load(spark, sf_dir, "customer")
    outside = customer.agg(F.count_if(F.col("c_mktsegment") == "BUILDING").cast("double").alias("actual_value")).select(
        F.lit("imported").alias("check_id"), "actual_value"
    )
    tables = {
        "customer": customer,
        "mapped": customer.select("c_custkey", F.create_map("c_custkey", "c_name").alias("names")),
        "dotted": customer.select(F.col("c_nationkey").alias("c.nation"), F.col("c_mktsegment").alias("segment's `name`")),
    }
    graded = run_checks(spark, checks, tables, outside=outside, executed_at=_NOW)
    return graded.select(
        "check_id", "actual_value", "passed", "severity", F.col("error_message").isNotNull().alias("refused")
    )


_ISOLATED_SQL = """
SELECT 'good' AS check_id, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS DOUBLE) AS actual_value,
  count(*) FILTER (WHERE c_acctbal < 0) <= 0 AS passed,
  CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) <= 0 THEN 'passed' ELSE 'error' END AS severity, false AS refused FROM customer
UNION ALL
SELECT 'imported', CAST(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE),
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') >= 10,
  CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'BUILDING') >= 10 THEN 'passed' ELSE 'error' END, false FROM customer
UNION ALL
SELECT 'odd values', 0.0, false, 'error', false
UNION ALL
SELECT 'dotted name', CAST(count(*) - count(DISTINCT (c_nationkey, c_mktsegment)) AS DOUBLE), count(*) = count(DISTINCT (c_nationkey, c_mktsegment)),
  CASE WHEN count(*) = count(DISTINCT (c_nationkey, c_mktsegment)) THEN 'passed' ELSE 'error' END, false FROM customer
UNION ALL
SELECT unnest(['no column', 'bad column', 'bad condition', 'no condition', 'bad type', 'no table', 'no reference',
  'unknown key', 'unknown total', 'unknown match', 'unknown source', 'no readings',
  'unknown part', 'rows with a map', 'no share', 'no limit', 'no number of values']),
  NULL, false, 'error', true"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected text and message of results on the orders."""
    checks = [
        Check("nulls", "nulls_percent", "orders", "o_custkey"),
        Check("rows", "row_count", "orders"),
        Check("distinct", "distinct_count", "orders", "o_orderstatus", thresholds={"error": {"min_count": 1, "max_count": 2}}),
        Check("mean", "number_above_max_value", "orders", "o_orderkey", thresholds={"error": {"max_value": 10}}),
        Check("fresh", "data_freshness", "orders", "o_orderdate", {"as_of": "2001-08-04 12:00:00"}),
        Check("status", "text_found_in_set_percent", "orders", "o_orderstatus", {"expected_values": ["F", "O"]}),
        Check("future", "date_values_in_future_percent", "orders", "o_orderdate", {"as_of": _NOW}),
        Check("available", "table_availability", "orders"),
    ]
    graded = run_checks(spark, checks, {"orders": load(spark, sf_dir, "orders")}, executed_at=_NOW)
    return graded.select("check_id", "expected", "message")


_MESSAGES_SQL = """
WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d, max(o_orderkey) AS k,
  epoch(TIMESTAMP '2001-08-04 12:00:00') - epoch(max(o_orderdate)) AS s,
  100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / count(*) AS nulls,
  100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) / count(*) AS st FROM orders)
SELECT 'nulls' AS check_id, '<= 5.0%' AS expected, format('{:.2f}', nulls) || '% null values (limit: <= 5.0%)' AS message FROM o
UNION ALL SELECT 'rows', '[1, None]', format('{:,}', n) || ' rows (expected: [1, None])' FROM o
UNION ALL SELECT 'distinct', '[1, 2]', format('{:,}', d) || ' distinct values (limit: [1, 2])' FROM o
UNION ALL SELECT 'mean', '<= 10.0', 'Value ' || format('{:,}', k) || ' is outside expected range (<= 10.0)' FROM o
UNION ALL SELECT 'fresh', '<= 86400.0', 'Data is ' || format('{:.1f}', s / 86400) || ' days stale (threshold: 1.0 days)' FROM o
UNION ALL SELECT 'status', '>= 95.0%', format('{:.2f}', st) || '% of values in accepted set (target: >= 95.0%)' FROM o
UNION ALL SELECT 'future', '<= 0.0%', '0.00% of dates passed validation (target: <= 0.0%)' FROM o
UNION ALL SELECT 'available', 'True/1', 'Table is available' FROM o"""


_LIMITS = {
    "min_value": -1.0, "max_value": 60.0, "min_percent": 10.0, "max_percent": 50.0, "max_change_percent": 20.0,
    "min_count": 5.0, "max_count": 70.0, "expected_value": 12.0, "forbidden_value": 7.0,
}


def _every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings made from the customers, graded by each of the 15 rules in turn."""
    names = F.array(*map(F.lit, rules.RULE_THRESHOLDS))
    limits = F.struct(*[F.lit(v).alias(k) for k, v in _LIMITS.items()]).cast(rules.THRESHOLD_TYPE)
    unset = F.lit(None).cast(rules.THRESHOLD_TYPE)
    key = F.col("c_custkey")
    readings = load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.element_at(names, (key % len(rules.RULE_THRESHOLDS) + 1).cast("int")).alias("rule"),
        F.when(key % 11 != 0, F.floor(F.col("c_acctbal") / 100).cast("double")).alias("actual_value"),
        F.lit("custom_sql").alias("category"),
        F.lit("any").alias("sensor"),
        unset.alias("fatal"),
        F.when(key % 2 == 0, limits).alias("error"),
        limits.alias("warning"),
        (key % 10).cast("int").alias("history_count"),
        F.lit(0.0).alias("fence_low"),
        F.lit(55.5).alias("fence_high"),
    )
    return rules.grade(readings).select("c_custkey", "rule", "passed", "severity", "expected")


def _every_rule_sql() -> str:
    arms, said = [], []
    text = {k: str(v) for k, v in _LIMITS.items()}
    count = {k: str(int(v)) for k, v in _LIMITS.items()}
    wording = {
        "min_value": f">= {text['min_value']}", "max_value": f"<= {text['max_value']}",
        "min_max_value": f"[{text['min_value']}, {text['max_value']}]",
        "min_percent": f">= {text['min_percent']}%", "max_percent": f"<= {text['max_percent']}%",
        "min_max_percent": f"[{text['min_percent']}%, {text['max_percent']}%]",
        "min_count": f">= {count['min_count']}", "max_count": f"<= {count['max_count']}",
        "min_max_count": f"[{count['min_count']}, {count['max_count']}]",
        "equal_to": text["expected_value"], "not_equal_to": f"!= {text['forbidden_value']}",
        "is_true": "True/1", "is_false": "False/0",
    }
    for rule in rules.RULE_THRESHOLDS:
        if rule == "anomaly_percentile":
            arms.append("WHEN rule = 'anomaly_percentile' THEN h < 7 OR coalesce(v BETWEEN 0 AND 55.5, false)")
            said.append("WHEN rule = 'anomaly_percentile' THEN CASE WHEN h < 7 OR v IS NULL THEN 'within IQR bounds' ELSE '[0.00, 55.50]' END")
        else:
            arms.append(f"WHEN rule = '{rule}' THEN {rule_sql(rule, _LIMITS)}")
            if rule == "max_change_percent":
                said.append("WHEN rule = 'max_change_percent' THEN CASE WHEN v IS NULL THEN '<= 20.0% change' ELSE '<= ±20.0%' END")
            else:
                said.append(f"WHEN rule = '{rule}' THEN '{wording[rule]}'")
    names = ", ".join(f"'{r}'" for r in rules.RULE_THRESHOLDS)
    return f"""
WITH r AS (SELECT c_custkey, [{names}][c_custkey % {len(rules.RULE_THRESHOLDS)} + 1] AS rule, c_custkey % 10 AS h,
  CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal / 100) END AS v FROM customer),
g AS (SELECT *, CASE {' '.join(arms)} END AS passed, CASE {' '.join(said)} END AS expected FROM r)
SELECT c_custkey, rule, passed, CASE WHEN passed THEN 'passed' WHEN c_custkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, expected FROM g"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to a results table and read back from the second day on."""
    folder = shared_folder(spark, "results")
    checks = [Check("negative", "negative_values", "customer", "c_acctbal"), Check("rows", "row_count", "customer")]
    tables = {"customer": load(spark, sf_dir, "customer")}
    for moment in ("2024-01-30 23:00:00", "2024-01-31 23:00:00"):
        append_results(run_checks(spark, checks, tables, executed_at=moment), folder)
    kept = read_results(spark, folder, since="2024-01-31")
    return kept.select("check_id", F.col("run_date").cast("string").alias("run_date"), "actual_value", "passed", "rows_scanned")


_STORED_SQL = """
SELECT 'negative' AS check_id, '2024-01-31' AS run_date, count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE AS actual_value,
  count(*) FILTER (WHERE c_acctbal < 0) = 0 AS passed, count(*) AS rows_scanned FROM customer
UNION ALL SELECT 'rows', '2024-01-31', count(*)::DOUBLE, count(*) >= 1, count(*) FROM customer"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"checks_on_{table}": _suite(table, kinds) for table, kinds in _suites().items()}
    found["checks_against_earlier_days"] = _earlier
    found["checks_for_anomalies"] = _anomalies
    found["checks_between_two_sources"] = _matches
    found["checks_between_two_sources_filtered"] = _matches_filtered
    found["checks_between_two_sources_per_partition"] = _matches_per_partition
    found["checks_of_missing_tables"] = _availability
    found["check_previewed"] = _previewed
    found["checks_that_fail_while_running"] = _failing
    found["checks_and_expectations_together"] = _mixed
    found["checks_per_day_and_type_with_cascade"] = _cascade
    found["checks_with_failures_isolated"] = _isolated
    found["check_messages"] = _messages
    found["readings_graded_by_every_rule"] = _every_rule
    found["results_stored_and_read_back"] = _stored
    return found


def oracle_sql() -> dict[str, str]:
    found = {
        f"checks_on_{table}": " UNION ALL ".join(_graded_sql(k, CASES[k.sensor].scalar()) for k in kinds)
        for table, kinds in _suites().items()
    }
    found["checks_against_earlier_days"] = " UNION ALL ".join(
        _graded_sql(CHECKS[n], CASES[n].scalar()) for n in sorted(_EARLIER)
    )
    found["checks_for_anomalies"] = _anomaly_sql()
    found["checks_between_two_sources"] = _match_sql()
    found["checks_between_two_sources_filtered"] = _match_rows_sql("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'", [])
    found["checks_between_two_sources_per_partition"] = _match_rows_sql("true", ["o_orderpriority", "o_orderstatus"])
    found["checks_of_missing_tables"] = _AVAILABILITY_SQL
    found["check_previewed"] = _PREVIEWED_SQL
    found["checks_that_fail_while_running"] = _FAILING_SQL
    found["checks_and_expectations_together"] = _MIXED_SQL
    found["checks_per_day_and_type_with_cascade"] = _CASCADE_SQL
    found["checks_with_failures_isolated"] = _ISOLATED_SQL
    found["check_messages"] = _MESSAGES_SQL
    found["readings_graded_by_every_rule"] = _every_rule_sql()
    found["results_stored_and_read_back"] = _STORED_SQL
    return found
