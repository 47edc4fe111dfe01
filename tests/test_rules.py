"""Grading: every rule, its edges, and what is said about it."""

import pytest

from plumbline.operators.rules import RULE_THRESHOLDS, THRESHOLDS, THRESHOLD_TYPE, grade
from plumbline.operators.checks import CHECKS, checks_of_dimension, dimension_of
from plumbline.plans.run import Check, run_checks
from plumbline import fixed


def graded(spark, rows, cascade=False):
    """rows: (id, rule, value, {severity: limits}, category, sensor)"""
    full = []
    for i, rule, value, limits, category, sensor in rows:
        structs = [
            None if limits.get(s) is None else {t: limits[s].get(t) for t in THRESHOLDS} for s in ("fatal", "error", "warning")
        ]
        full.append((i, rule, value, category, sensor, *structs))
    df = spark.createDataFrame(
        full,
        f"id string, rule string, actual_value double, category string, sensor string, fatal {THRESHOLD_TYPE}, "
        f"error {THRESHOLD_TYPE}, warning {THRESHOLD_TYPE}",
    )
    return {r.id: r for r in grade(df, cascade=cascade).collect()}


EDGES = [
    ("min_value", 5.0, {"min_value": 5.0}, True),
    ("min_value", 4.9, {"min_value": 5.0}, False),
    ("min_value", None, {"min_value": 5.0}, False),
    ("min_value", 5.0, {}, False),
    ("max_value", 5.0, {"max_value": 5.0}, True),
    ("max_value", 5.1, {"max_value": 5.0}, False),
    ("max_value", 5.1, {}, False),
    ("min_max_value", 3.0, {}, True),
    ("min_max_value", None, {}, False),
    ("min_max_value", 3.0, {"min_value": 4.0}, False),
    ("min_max_value", 3.0, {"max_value": 3.0}, True),
    ("min_percent", 95.0, {"min_percent": 95.0}, True),
    ("max_percent", 5.1, {"max_percent": 5.0}, False),
    ("min_max_percent", 50.0, {"min_percent": 40.0, "max_percent": 60.0}, True),
    ("max_change_percent", -10.0, {"max_change_percent": 10.0}, True),
    ("max_change_percent", 10.5, {"max_change_percent": 10.0}, False),
    ("max_change_percent", None, {"max_change_percent": 10.0}, False),
    ("min_count", 0.0, {"min_count": 1.0}, False),
    ("max_count", 0.0, {"max_count": 0.0}, True),
    ("min_max_count", 5.0, {"min_count": 1.0, "max_count": 4.0}, False),
    ("equal_to", 5.0, {"expected_value": 5.0}, True),
    ("equal_to", None, {"expected_value": 5.0}, False),
    ("not_equal_to", 1.0, {"forbidden_value": 1.0}, False),
    ("not_equal_to", None, {"forbidden_value": 1.0}, True),
    ("not_equal_to", 1.0, {}, True),
    ("is_true", 1.0, {}, True),
    ("is_true", 0.0, {}, False),
    ("is_true", None, {}, False),
    ("is_false", 0.0, {}, True),
    ("is_false", None, {}, True),
    ("is_false", 2.0, {}, False),
]


def test_edges_of_every_rule(spark):
    rows = [(str(i), rule, v, {"error": t}, "custom_sql", "s") for i, (rule, v, t, _) in enumerate(EDGES)]
    got = graded(spark, rows)
    for i, (rule, v, t, expected) in enumerate(EDGES):
        assert got[str(i)].passed is expected, (rule, v, t)
        assert got[str(i)].severity == ("passed" if expected else "error")
        assert got[str(i)].message, (rule, v, t)
    assert {rule for rule, *_ in EDGES} | {"anomaly_percentile"} == set(RULE_THRESHOLDS)


def test_the_most_severe_limit_decides_unless_cascading(spark):
    limits = {"warning": {"max_value": 10.0}, "error": {"max_value": 20.0}, "fatal": {"max_value": 30.0}}
    rows = [(str(v), "max_value", float(v), limits, "numeric", "s") for v in (5, 15, 25, 35)]
    assert [graded(spark, rows)[str(v)].severity for v in (5, 15, 25, 35)] == ["passed"] * 3 + ["fatal"]
    assert [graded(spark, rows, True)[str(v)].severity for v in (5, 15, 25, 35)] == ["passed", "warning", "error", "fatal"]


@pytest.mark.parametrize(
    "rule, value, limits, category, sensor, expected, message",
    [
        ("max_value", 7200.0, {"max_value": 86400.0}, "timeliness", "data_freshness", "<= 86400.0", "Data is 2.0 hours fresh (threshold: 1.0 days)"),
        ("max_value", 30.0, {"max_value": 10.0}, "timeliness", "data_freshness", "<= 10.0", "Data is 30 seconds stale (threshold: 10 seconds)"),
        ("min_max_count", 1234567.0, {"min_count": 1.0}, "volume", "row_count", "[1, None]", "1,234,567 rows (expected: [1, None])"),
        ("max_percent", 12.345, {"max_percent": 5.0}, "nulls", "nulls_percent", "<= 5.0%", "12.35% null values (limit: <= 5.0%)"),
        ("max_percent", 1.0, {"max_percent": 0.0}, "uniqueness", "duplicate_percent", "<= 0.0%", "1.00% duplicates (limit: <= 0.0%)"),
        ("min_max_count", 3.0, {"max_count": 2.0}, "uniqueness", "distinct_count", "[None, 2]", "3 distinct values (limit: [None, 2])"),
        ("min_max_value", 1.5, {"min_value": 0.0}, "numeric", "mean_value", "[0.0, None]", "Value 1.50 is within expected range ([0.0, None])"),
        ("max_count", 4.0, {"max_count": 0.0}, "text", "empty_text_count", "<= 0", "Text length 4 is outside limit (<= 0)"),
        ("max_percent", 4.0, {"max_percent": 5.0}, "patterns", "x", "<= 5.0%", "4.00% of values match format check (target: <= 5.0%)"),
        ("max_count", 2.0, {"max_count": 0.0}, "referential", "x", "<= 0", "2 orphaned foreign keys (limit: <= 0)"),
        ("max_change_percent", 3.0, {"max_change_percent": 10.0}, "change", "x", "<= ±10.0%", "3.00% change detected (limit: <= ±10.0%)"),
        ("not_equal_to", 1.0, {"forbidden_value": 1.0}, "schema", "x", "!= 1.0", "Schema changed — Value 1.0 is equal to 1.0"),
        ("is_true", 0.0, {}, "availability", "x", "True/1", "Table is unavailable or unreachable"),
        ("max_change_percent", 12.0, {"max_change_percent": 10.0}, "custom_sql", "x", "<= ±10.0%", "Change of 12.00% is exceeds limit of 10.0%"),
        ("min_percent", None, {"min_percent": 95.0}, "text", "x", ">= 95.0%", "Sensor returned NULL, expected >= 95.0%"),
        ("min_max_value", None, {}, "numeric", "x", "[None, None]", "Sensor returned NULL, expected in range [None, None]"),
    ],
)
def test_messages(spark, rule, value, limits, category, sensor, expected, message):
    row = graded(spark, [("x", rule, value, {"error": limits}, category, sensor)])["x"]
    assert (row.expected, row.message) == (expected, message)


def test_dimensions():
    assert len(CHECKS) == 176
    assert dimension_of("text_valid_country_code_percent") == "accuracy"
    assert dimension_of("text_found_in_set_percent") == "validity"
    assert dimension_of("column_count") == "conformity" and dimension_of("column_list_changed") == "consistency"
    assert dimension_of("row_count_anomaly") is None and dimension_of("sql_condition_failed_on_table") is None
    assert dimension_of("column_pair_equal") == "consistency" and dimension_of("values_increasing") == "timeliness"
    scored = [c for d in fixed.DIMENSIONS for c in checks_of_dimension(d)]
    assert len(scored) == len(set(scored)) == sum(c.dimension is not None for c in CHECKS.values())


def test_defaults_lie_below_own_thresholds_and_unset_ones_do_not_count():
    check = Check("x", "nulls_percent", "t", "c", thresholds={"error": {"max_percent": None}})
    assert check.limits()["error"] == {"max_percent": 5.0}
    check = Check("x", "nulls_percent", "t", "c", thresholds={"warning": {"max_percent": 1}})
    assert check.limits() == {"fatal": None, "error": None, "warning": {"max_percent": 1.0}}
    check = Check("x", "nulls_percent", "t", "c", {"max_percent": 2}, {"error": {"max_percent": 1}})
    assert check.limits()["error"] == {"max_percent": 2.0}


def test_rows_scanned_follow_the_filter(spark, people):
    checks = [
        Check("all", "nulls_count", "people", "email"),
        Check("some", "nulls_count", "people", "email", where="id <= 5"),
    ]
    got = {r.check_id: r.rows_scanned for r in run_checks(spark, checks, {"people": people}).collect()}
    assert got == {"all": 20, "some": 5}
