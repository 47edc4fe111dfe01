"""Bad checks, odd names and errors of the data cost their own check only."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions.names import literal, quoted
from plumbline.operators.inference import infer
from plumbline.operators.profile import profile
from plumbline.plans import run as run_module
from plumbline.plans.run import Check, run_checks
from plumbline.sources import results as results_module
from plumbline.sources.results import culprits, read_results, run_and_append, shared_folder


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(50).selectExpr("id", "id % 7 AS x", "concat(id, 'x') AS t", "id AS `a.b`", "id % 3 AS `o'c`", "t AS `b``t`")


def by_id(frame):
    return {r.check_id: r for r in frame.collect()}


def test_parameters_that_cannot_be_planned(spark, numbers):
    mapped = numbers.select(F.create_map("id", "x").alias("m"))
    checks = [
        Check("good", "row_count", "t"),
        Check("dup", "duplicate_record_count", "t", None, {"columns": ["nope"]}),
        Check("map", "duplicate_record_count", "mapped"),
        Check("share", "percentile_in_range", "t", "id", {"percentile": "abc"}),
        Check("limit", "row_count", "t", None, {}, {"error": {"min_count": "abc"}}),
        Check("top", "expected_texts_in_top_values_count", "t", "t", {"expected_values": ["1x"], "top_n": "z"}),
        Check("dotted", "duplicate_record_count", "t", None, {"columns": ["a.b", "o'c"]}),
        Check("unique", "unique", "t", "a.b"),
        Check("rising", "values_increasing", "t", "a.b", {"order_by": ["o'c", "id"]}),
        Check("quoted", "distinct_count", "t", "b`t"),
    ]
    found = by_id(run_checks(spark, checks, {"t": numbers, "mapped": mapped}))
    failed = {i for i, r in found.items() if r.error_message}
    assert failed == {"dup", "map", "share", "limit", "top"}
    assert all(r.severity == "error" and r.passed is False for i, r in found.items() if i in failed)
    assert found["good"].actual_value == 50 and found["dotted"].actual_value == 0 and found["quoted"].actual_value == 50


def test_names_in_profiles(spark, numbers):
    rows = {r.column_name: r for r in profile(numbers, "o't").collect()}
    assert rows["o'c"].distinct_count == 3 and rows["a.b"].row_count == 50 and rows["o'c"].table_name == "o't"
    assert {r.column_name for r in infer(numbers, "o't").collect()} >= {"a.b", "o'c", "b`t"}
    assert spark.sql(f"SELECT {literal(chr(92) + 'n' + chr(39))} AS v").first().v == "\\n'" and quoted("a`b") == "`a``b`"


def test_unreadable_table(spark, numbers, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "gone"))
    gone = spark.read.parquet(str(tmp_path / "gone"))
    for part in (tmp_path / "gone").glob("*part*"):
        part.write_bytes(b"no parquet")
    checks = [Check("there", "table_availability", "gone"), Check("rows", "row_count", "gone"), Check("good", "table_availability", "t")]
    found = by_id(run_checks(spark, checks, {"gone": gone, "t": numbers}))
    assert found["there"].actual_value == 0 and not found["there"].passed and found["there"].error_message is None
    assert "cannot be read" in found["rows"].error_message and found["good"].passed


def test_errors_of_the_data_are_traced(spark, numbers, monkeypatch):
    runs = []
    taken = run_module.take_readings
    monkeypatch.setattr(run_module, "take_readings", lambda some, *a, **k: runs.append(len(some)) or taken(some, *a, **k))
    good = [Check(f"rows {k}", "row_count", "t") for k in range(20)]
    bad = Check("cast", "sql_aggregate_expression_on_table", "t", None, {"sql_expression": "sum(CAST(t AS INT))"})
    folder = shared_folder(spark, "results")
    reasons = run_and_append(spark, [*good, bad], {"t": numbers}, folder)
    assert list(reasons) == ["cast"] and "CAST_INVALID_INPUT" in reasons["cast"]
    assert runs == [21, 20]  # the failed run, and one without the check that the error names
    stored = read_results(spark, folder)
    assert stored.count() == 21 and stored.select("executed_at").distinct().count() == 1
    assert stored.where("error_message IS NOT NULL").first().check_id == "cast"


def test_a_piece_that_fails_behind_one_filter_only(spark, numbers):
    condition = {"sql_condition": "10 / x > 0"}
    checks = [
        Check("open", "sql_condition_failed_on_table", "t", None, condition),
        Check("guarded", "sql_condition_failed_on_table", "t", None, condition, {}, "x > 0"),
        Check("rows", "row_count", "t"),
    ]
    folder = shared_folder(spark, "results")
    assert list(run_and_append(spark, checks, {"t": numbers}, folder)) == ["open"]
    assert by_id(read_results(spark, folder))["guarded"].passed


def test_errors_of_the_cluster_blame_no_check(spark, numbers, monkeypatch):
    class Lost(PySparkException):
        def getSqlState(self):
            return "XXKST"

    calls = []

    def lost(results, path):
        calls.append(path)
        raise Lost("executor lost")

    monkeypatch.setattr(results_module, "append_results", lost)
    with pytest.raises(Lost):
        run_and_append(spark, [Check("rows", "row_count", "t")], {"t": numbers}, "nowhere", retries=2)
    assert len(calls) == 3


def test_culprits_without_a_piece_are_searched():
    checks = [Check(str(k), "row_count", "t") for k in range(9)]

    class Plain(PySparkException):
        def getQueryContext(self):
            return []

    found = culprits(Plain("x"), checks, lambda some: any(c.check_id in ("2", "7") for c in some))
    assert [c.check_id for c in found] == ["2", "7"]
