"""Changes against earlier days: one scan of the hours in question, and one measurement for all gaps."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.measure import Probe, measure

AS_OF = "2024-05-20 12:30:00"
GAPS = {1: "row_count_change_1_day", 7: "row_count_change_7_days", 30: "row_count_change_30_days"}


def history_rows():
    made = random.Random(3)
    now = datetime.fromisoformat(AS_OF)
    rows = []
    for days in (1, 7, 30):
        low = now - timedelta(days=days)
        for minutes in (-1, 0, 1, 30, 59, 60, 61):
            rows.append((low + timedelta(minutes=minutes), made.choice([None, 10.0, 20.0, 40.0]), made.choice(["a", "b", None])))
        rows += [(low + timedelta(minutes=20), 5.0, "a"), (low + timedelta(minutes=20), 8.0, "a")]
    rows += [(now - timedelta(hours=made.randint(1, 2000)), float(made.randint(1, 99)), made.choice(["a", "b", None])) for _ in range(400)]
    return [("row_count:", at, value, part) for at, value, part in rows]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("history") / "readings")
    rows = spark.createDataFrame(history_rows(), "metric_id string, executed_at timestamp, actual_value double, part string")
    rows.withColumn("run_date", F.to_date("executed_at")).write.partitionBy("run_date").parquet(folder)
    return spark.read.parquet(folder)


def earlier(days, part=...):
    low = datetime.fromisoformat(AS_OF) - timedelta(days=days)
    inside = [
        (at, value)
        for _, at, value, p in history_rows()
        if value is not None and low <= at < low + timedelta(hours=1) and (part is ... or p == part)
    ]
    return max(inside)[1] if inside else None


def probes():
    return [Probe(name, name, None, {"as_of": AS_OF}) for name in GAPS.values()]


def expected(rows, before):
    return None if not before else (rows - before) / before * 100


def test_against_brute_force(spark, stored):
    table = spark.range(23).select(F.when(F.col("id") < 9, "a").when(F.col("id") < 12, "b").alias("part"))
    found = {r.probe_id: r.sensor_value for r in measure(table, probes(), readings=stored.drop("part")).collect()}
    assert found == {name: expected(23, earlier(days)) for days, name in GAPS.items()} and None not in found.values()
    parts = measure(table, probes(), by=["part"], readings=stored).collect()
    rows = {"a": 9, "b": 3, None: 11}
    assert {(r.part, r.probe_id): r.sensor_value for r in parts} == {
        (part, name): expected(n, earlier(days, part)) for part, n in rows.items() for days, name in GAPS.items()
    }


def test_one_scan_of_few_folders(spark, stored):
    table = spark.range(23)
    whole = measure(table, probes(), readings=stored)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 1 and plan.count("Range (0, 23") == 1
    filters = scans[0].split("PartitionFilters: ")[1].split("PushedFilters: ")
    # The plan's text shows the first bounds only.
    assert "run_date" in filters[0] and ">= 2024-05-18" in filters[0] and "executed_at" in filters[1]
    assert whole.count() == 3


def test_moments_differ_per_probe(spark, stored):
    later = "2024-05-21 12:30:00"
    some = [
        Probe("one", GAPS[1], None, {"as_of": AS_OF}),
        Probe("two", GAPS[1], None, {"as_of": later}),
        Probe("three", GAPS[1], None, {"as_of": AS_OF, "metric_id": "another"}),
        Probe("now", GAPS[30], None, {}),
    ]
    rows = history_rows()
    low = datetime.fromisoformat(later) - timedelta(days=1)
    next_day = [(at, v) for _, at, v, _ in rows if v is not None and low <= at < low + timedelta(hours=1)]
    found = {r.probe_id: r.sensor_value for r in measure(spark.range(10), some, readings=stored).collect()}
    assert found == {
        "one": expected(10, earlier(1)), "two": expected(10, max(next_day)[1] if next_day else None), "three": None, "now": None,
    }


def test_empty_history(spark, stored):
    found = measure(spark.range(10), probes(), readings=stored.where("false")).collect()
    assert len(found) == 3 and all(r.sensor_value is None for r in found)
