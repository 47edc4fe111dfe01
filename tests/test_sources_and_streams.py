"""Reading and writing tables, and micro-batches that depend on earlier ones."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.plans.run import Check, preview, run_checks
from plumbline.sources import results as stored
from plumbline.sources.tables import is_available, listed_columns, read_table
from plumbline.streaming import batches, windows
from plumbline.operators.measure import Probe


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="plumbline-test-")


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_file_sources_with_a_partition_filter(spark, folder, kind):
    path = os.path.join(folder, kind)
    spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("part")).write.format(kind).option("header", True).save(path)
    df = read_table(spark, kind, path, where="part = 1", schema="id bigint, part int", header="true")
    assert sorted(r.id for r in df.collect()) == [1, 3, 5, 7, 9]
    assert is_available(spark, kind, path) and not is_available(spark, kind, path + "-lost")


def test_catalog_sources(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_table(spark, "view", "three").count() == 3
    assert read_table(spark, "query", "SELECT id FROM three WHERE id > 0").count() == 2
    assert [(r.column_name, r.data_type) for r in listed_columns(spark).filter("table_name = 'three'").collect()] == [("id", "bigint")]
    assert not is_available(spark, "table", "no_such_table")


def test_results_are_appended_by_date_and_read_back_pruned(spark, people, folder):
    path = os.path.join(folder, "results")
    checks = [Check("n", "nulls_count", "people", "email"), Check("x", "no_such_check", "people")]
    for day in ("2024-01-01", "2024-01-02"):
        stored.append_results(run_checks(spark, checks, {"people": people}, executed_at=f"{day} 05:00:00"), path)
    assert sorted(n for n in os.listdir(path) if n.startswith("run_date")) == ["run_date=2024-01-01", "run_date=2024-01-02"]
    kept = stored.read_results(spark, path, since="2024-01-02")
    assert kept.count() == 2 and "run_date" in kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in kept._jdf.queryExecution().executedPlan().toString()


def test_preview_stores_nothing_and_grades(spark, people):
    row = preview(spark, Check("x", "invalid_latitude", "people", "latitude"), {"people": people}).first()
    assert (row.actual_value, row.passed, row.severity) == (1.0, False, "error")


def test_sample_is_reused_until_the_schema_changes(spark, people, folder):
    first = stored.cached_sample(people, "people", ["id"], 1, 5, folder, pii=("email",))
    ids = {r.id for r in first.collect()}
    shrunk = people.filter("id < 3")  # same schema: the stored sample is used
    assert {r.id for r in stored.cached_sample(shrunk, "people", ["id"], 1, 5, folder, pii=("email",)).collect()} == ids
    assert "email" not in first.columns
    wider = shrunk.withColumn("extra", F.lit(1))
    assert {r.id for r in stored.cached_sample(wider, "people", ["id"], 1, 5, folder, pii=("email",)).collect()} == {1, 2}


def test_shared_folders_are_new_each_time(spark):
    assert stored.shared_folder(spark, "a") != stored.shared_folder(spark, "a")


T0 = datetime(2024, 1, 1)
SCHEMA = "at timestamp, id int, v double"


def _append(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_counted_against_earlier_batches(spark, folder):
    source, out, checkpoint = (os.path.join(folder, n) for n in ("in", "out", "checkpoint"))
    writer = batches.freshness_of_batches("at", "1 HOUR", out, "2024-01-02 00:00:00")
    for rows in ([(T0 + timedelta(hours=5), 1, 1.0)], [(T0 + timedelta(hours=3), 2, 1.0), (T0 + timedelta(hours=4, minutes=30), 3, 1.0), (T0 + timedelta(hours=6), 4, 1.0)]):
        _append(spark, source, rows)
        batches.drain(spark.readStream.schema(SCHEMA).parquet(source), writer, checkpoint)
    got = [(r.rows, r.late_rows, r.lag_seconds) for r in spark.read.parquet(os.path.join(out, "batches")).orderBy("batch_id").collect()]
    assert got == [(1, 0, 19 * 3600), (3, 1, 18 * 3600)]


def test_window_changes_reach_back_over_batches(spark, folder):
    source, out, checkpoint = (os.path.join(folder, n) for n in ("in", "out", "checkpoint"))
    for hour, n in enumerate((2, 4, 3, 1)):
        _append(spark, source, [(T0 + timedelta(hours=hour, minutes=i), i, 1.0) for i in range(n)])
        stream = windows.window_sensors(
            spark.readStream.schema(SCHEMA).parquet(source), "at", [Probe("n", "row_count")], width="1 hour", delay="0 seconds"
        )
        batches.drain(stream, batches.window_changes(out), checkpoint)
    got = spark.read.parquet(os.path.join(out, "changes")).orderBy("window_start").collect()
    assert [(r.sensor_value, r.previous_value, r.change_percent) for r in got] == [(2.0, None, None), (4.0, 2.0, 100.0), (3.0, 4.0, -25.0)]


def test_window_changes_keep_groups_apart(spark, folder):
    schema = "window_start timestamp, window_end timestamp, kind string, probe_id string, sensor_value double"
    hour = [T0 + timedelta(hours=h) for h in range(5)]
    writer = batches.window_changes(folder)
    first = [(hour[h], hour[h + 1], k, "n", v) for h, k, v in ((0, "a", 10.0), (0, None, 1.0), (1, "a", 20.0))]
    later = [(hour[h], hour[h + 1], k, "n", v) for h, k, v in ((1, None, 3.0), (2, "a", 30.0), (2, "b", 5.0))]
    for batch_id, rows in ((0, first), (1, later), (1, later)):
        writer(spark.createDataFrame(rows, schema), batch_id)
    got = {(r.window_start, r.kind): r.change_percent for r in spark.read.parquet(os.path.join(folder, "changes")).collect()}
    assert got == {(hour[0], "a"): None, (hour[0], None): None, (hour[1], "a"): 100.0, (hour[1], None): 200.0, (hour[2], "a"): 50.0, (hour[2], "b"): None}
    # However many batches there are, the state lies in two folders.
    for batch_id in range(2, 7):
        writer(spark.createDataFrame(later, schema), batch_id)
    assert sorted(os.listdir(os.path.join(folder, "state"))) == ["slot=0", "slot=1"]


def test_a_repeated_batch_leaves_no_second_copy(spark, people, folder):
    writer = batches.graded_batches([Check("n", "row_count", "people")], "people", folder)
    writer(people, 0)
    writer(people, 0)
    writer(people, 1)
    assert spark.read.parquet(folder).count() == 2


def test_incidents_of_batches_that_come_twice_or_leave_nothing_open(spark, tmp_path):
    from plumbline.streaming import incidents

    columns = ", ".join(incidents.INCIDENT_SCHEMA.split(", "))
    folder = str(tmp_path)

    def folded(batch, held):
        # Stands in for the fold: a batch's rows are added to the open ones, those named in it as resolved are closed.
        closed = batch.filter("status = 'resolved'").select("incident_id")
        still = held.join(closed, "incident_id", "left_anti").select(*held.columns)
        return still.unionByName(batch)

    def batch(*rows):
        made = [("c", i, status, *[None] * 7) for i, status in rows]
        return spark.createDataFrame(made, columns)

    real, incidents.fold = incidents.fold, folded
    try:
        write = incidents.incident_batches(folder)
        seen = []
        for batch_id, rows in [(0, [("a", "open")]), (1, [("b", "open")]), (1, [("b", "open")]), (2, [("a", "resolved"), ("b", "resolved")]), (3, [])]:
            write(batch(*rows), batch_id)
            seen.append(sorted((r.incident_id, r.status) for r in incidents.current_incidents(spark, folder).collect()))
    finally:
        incidents.fold = real
    both_open, both_closed = [("a", "open"), ("b", "open")], [("a", "resolved"), ("b", "resolved")]
    assert seen == [[("a", "open")], both_open, both_open, both_closed, both_closed]
    assert sorted(p.name for p in (tmp_path / "open").iterdir() if p.is_dir()) == ["slot=0", "slot=1"]
