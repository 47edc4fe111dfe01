"""Stored results and sketches, and sets of columns that identify rows."""

import os
import tempfile
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.operators.day_sketches import change_over, day_sketches, distinct_over, standard_error
from plumbline.operators import key_sets
from plumbline.operators.key_sets import identifying_sets
from plumbline.sources.results import merge_by_folder, read_buckets, store_days, store_per_bucket


@pytest.fixture()
def folder():
    return os.path.join(tempfile.mkdtemp(prefix="plumbline-test-"), "table")


def brute_force(rows, names, width):
    keys = []
    for size in range(1, width + 1):
        for s in combinations(range(len(names)), size):
            values = [tuple(r[i] for i in s) for r in rows]
            known = all(v is not None for t in values for v in t)
            if rows and known and len(set(values)) == len(rows) and not any(set(k) <= set(s) for k in keys):
                keys.append(s)
    return sorted(tuple(names[i] for i in k) for k in keys)


@pytest.mark.parametrize("modulus", [1, 7, 30])
def test_key_sets_against_brute_force(spark, modulus):
    names = ["a", "b.c", "d", "e`f", "hot", "gap"]
    rows = [
        (i % 10, i // 10, (i * 37) % (modulus * 10), f"t{i % 60}", 1 if i % 3 else i, None if i == 5 else i)
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "a int, `b.c` int, d int, `e``f` string, hot int, gap int")
    found = [tuple(r["columns"]) for r in identifying_sets(df, "t").collect()]
    assert sorted(found) == brute_force(rows, names, 3)


def test_tables_without_a_key(spark):
    repeated = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert identifying_sets(repeated, "t").count() == 0
    assert identifying_sets(repeated.limit(0), "t").count() == 0
    maps = spark.range(3).select(F.create_map(F.lit("k"), "id").alias("m"))
    assert identifying_sets(maps, "t").count() == 0
    assert identifying_sets(spark.createDataFrame([(1, 1)], "a int, b int"), "t").count() == 2


def result(spark, *rows):
    return spark.createDataFrame(rows, "check_id string, partition string, executed_at string, actual_value double").withColumn(
        "executed_at", F.col("executed_at").cast("timestamp")
    )


def test_one_result_per_bucket_is_stored(spark, folder):
    def kept():
        rows = read_buckets(spark, folder).collect()
        return sorted((r.check_id, r.partition or "", str(r.bucket), r.actual_value) for r in rows)

    first = result(spark, ("a", None, "2024-01-05 01:00:00", 1.0), ("a", "p", "2024-01-05 01:00:00", 2.0), ("a", None, "2024-02-01 00:00:00", 3.0))
    for _ in range(2):  # a repeated run
        store_per_bucket(first, folder, "month")
        assert kept() == [("a", "", "2024-01-01", 1.0), ("a", "", "2024-02-01", 3.0), ("a", "p", "2024-01-01", 2.0)]
    untouched = {f: os.stat(os.path.join(folder, "bucket=2024-02-01", f)).st_mtime_ns for f in os.listdir(os.path.join(folder, "bucket=2024-02-01"))}
    # A later run replaces its row; a straggler and another check leave it; a run of the same time replaces.
    store_per_bucket(result(spark, ("a", None, "2024-01-20 00:00:00", 9.0)), folder, "month")
    store_per_bucket(result(spark, ("a", None, "2024-01-10 00:00:00", 5.0), ("b", None, "2024-01-10 00:00:00", 6.0)), folder, "month")
    store_per_bucket(result(spark, ("a", "p", "2024-01-05 01:00:00", 2.5)), folder, "month")
    assert kept() == [("a", "", "2024-01-01", 9.0), ("a", "", "2024-02-01", 3.0), ("a", "p", "2024-01-01", 2.5), ("b", "", "2024-01-01", 6.0)]
    assert untouched == {f: os.stat(os.path.join(folder, "bucket=2024-02-01", f)).st_mtime_ns for f in os.listdir(os.path.join(folder, "bucket=2024-02-01"))}
    assert read_buckets(spark, folder, since="2024-02-01").count() == 1


def test_a_failed_run_leaves_what_was_stored(spark, folder):
    store_per_bucket(result(spark, ("a", None, "2024-01-05 01:00:00", 1.0)), folder, "month")
    broken = result(spark, ("a", None, "2024-01-06 01:00:00", 1.0)).withColumn("actual_value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store_per_bucket(broken, folder, "month")
    assert [r.actual_value for r in read_buckets(spark, folder).collect()] == [1.0]


def test_merging_no_rows_changes_nothing(spark, folder):
    rows = spark.createDataFrame([("x", 1, "2024")], "f string, k int, v string")
    merge_by_folder(rows, folder, "f", ["k"])
    merge_by_folder(rows.limit(0), folder, "f", ["k"])
    assert [tuple(r) for r in spark.read.parquet(folder).select("f", "k", "v").collect()] == [("x", 1, "2024")]


def test_stored_days_answer_any_stretch(spark, folder):
    # A third of all rows has one value and one day; a column without values; rows without a day.
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).when(F.col("id") == 1, None)
        .otherwise(F.concat(F.lit("2024-0"), (F.col("id") % 2 + 1).cast("string"), F.lit("-1"), (F.col("id") % 7).cast("string"))).alias("d"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v`x"),
        F.lit(None).cast("string").alias("none"),
    )
    made = day_sketches(df, "t", F.col("d").cast("date"), ["v`x", "none"])
    store_days(made, folder)
    store_days(made.filter("day = '2024-01-01'"), folder)  # stored again: replaced, not added
    kept = spark.read.parquet(folder)
    month = F.date_trunc("month", "day").cast("date")
    counted = distinct_over(kept, month)
    exact = {
        r.m: r for r in df.groupBy(F.date_trunc("month", F.col("d").cast("date")).cast("date").alias("m"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("`v``x`").alias("n")).collect()
    }
    for r in counted.collect():
        assert r.rows == exact[r.stretch].rows
        if r.column_name == "none":
            assert (r.distinct_estimate, r.nulls) == (0, r.rows)
        else:
            assert abs(r.distinct_estimate - exact[r.stretch].n) <= 6 * standard_error() * exact[r.stretch].n and r.nulls == 0
    changes = change_over(counted, F.add_months("stretch", -1)).filter("stretch = '2024-02-01'").collect()
    assert len(changes) == 2
    for r in changes:
        assert (r.change_percent is None) == (r.column_name == "none") and r.earlier_estimate is not None
    assert all(r.change_percent is None for r in change_over(counted, F.add_months("stretch", -2)).collect())


def test_sets_with_repeated_tuples_do_not_move_all_rows(spark, monkeypatch):
    """A pair of columns that is nearly a key is ruled out in a slice; a single repeated tuple is found in all rows."""
    rows = spark.range(20_000).selectExpr("id AS k", "pmod(xxhash64(id), 1000) AS a", "pmod(xxhash64(id, 2), 1000) AS b", "if(id = 19999, 0, id) AS once")
    asked = []
    whole = key_sets._unique
    monkeypatch.setattr(key_sets, "_unique", lambda df, sets, slices=1: asked.append((slices, sets)) or whole(df, sets, slices))
    found = [tuple(r["columns"]) for r in identifying_sets(rows, "t", width=2).collect()]
    assert ("k",) in found and ("once",) not in found and ("a", "b") not in found
    assert [s for slices, sets in asked if slices > 1 for s in sets if s == ("a", "b")] == [("a", "b")]
    assert [s for slices, sets in asked if slices == 1 for s in sets if s == ("a", "b")] == []
