"""Properties of the plans that decide whether they hold on a large cluster."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history, inference
from plumbline.operators.measure import Probe, measure
from plumbline.operators.percentiles import exact_percentiles
from workload import registry
from workload.tables import load


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "checks_on_lineitem",
        "checks_on_customer",
        "checks_against_earlier_days",
        "sensor_foreign_key_found_percent",
        "sensor_duplicate_record_count",
        "profile_of_orders",
        "dimension_scores",
        "incidents_of_the_history",
        "alerts_to_send",
        "suggested_checks",
        "two_sources_compared_per_nation",
    ],
)
def test_no_nested_loops_and_no_row_wise_python(spark, sf_dir, name):
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_scan_sensors_share_one_pass_and_read_their_columns_only(spark, sf_dir):
    probes = [Probe(f"p{i}", s, "o_totalprice") for i, s in enumerate(("min_value", "max_value", "mean_value", "nulls_percent"))]
    plan = plan_of(measure(load(spark, sf_dir, "orders"), probes + [Probe("n", "row_count", where=None)]))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_totalprice:double>" in plan


def test_the_partition_filter_reaches_the_scan(spark, sf_dir):
    probe = Probe("p", "mean_value", "o_totalprice", where="o_orderstatus = 'F'")
    plan = plan_of(measure(load(spark, sf_dir, "orders"), [probe]))
    assert "EqualTo(o_orderstatus,F)" in plan


def test_exact_distinct_counts_do_not_multiply_rows(spark, sf_dir):
    probes = [Probe(c, "distinct_count", c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")]
    assert "Expand" not in plan_of(measure(load(spark, sf_dir, "orders"), probes))


def test_percentiles_never_use_the_built_in_aggregate(spark, sf_dir):
    values = load(spark, sf_dir, "orders").select(F.lit("s").alias("series"), F.col("o_totalprice").alias("v"))
    plan = plan_of(exact_percentiles(values, [], {"s": [0.5]}))
    # Only the bounded summary that brackets the ranks; `percentile` itself holds all distinct values in one task.
    assert "percentile(" not in plan.replace("percentile_approx(", "") and "BroadcastHashJoin" in plan


def test_percentiles_read_their_column_twice(spark, sf_dir):
    values = load(spark, sf_dir, "orders").select(F.lit("s").alias("series"), F.col("o_totalprice").alias("v"))
    found = exact_percentiles(values, [], {"s": [0.25, 0.5, 0.9]})
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2


def test_a_rank_outside_its_bracket_raises(spark, monkeypatch):
    from pyspark.errors import PySparkException

    from plumbline.operators import percentiles

    found = percentiles.brackets
    monkeypatch.setattr(percentiles, "brackets", lambda *a: found(*a).withColumn("lo", F.col("hi")))
    values = spark.range(1000).select(F.lit("s").alias("series"), F.col("id").cast("double").alias("v"))
    with pytest.raises(PySparkException, match="outside its bracket"):
        exact_percentiles(values, [], {"s": [0.5]}).collect()


def test_a_fence_counts_readings_and_gathers_none(spark, sf_dir):
    past = load(spark, sf_dir, "events").selectExpr("event_type AS check_id", "ts AS executed_at", "value AS actual_value")
    assert "collect_list" not in plan_of(history.anomaly_fence(past, ["check_id"], "2024-01-31"))
    assert "WindowGroupLimit" in plan_of(history.anomaly_fence(past, ["check_id"], "2024-01-31", newest=1000))


def test_patterns_do_not_sort_all_characters_of_a_task(spark):
    codes = spark.createDataFrame([(f"AB-{i:05d}",) for i in range(1000)], "code string")
    known = inference.infer(codes, "t").first()
    assert known.regex == r"^AB\-0{2}\d{3}$"
    (patterns,) = inference._fixed_length_patterns(codes, [known])
    # Below the lowest shuffle there are hash aggregates only, whose memory does not grow with the rows.
    lowest = plan_of(patterns).split("Exchange")[-1]
    assert "HashAggregate" in lowest and "Sort" not in lowest
