"""Headline queries on the bench tables; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local
threads (default 8). Every query runs once on the smallest tables, to load code,
and is then timed up to three times on the bench tables, plan building included; the median
counts. `build` is the part of it that goes into the plan, and jobs run for it.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators.duplicates import duplicate_rows  # noqa: E402
from plumbline.operators.measure import Probe, measure  # noqa: E402
from plumbline.session import session  # noqa: E402
from workload import registry  # noqa: E402
from workload.sensor_cases import CASES  # noqa: E402
from workload.tables import load  # noqa: E402

HEADLINES = [
    "checks_on_lineitem",
    "checks_on_orders",
    "checks_on_documents",
    "checks_on_event_points",
    "checks_per_day_and_type_with_cascade",
    "profile_of_lineitem",
    "profile_with_sketches",
    "inferred_patterns",
    "sensor_foreign_key_found_percent",
    "sensor_duplicate_record_count",
    "sensor_median_value",
    "sensor_expected_texts_top_n_count",
    "expect_values_increasing",
    "expect_multicolumn_unique",
    "anomaly_fences",
    "change_against_7_days_before",
    "dimension_scores",
    "incidents_of_the_history",
    "checks_reconciled",
    "stream_daily_sensors",
]


def scan_sensors(spark, sf_dir):
    """All scan sensors the workload takes of the line items, in one pass."""
    cases = [c for c in CASES.values() if c.table == "lineitem" and Probe(c.sensor, c.sensor).definition.family == "scan"]
    probes = [Probe(c.sensor, c.sensor, c.column, c.params) for c in cases]
    return measure(load(spark, sf_dir, "lineitem"), probes)


def scan_sensors_one_by_one(spark, sf_dir):
    """The same sensors, a job each: what fusing saves."""
    cases = [c for c in CASES.values() if c.table == "lineitem" and Probe(c.sensor, c.sensor).definition.family == "scan"]
    df = load(spark, sf_dir, "lineitem")
    for c in cases:
        measure(df, [Probe(c.sensor, c.sensor, c.column, c.params)]).collect()
    return df.limit(1)


def foreign_keys_by_sort_merge(spark, sf_dir):
    """The orders' customers looked up by a sort-merge join of all rows, for comparison with the key lookup."""
    orders = load(spark, sf_dir, "lineitem").select("l_orderkey")
    known = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("known"))
    return orders.join(known.hint("merge"), "l_orderkey", "left").agg(F.count("l_orderkey"), F.count("known"))


def foreign_keys_by_count(spark, sf_dir):
    """The same question with keys counted before the join."""
    probe = Probe("p", "foreign_key_found_percent", "l_orderkey", {"reference_table": "orders", "reference_column": "o_orderkey"})
    return measure(load(spark, sf_dir, "lineitem"), [probe], tables={"orders": load(spark, sf_dir, "orders")})


def duplicates_by_hash(spark, sf_dir):
    return duplicate_rows(load(spark, sf_dir, "lineitem"))


def duplicates_by_grouping(spark, sf_dir):
    """Whole rows grouped at once, for comparison."""
    return duplicate_rows(load(spark, sf_dir, "lineitem"), broadcast_up_to=-1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    runs = {name: queries[name] for name in HEADLINES}
    runs["scan_sensors_fused"] = scan_sensors
    runs["scan_sensors_one_job_each"] = scan_sensors_one_by_one
    sides = [foreign_keys_by_count, foreign_keys_by_sort_merge, duplicates_by_hash, duplicates_by_grouping]
    runs |= {side.__name__: side for side in sides}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds, build = {}, {}
    for name, query in runs.items():
        if os.path.isdir(small):
            query(spark, small).collect()
        took = []
        for _ in range(3):
            start = time.perf_counter()
            df = query(spark, sf_dir)
            built = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - start, built - start))
            if sum(t for t, _ in took) > 3:  # a long query varies little
                break
        middle = sorted(took)[len(took) // 2]
        seconds[name], build[name] = round(middle[0], 3), round(middle[1], 3)
    total = sum(seconds[name] for name in [*HEADLINES, "scan_sensors_fused"])
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "build": build,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
