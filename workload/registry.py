"""All queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.run import Check, run_checks
from workload import checks, expectations, history, profiles, sensors, streams
from workload.tables import load

_MODULES = (sensors, expectations, checks, history, profiles, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        Check("customer is set", "nulls_percent", "orders", "o_custkey"),
        Check("key is unique", "distinct_percent", "orders", "o_orderkey", thresholds={"error": {"min_percent": 100}}),
        Check(
            "price is plausible",
            "number_in_range_percent",
            "orders",
            "o_totalprice",
            {"min_value": 0, "max_value": 400000},
        ),
    ]
    return run_checks(
        spark, checks, {"orders": load(spark, sf_dir, "orders")}, executed_at="2024-02-01 00:00:00"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found.update(module.queries())
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found.update(module.oracle_sql())
    return found
