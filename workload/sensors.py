"""A query for every sensor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.measure import Probe, measure
from plumbline.operators.sensors import SENSORS
from workload.sensor_cases import CASES, DAY, EARLIER_METRICS, Case
from workload.tables import load

_ON_THE_DAY = f"CAST(o_orderdate AS DATE) = DATE'{DAY}'"


def daily_readings(orders: DataFrame) -> DataFrame:
    """Every day's metrics of the orders, taken at 1 o'clock the next morning."""
    per_day = orders.withColumn("day", F.col("o_orderdate").cast("date"))
    probes = []
    for metric, column in EARLIER_METRICS.items():
        base = SENSORS[f"{metric}_change_1_day"].defaults["base"]
        probes.append(Probe(f"{base}:{column or ''}", base, column))
    taken = measure(per_day, probes, by=["day"])
    return taken.select(
        F.col("probe_id").alias("metric_id"),
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 25 HOURS")).alias("executed_at"),
        F.col("sensor_value").alias("actual_value"),
    )


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, case.table)
        tables, readings, where = {}, None, None
        if "reference_table" in case.params:
            tables[case.params["reference_table"]] = load(spark, sf_dir, case.params["reference_table"])
        if SENSORS[case.sensor].family == "history":
            readings, where = daily_readings(df), _ON_THE_DAY
        probe = Probe(case.sensor, case.sensor, case.column, case.params, where)
        taken = measure(df, [probe], tables=tables, readings=readings)
        return taken.select(F.col("probe_id").alias("sensor"), F.round("sensor_value", 6).alias("sensor_value"))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"sensor_{name}": _query(case) for name, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        f"sensor_{name}": f"SELECT '{name}' AS sensor, round(CAST(v AS DOUBLE), 6) AS sensor_value FROM ({case.scalar()})"
        for name, case in CASES.items()
        if case.scalar() is not None
    }
