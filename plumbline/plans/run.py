"""Running checks: validate, measure together, grade together."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import compare, history, rules
from plumbline.operators.checks import CHECKS, CheckType, dimension_of
from plumbline.operators.expectations import EXPECTATIONS, Expect, expect
from plumbline.operators.measure import Probe, invalid_reason, measure

_AVAILABILITY = "table_availability"
_MATCH_CHECKS = {name for name, c in CHECKS.items() if name.endswith("_match") and c.category == "comparison"}


@dataclass(frozen=True)
class Check:
    """A check type applied to a table: what `run_checks` runs.

    `thresholds` maps a severity to its limits; without it the catalogue's
    defaults apply. `params` go to the sensor; a limit named there overrides the
    chosen threshold. A `*_match` check names its second source by the
    `reference_table` parameter.
    """

    check_id: str
    check_type: str
    table: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    where: str | None = None
    active: bool = True

    @property
    def kind(self) -> CheckType:
        return CHECKS[self.check_type]

    @property
    def probe(self) -> Probe:
        return Probe(self.check_id, self.kind.sensor, self.column, self.params, self.where)

    def limits(self) -> dict[str, dict[str, float] | None]:
        """Limits per severity: catalogue defaults below, own thresholds above, unset ones dropped."""
        wanted = rules.RULE_THRESHOLDS[self.kind.rule]
        own = {
            s: {k: float(v) for k, v in t.items() if v is not None} for s, t in self.thresholds.items() if t
        }
        own = {s: t for s, t in own.items() if t} or {"error": {}}
        override = {k: float(v) for k, v in self.params.items() if k in wanted and v is not None}
        full = {}
        for severity in rules.SEVERITIES:
            if severity in own:
                merged = {**self.kind.thresholds, **own[severity], **override}
                full[severity] = {k: v for k, v in merged.items() if k in wanted}
            else:
                full[severity] = None
        return full


CHECK_SCHEMA = (
    "check_id string, check_type string, table_name string, column_name string, sensor string, rule string, "
    "category string, dimension string, is_active boolean, "
    + ", ".join(f"{s} {rules.THRESHOLD_TYPE}" for s in rules.SEVERITIES)
)


def checks_table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """The checks as a table, one row each."""
    rows = []
    for c in checks:
        limits = c.limits()
        structs = [
            None if limits[s] is None else {t: limits[s].get(t) for t in rules.THRESHOLDS} for s in rules.SEVERITIES
        ]
        kind = c.kind
        rows.append(
            (c.check_id, c.check_type, c.table, c.column, kind.sensor, kind.rule, kind.category, kind.dimension, c.active, *structs)
        )
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def _both_sides(check: Check) -> tuple[Probe, Probe]:
    """What a `*_match` check measures on its own table and on the reference: the same filter holds for both."""
    here = Probe(check.check_id, check.kind.sensor, check.column, {}, check.where)
    there = Probe(check.check_id, check.kind.sensor, check.params.get("reference_column", check.column), {}, check.where)
    return here, there


def _match_readings(
    checks: list[Check], counters: list[Probe], tables: dict[str, DataFrame], parts: list[str], exact: bool
) -> list[DataFrame]:
    """The same sensor on two sources, per partition, as a symmetric agreement in percent; counters of the first source."""
    frames = []
    sides = defaultdict(list)
    for c in checks:
        sides[(c.table, c.params.get("reference_table", c.table))].append(c)
    for (left, right), group in sides.items():
        here, there = zip(*map(_both_sides, group))
        both = compare.paired(
            measure(tables[left], [*here, *counters], by=parts, exact=exact),
            measure(tables[right], list(there), by=parts, exact=exact),
            [*parts, "probe_id"],
            "sensor_value",
        )
        agreed = compare.agreement(F.col("current_value"), F.col("reference_value"))
        counted = F.col("probe_id").isin([c.probe_id for c in counters])
        frames.append(both.select(*parts, "probe_id", F.when(counted, F.col("current_value")).otherwise(agreed).alias("sensor_value")))
    return frames


def _stated(check: Check) -> bool:
    """Whether a check is an expectation: a statement with limits of its own."""
    return check.check_type in EXPECTATIONS and check.check_type not in CHECKS


def _problem(check: Check, tables: dict[str, DataFrame], readings: DataFrame | None) -> str | None:
    if _stated(check):
        if check.table not in tables:
            return f"unknown table {check.table}"
        try:
            _judged([check], tables).schema  # noqa: B018
        except (PySparkException, KeyError, ValueError, TypeError) as error:
            return str(error).split("\n")[0]
        return None
    if check.check_type not in CHECKS:
        return f"unknown check type {check.check_type}"
    try:
        check.limits()
    except (TypeError, ValueError) as error:
        return f"a limit is no number: {error}"
    if check.table not in tables:
        # A table that cannot be found is what an availability check reports.
        return None if check.check_type == _AVAILABILITY else f"unknown table {check.table}"
    matching = check.check_type in _MATCH_CHECKS
    here, there = _both_sides(check) if matching else (check.probe, None)
    reason = invalid_reason(tables[check.table], here)
    if reason:
        return reason
    other = check.params.get("reference_table", check.table if matching else None)
    if other is not None and other not in tables:
        return f"unknown table {other}"
    if there is not None:
        return invalid_reason(tables[other], there)
    column = check.params.get("reference_column")
    if other is not None and column is not None and column not in tables[other].columns:
        return f"unknown column {column} of {other}"
    if readings is None and here.definition.family == "history":
        return "the history of readings is needed"
    return None


def _judged(checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """Expectations judged, as graded rows; those of one table and filter share their passes.

    A broken one has the gravest severity that its thresholds name, or is an error.
    """
    frames = []
    groups = defaultdict(list)
    for c in checks:
        groups[(c.table, c.where)].append(c)
    for (table, where), group in groups.items():
        df = tables[table].filter(F.expr(where)) if where else tables[table]
        counter = Expect("rows scanned", "row_count_min", None, {"min_value": 0})
        stated = [Expect(c.check_id, c.check_type, c.column, c.params) for c in group]
        judged = expect(df, [*stated, counter], tables=tables)
        # One row per expectation: a window over the caller's list.
        is_counter = F.col("expectation_id") == counter.expectation_id
        total = F.max(F.when(is_counter, F.col("observed_value"))).over(Window.partitionBy(F.lit(1))).cast("bigint")
        frames.append(judged.withColumn("rows_scanned", total).filter(~is_counter))
    spark = frames[0].sparkSession
    rows = [
        (c.check_id, c.table, c.column, dimension_of(c.check_type), next((s for s in rules.SEVERITIES if c.thresholds.get(s) is not None), "error"), json.dumps(c.params, sort_keys=True, default=str))
        for c in checks
    ]
    stated = spark.createDataFrame(
        rows, "check_id string, table_name string, column_name string, dimension string, broken string, expected string"
    )
    # The statements are as long as the caller's list.
    joined = reduce(DataFrame.unionByName, frames).withColumnRenamed("expectation_id", "check_id").join(F.broadcast(stated), "check_id")
    return joined.select(
        "check_id",
        "check_type",
        "dimension",
        "table_name",
        "column_name",
        F.col("observed_value").alias("actual_value"),
        "expected",
        "passed",
        F.when(F.col("passed"), "passed").otherwise(F.col("broken")).alias("severity"),
        "rows_scanned",
        F.concat("check_type", F.when(F.col("passed"), " holds").otherwise(" does not hold")).alias("message"),
    )


def reason_of(error: Exception) -> str:
    """The first line that says what went wrong."""
    lines = str(error).split("\n")
    return lines[1].removeprefix(": ") if isinstance(error, Py4JJavaError) and len(lines) > 1 else lines[0]


def _cannot_be_planned(checks: list[Check], plan: Callable[[list[Check]], DataFrame]) -> dict[str, str]:
    """Checks whose part of the plan cannot be made, with the reason. All are planned at once; only if that fails, halves are."""
    try:
        plan(checks).schema  # noqa: B018
        return {}
    except (PySparkException, Py4JJavaError, KeyError, TypeError, ValueError) as error:
        if len(checks) == 1:
            return {checks[0].check_id: reason_of(error)}
    half = len(checks) // 2
    return _cannot_be_planned(checks[:half], plan) | _cannot_be_planned(checks[half:], plan)


def _unreadable(checks: list[Check], tables: dict[str, DataFrame]) -> dict[str, str]:
    """Tables asked for their availability that give no row and no end, with the reason; the first row is read."""
    found = {}
    for table in sorted({c.table for c in checks if c.check_type == _AVAILABILITY and c.table in tables}):
        try:
            tables[table].limit(1).collect()
        except (PySparkException, Py4JJavaError) as error:
            found[table] = reason_of(error)
    return found


def problems(checks: list[Check], tables: dict[str, DataFrame], readings: DataFrame | None = None) -> dict[str, str]:
    """Why checks cannot run, by check id. Nothing is executed."""
    found = {c.check_id: _problem(c, tables, readings) for c in checks}
    return {check_id: reason for check_id, reason in found.items() if reason}


def take_readings(
    checks: list[Check],
    tables: dict[str, DataFrame],
    *,
    by: Callable[[str], list[str]] | None = None,
    exact: bool = True,
    readings: DataFrame | None = None,
) -> DataFrame:
    """Readings (check_id, partition values, rows_scanned, actual_value) of checks, one fused run per table."""
    frames = []
    per_table = defaultdict(list)
    for c in checks:
        per_table[c.table].append(c)
    for table, group in per_table.items():
        df, parts = tables[table], by(table) if by else []
        single = [c for c in group if c.check_type not in _MATCH_CHECKS]
        double = [c for c in group if c.check_type in _MATCH_CHECKS]
        taken = []
        for some, matching in ((single, False), (double, True)):
            if not some:
                continue
            # One row counter per distinct filter, in the same pass as its sensors.
            prefix = "rows "
            while any(c.check_id.startswith(prefix) for c in some):  # no check has the name of a counter
                prefix += "of "
            filters = {c.where: f"{prefix}{i}" for i, c in enumerate(some)}
            counters = [Probe(name, "row_count", None, {}, where) for where, name in filters.items()]
            if matching:
                measured = reduce(DataFrame.unionByName, _match_readings(some, counters, tables, parts, exact)).distinct()
            else:
                probes = [c.probe for c in some] + counters
                measured = measure(df, probes, by=parts, exact=exact, tables=tables, readings=readings)
            counted = F.col("probe_id").isin(*filters.values())
            scope = F.lit(None).cast("string")
            for where, name in filters.items():
                ids = [c.check_id for c in some if c.where == where]
                scope = F.when(F.col("probe_id").isin(*ids, name), F.lit(name)).otherwise(scope)
            partition = F.to_json(F.struct(*parts)) if parts else F.lit(None).cast("string")
            rows = measured.select(
                partition.alias("partition"),
                "probe_id",
                "sensor_value",
                scope.alias("scope"),
                counted.alias("is_counter"),
            )
            # Readings of one table number its checks times its partitions: a small shuffle.
            same = Window.partitionBy("partition", "scope")
            total = F.max(F.when(F.col("is_counter"), F.col("sensor_value"))).over(same).cast("bigint")
            taken.append(
                rows.withColumn("rows_scanned", total)
                .filter(~F.col("is_counter"))
                .select(F.col("probe_id").alias("check_id"), "partition", "rows_scanned", F.col("sensor_value").alias("actual_value"))
            )
        frames += taken
    return reduce(DataFrame.unionByName, frames)


def run_checks(
    spark: SparkSession,
    checks: list[Check],
    tables: dict[str, DataFrame],
    *,
    by: Callable[[str], list[str]] | None = None,
    exact: bool = True,
    cascade: bool = False,
    executed_at: str | None = None,
    results: DataFrame | None = None,
    readings: DataFrame | None = None,
    outside: DataFrame | None = None,
    fence_days: int = fixed.ANOMALY_DAYS,
    fence_readings: int | None = None,
    broken: dict[str, str] | None = None,
) -> DataFrame:
    """Run checks and return graded result rows; nothing is stored (see `sources.results`).

    All checks of a table share its passes. A check that cannot run gives a failed
    row with an error message and does not stop the others. `results` is the
    earlier history (for anomaly fences), `readings` the history of plain metrics
    (for day-to-day changes), `outside` readings taken elsewhere
    (check_id, actual_value) that are graded with the rest. An availability check of
    a table that is not given, or whose first row cannot be read, reads 0. Expectations run next to checks, on whole tables. `fence_days` and `fence_readings` say how much of
    the history an anomaly fence looks at (see `history.anomaly_fence`). `broken` are
    reasons, by check id, why checks are known to fail; nothing is measured for them.
    Errors of the data, such as a division by zero in a condition, appear only when the
    rows are computed: `sources.results.run_and_append` keeps them to their check.
    """
    unreadable = _unreadable([c for c in checks if c.active], tables)
    tables = {name: df for name, df in tables.items() if name not in unreadable}
    refused = {**problems(checks, tables, readings), **(broken or {})}
    for c in checks:
        if c.check_id in refused and c.table in unreadable:
            refused[c.check_id] = f"table {c.table} cannot be read: {unreadable[c.table]}"
    runnable = [c for c in checks if c.check_id not in refused and c.active]
    stated = [c for c in runnable if _stated(c)]
    runnable = [c for c in runnable if not _stated(c)]
    absent = [c for c in runnable if c.table not in tables]
    runnable = [c for c in runnable if c.table in tables]
    if runnable:
        planned: list[DataFrame] = []

        def plan(some: list[Check]) -> DataFrame:
            planned.append(take_readings(some, tables, by=by, exact=exact, readings=readings))
            return planned[-1]

        unplanned = _cannot_be_planned(runnable, plan)
        refused |= unplanned
        whole_plan = planned[0] if planned and not unplanned else None
        runnable = [c for c in runnable if c.check_id not in unplanned]
    now = F.lit(executed_at).cast("timestamp") if executed_at else F.current_timestamp()
    frames = []
    if runnable:
        frames.append(whole_plan or take_readings(runnable, tables, by=by, exact=exact, readings=readings))
    if absent:
        frames.append(
            spark.createDataFrame(
                [(c.check_id, None, 0, 0.0) for c in absent],
                "check_id string, partition string, rows_scanned bigint, actual_value double",
            )
        )
    if outside is not None:
        frames.append(
            outside.select(
                "check_id",
                F.lit(None).cast("string").alias("partition"),
                F.lit(None).cast("bigint").alias("rows_scanned"),
                F.col("actual_value").cast("double").alias("actual_value"),
            )
        )
    known = [c for c in checks if c.check_type in CHECKS and c.check_id not in refused]
    definitions = checks_table(spark, known)
    graded_parts = []
    if frames:
        taken = reduce(DataFrame.unionByName, frames)
        # The checks table is as long as the caller's list, not as the data.
        full = taken.join(F.broadcast(definitions), "check_id")
        if results is not None and any(c.kind.rule == "anomaly_percentile" for c in runnable):
            # A partition of a check is compared with its own past.
            keys = ["check_id", "partition"] if "partition" in results.columns else ["check_id"]
            fences = history.anomaly_fence(results, keys, now, days=fence_days, newest=fence_readings).drop("q1", "q3")
            same = reduce(lambda a, b: a & b, [F.col(f"full.{k}").eqNullSafe(F.col(f"fences.{k}")) for k in keys])
            bounds = [F.col(f"fences.{c}") for c in fences.columns if c not in keys]
            full = full.alias("full").join(fences.alias("fences"), same, "left").select("full.*", *bounds)
        graded_parts.append(rules.grade(full, cascade=cascade).withColumn("error_message", F.lit(None).cast("string")))
    if stated:
        graded_parts.append(_judged(stated, tables).withColumn("error_message", F.lit(None).cast("string")))
    if refused:
        rows = [(c.check_id, c.check_type, c.table, c.column, refused[c.check_id]) for c in checks if c.check_id in refused]
        failed = spark.createDataFrame(
            rows, "check_id string, check_type string, table_name string, column_name string, error_message string"
        ).select(
            "*",
            F.lit(False).alias("passed"),
            F.lit("error").alias("severity"),
            F.concat(F.lit("Check could not run: "), F.col("error_message")).alias("message"),
        )
        graded_parts.append(failed)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graded_parts)
    for name, kind in RESULT_COLUMNS.items():
        if name not in whole.columns:
            whole = whole.withColumn(name, F.lit(None).cast(kind))
    return whole.withColumn("executed_at", now).select(*RESULT_COLUMNS)


RESULT_COLUMNS = {
    "check_id": "string",
    "check_type": "string",
    "dimension": "string",
    "table_name": "string",
    "column_name": "string",
    "partition": "string",
    "executed_at": "timestamp",
    "actual_value": "double",
    "expected": "string",
    "passed": "boolean",
    "severity": "string",
    "rows_scanned": "bigint",
    "message": "string",
    "error_message": "string",
}


def preview(spark: SparkSession, check: Check, tables: dict[str, DataFrame], **options: Any) -> DataFrame:
    """The graded result of one check, not stored."""
    return run_checks(spark, [check], tables, **options)
