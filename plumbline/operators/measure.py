"""Measuring many sensors of a table in as few passes as possible.

All scan sensors of a table become one aggregate, cut into bundles of whole
columns so that a bundle stays small enough for generated code while every
column is still read once. Exact distinct counts get one aggregate per column:
inside one aggregate k of them would multiply every row by k + 1, and the other
counters would travel with every distinct value. Percentiles, whole-row
comparisons, lookups and comparisons have operators of their own. Every family
ends in rows of (probe_id, partition, sensor_value), so the rest is a union.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import quoted
from plumbline.operators import catalog, compare, history, keys
from plumbline.operators.duplicates import duplicate_rows
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.sensors import SENSORS, Sensor, Target

_BUNDLE = 48


@dataclass(frozen=True)
class Probe:
    """One measurement to take: a sensor, the column it looks at, its parameters."""

    probe_id: str
    sensor: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    where: str | None = None

    @property
    def definition(self) -> Sensor:
        return SENSORS[self.sensor]

    @property
    def settings(self) -> dict[str, Any]:
        return self.definition.params(self.params)


@dataclass
class Distincts:
    """Columns a distinct sensor is finished from."""

    distinct: Column
    present: Column
    rows: Column
    values: Column


def invalid_reason(df: DataFrame, probe: Probe) -> str | None:
    """Why a probe cannot run, or None. Only the plan is analysed, no job runs."""
    from pyspark.errors import AnalysisException

    if probe.sensor not in SENSORS:
        return f"unknown sensor {probe.sensor}"
    sensor, settings = probe.definition, probe.params
    missing = [name for name in sensor.required if settings.get(name) in (None, "")]
    if missing:
        return "missing parameters: " + ", ".join(missing)
    if sensor.needs_column and probe.column is None:
        return "a column is required"
    if sensor.family == "schema":
        return None
    if sensor.needs_column and probe.column not in df.columns:
        return f"unknown column {probe.column}"
    try:
        rows = df.filter(F.expr(probe.where)) if probe.where else df
        if sensor.family == "scan":
            rows.agg(_scan_column(df, probe)).schema  # noqa: B018
        elif sensor.family == "percentile":
            rows.select(_target(df, probe.column).number.cast("double")).schema  # noqa: B018
    except AnalysisException as error:
        return str(error).split("\n")[0]
    return None


def _target(df: DataFrame, column: str | None) -> Target | None:
    return Target(column, df.schema[column].dataType.simpleString()) if column else None


def _scan_column(df: DataFrame, probe: Probe) -> Column:
    settings = probe.settings
    if probe.sensor == "valid_country_code_percent" and "expected_values" not in settings:
        from plumbline.functions.text import country_codes

        settings["expected_values"] = country_codes(df.sparkSession)
    return probe.definition.build(_target(df, probe.column), settings).cast("double")


def _long(wide: DataFrame, by: list[str], values: dict[str, Column | str]) -> DataFrame:
    """One aggregate row per partition turned into one row per probe."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("probe_id"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("sensor_value"))
            for i, v in values.items()
        ]
    )
    return wide.select(*by, F.inline(pairs))


def _bundles(probes: list[Probe]) -> list[list[Probe]]:
    """Probes in groups of at most _BUNDLE, a column's probes together where they fit."""
    per_column = defaultdict(list)
    for probe in probes:
        per_column[probe.column].append(probe)
    bundles: list[list[Probe]] = [[]]
    for group in per_column.values():
        for start in range(0, len(group), _BUNDLE):
            part = group[start : start + _BUNDLE]
            if bundles[-1] and len(bundles[-1]) + len(part) > _BUNDLE:
                bundles.append([])
            bundles[-1].extend(part)
    return [b for b in bundles if b]


def _scan(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    frames = []
    for bundle in _bundles(probes):
        columns = {f"m{i}": _scan_column(df, p) for i, p in enumerate(bundle)}
        wide = df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])
        frames.append(_long(wide, by, {p.probe_id: name for name, p in zip(columns, bundle)}))
    return frames


def _distinct(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    frames = []
    per_input = defaultdict(list)
    for probe in probes:
        wanted = tuple(map(str, probe.settings.get("expected_values", ()))) if "expected_values" in probe.settings else None
        per_input[(probe.column, wanted)].append(probe)
    for (column, wanted), group in per_input.items():
        target = _target(df, column)
        value = target.value if wanted is None else F.when(target.among(group[0].settings["expected_values"]), target.value)
        # Equal values are counted before the shuffle, so a frequent one costs one row.
        counted = df.select(*by, value.alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("copies"))
        known = F.col("value").isNotNull()
        summed = counted.groupBy(*by).agg(
            F.count("value").alias("distinct"),
            F.coalesce(F.sum(F.when(known, F.col("copies"))), F.lit(0)).alias("present"),
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        )
        d = Distincts(F.col("distinct"), F.col("present"), F.col("rows"), F.col("distinct"))
        frames.append(_long(summed, by, {p.probe_id: p.definition.build(d, p.settings) for p in group}))
    return frames


def _approximate_distinct(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    aggregates, finished = [], {}
    for i, probe in enumerate(probes):
        target = _target(df, probe.column)
        value = target.value
        if "expected_values" in probe.settings:
            value = F.when(target.among(probe.settings["expected_values"]), value)
        aggregates += [
            F.approx_count_distinct(value).alias(f"d{i}"),
            F.count(value).alias(f"p{i}"),
            F.count(F.lit(1)).alias(f"r{i}"),
        ]
        d = Distincts(F.col(f"d{i}"), F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"d{i}"))
        finished[probe.probe_id] = probe.definition.build(d, probe.settings)
    return [_long(df.groupBy(*by).agg(*aggregates), by, finished)]


def _percentile(df: DataFrame, probes: list[Probe], by: list[str], exact: bool) -> list[DataFrame]:
    if not exact:
        aggregates, finished = [], {}
        for i, p in enumerate(probes):
            number = _target(df, p.column).number.cast("double")
            aggregates.append(F.percentile_approx(number, float(p.settings["percentile"])).alias(f"q{i}"))
            finished[p.probe_id] = p.definition.build(F.col(f"q{i}"), p.settings)
        return [_long(df.groupBy(*by).agg(*aggregates), by, finished)]
    wanted = defaultdict(list)
    for p in probes:
        wanted[p.column].append(float(p.settings["percentile"]))
    series = F.array(
        *[F.struct(F.lit(c).alias("series"), _target(df, c).number.cast("double").alias("v")) for c in wanted]
    )
    values = df.select(*by, F.inline(series))
    found = exact_percentiles(values, by, wanted)
    # Groups without a single value still get a NULL reading.
    groups = df.select(*by).distinct() if by else df.agg(F.count(F.lit(1)).alias("rows")).select()
    frames = []
    asked = F.array(
        *[
            F.struct(
                F.lit(p.probe_id).alias("probe_id"),
                F.lit(p.column).alias("series"),
                F.lit(float(p.settings["percentile"])).alias("fraction"),
            )
            for p in probes
        ]
    )
    keyed = groups.select(*by, F.inline(asked)).alias("g")
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*by, "series", "fraction"]],
    )
    joined = keyed.join(found.alias("f"), same, "left").select(
        *[F.col(f"g.{k}") for k in by], F.col("g.probe_id").alias("probe_id"), F.col("f.value").alias("value")
    )
    finish = F.lit(None).cast("double")
    for p in probes:
        finish = F.when(F.col("probe_id") == p.probe_id, p.definition.build(F.col("value"), p.settings)).otherwise(finish)
    frames.append(joined.select(*by, "probe_id", finish.cast("double").alias("sensor_value")))
    return frames


def _duplicates(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    frames = []
    per_columns = defaultdict(list)
    for p in probes:
        per_columns[tuple(p.settings.get("columns", ()))].append(p)
    for columns, group in per_columns.items():
        counted = duplicate_rows(df, list(columns) or None, by)
        values = {p.probe_id: p.definition.build(F.col("duplicates"), F.col("rows")) for p in group}
        frames.append(_long(counted, by, values))
    return frames


def _top_values(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    """How many expected values are among the n most frequent ones; ties go to the smaller value."""
    from pyspark.sql import Window

    frames = []
    for p in probes:
        target, n = _target(df, p.column), int(p.settings["top_n"])
        counted = df.groupBy(*by, target.value.alias("value")).agg(F.count(F.lit(1)).alias("copies"))
        if by:
            ranked = Window.partitionBy(*by).orderBy(F.desc("copies"), F.asc("value"))
            top = counted.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= n)
        else:
            top = counted.orderBy(F.desc("copies"), F.asc("value")).limit(n)
        values = Target("value", target.data_type)
        hits = top.groupBy(*by).agg(F.count_if(values.among(p.settings["expected_values"])).alias("hits"))
        frames.append(_long(hits, by, {p.probe_id: "hits"}))
    return frames


def _foreign_keys(df: DataFrame, probes: list[Probe], by: list[str], tables: dict[str, DataFrame]) -> list[DataFrame]:
    frames = []
    per_lookup = defaultdict(list)
    for p in probes:
        per_lookup[(p.column, p.settings["reference_table"], p.settings["reference_column"])].append(p)
    for (column, table, reference_column), group in per_lookup.items():
        counted = keys.key_lookup(df, column, tables[table], reference_column, by)
        finish = {"foreign_key_not_found_count": keys.missing_count(), "foreign_key_found_percent": keys.found_percent()}
        frames.append(_long(counted, by, {p.probe_id: finish[p.sensor] for p in group}))
    return frames


def _references(df: DataFrame, probes: list[Probe], by: list[str], tables: dict[str, DataFrame]) -> list[DataFrame]:
    frames = []
    per_table = defaultdict(list)
    for p in probes:
        per_table[p.settings["reference_table"]].append(p)
    for table, group in per_table.items():
        current = {p.probe_id: (p.settings["statistic"], p.column) for p in group}
        reference = {
            p.probe_id: (p.settings["statistic"], p.settings["reference_column"] if p.column else None) for p in group
        }
        sides = compare.paired(
            compare.statistics(df, current, by), compare.statistics(tables[table], reference, by), [*by, "statistic"]
        )
        value = F.lit(None).cast("double")
        for p in group:
            graded = compare.match_percent(
                p.sensor, F.col("current_value"), F.col("reference_value"), p.settings["tolerance_percent"]
            )
            value = F.when(F.col("statistic") == p.probe_id, graded).otherwise(value)
        frames.append(sides.select(*by, F.col("statistic").alias("probe_id"), value.cast("double").alias("sensor_value")))
    return frames


def _earlier(df: DataFrame, probes: list[Probe], by: list[str], exact: bool, readings: DataFrame | None) -> list[DataFrame]:
    """Change against the same metric's reading 1, 7 or 30 days ago.

    `readings` has metric_id, executed_at, actual_value (and the partition). A
    probe's metric is its `metric_id` parameter, or "sensor:column".
    """
    if readings is None:
        raise ValueError("history sensors need the readings history")
    # One measurement for all gaps: the same metric is asked for 1, 7 and 30 days.
    bases, asked = {}, []
    for p in probes:
        base_id = f"{p.settings['base']}:{p.column or ''}"
        bases[base_id] = Probe(base_id, p.settings["base"], p.column, {}, None)
        metric_id, as_of = p.settings.get("metric_id") or base_id, p.settings.get("as_of")
        asked.append((p.probe_id, base_id, metric_id, None if as_of is None else str(as_of), int(p.settings["days"]), bool(p.settings["absolute"])))
    now = measure(df, list(bases.values()), by=by, exact=exact).withColumnRenamed("probe_id", "base_id")
    questions = df.sparkSession.createDataFrame(
        asked, "probe_id string, base_id string, metric_id string, as_of string, days int, absolute boolean"
    )
    bands = sorted({(as_of, days) for _, _, _, as_of, days, _ in asked}, key=str)
    earlier = history.earlier_readings(readings, questions, bands, by)
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by], F.col("n.probe_id") == F.col("e.probe_id"))
    # The questions are as many as the caller's probes.
    compared = now.join(F.broadcast(questions), "base_id").alias("n").join(earlier.alias("e"), same, "left")
    value, before = F.col("n.sensor_value"), F.col("e.earlier_value")
    change = F.when(F.col("n.absolute"), history.percent_change(value, before, True)).otherwise(
        history.percent_change(value, before, False)
    )
    return [compared.select(*[F.col(f"n.{k}") for k in by], F.col("n.probe_id").alias("probe_id"), change.alias("sensor_value"))]


def _known(df: DataFrame, probes: list[Probe], by: list[str], values: dict[str, Column]) -> list[DataFrame]:
    """Readings that hold for the whole table, given to each of its partitions."""
    groups = df.select(*by).distinct() if by else df.agg(F.count(F.lit(1)).alias("rows"))
    return [_long(groups, by, values)]


def _files(df: DataFrame, probes: list[Probe], by: list[str]) -> list[DataFrame]:
    """Seconds since the table's newest file was written."""
    from plumbline.functions.shares import seconds_since

    newest = df.select(*by, F.col("_metadata.file_modification_time").alias("written")).groupBy(*by).agg(
        F.max("written").alias("written")
    )
    return [_long(newest, by, {p.probe_id: seconds_since(F.col("written"), p.settings.get("as_of")) for p in probes})]


def measure(
    df: DataFrame,
    probes: list[Probe],
    *,
    by: list[str] | None = None,
    exact: bool = True,
    tables: dict[str, DataFrame] | None = None,
    readings: DataFrame | None = None,
) -> DataFrame:
    """Take all probes of one table; rows of (partition columns, probe_id, sensor_value).

    `by` measures every partition on its own. `tables` are the reference tables by
    name, `readings` the history of metrics. With `exact=False` distinct counts
    and percentiles come from sketches and join the single pass.
    """
    by, tables = by or [], tables or {}
    frames: list[DataFrame] = []
    filters = defaultdict(list)
    for p in probes:
        condition = p.where
        if p.definition.present_only:
            present = f"{quoted(p.column)} IS NOT NULL"
            condition = present if condition is None else f"({condition}) AND {present}"
        filters[condition].append(p)
    for condition, group in filters.items():
        rows = df.filter(F.expr(condition)) if condition else df
        family = defaultdict(list)
        for p in group:
            family[p.definition.family].append(p)
        if family["scan"]:
            frames += _scan(rows, family["scan"], by)
        if family["distinct"]:
            frames += (_distinct if exact else _approximate_distinct)(rows, family["distinct"], by)
        if family["percentile"]:
            frames += _percentile(rows, family["percentile"], by, exact)
        if family["duplicates"]:
            frames += _duplicates(rows, family["duplicates"], by)
        if family["top_values"]:
            frames += _top_values(rows, family["top_values"], by)
        if family["foreign_key"]:
            frames += _foreign_keys(rows, family["foreign_key"], by, tables)
        if family["reference"]:
            frames += _references(rows, family["reference"], by, tables)
        if family["history"]:
            frames += _earlier(rows, family["history"], by, exact, readings)
        if family["files"]:
            frames += _files(rows, family["files"], by)
        if family["schema"]:
            values = {
                p.probe_id: F.lit(catalog.schema_reading(df, p.sensor, p.column, p.settings)) for p in family["schema"]
            }
            frames += _known(rows, family["schema"], by, values)
        if family["external"]:
            values = {p.probe_id: F.lit(float(p.settings["imported_value"])) for p in family["external"]}
            frames += _known(rows, family["external"], by, values)
    return reduce(DataFrame.unionByName, frames)


def import_readings(readings: DataFrame, outside: DataFrame) -> DataFrame:
    """Add readings taken elsewhere, so that they are graded with the rest."""
    return readings.unionByName(outside.select(*readings.columns))
