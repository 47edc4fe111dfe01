"""Expectations: statements about a table that hold or do not.

They differ from checks in that the statement carries its own limits and most of
them tolerate a share of exceptions (`mostly`). NULLs are left out of that share.
All expectations that are plain aggregates share one pass over the table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import named
from plumbline.functions.shares import percent, rows
from plumbline.operators.duplicates import share_of_unique_rows
from plumbline.operators.ordering import ordered_pairs
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.sensors import Target


@dataclass(frozen=True)
class ExpectationType:
    name: str
    category: str
    family: str
    build: Callable[..., tuple[Column, Callable[[Column], Column]]] | None = None


@dataclass(frozen=True)
class Expect:
    """An expectation applied to a table's column (or to the table)."""

    expectation_id: str
    check_type: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)


EXPECTATIONS: dict[str, ExpectationType] = {}


def _add(name: str, category: str, family: str = "scan", build=None) -> None:
    EXPECTATIONS[name] = ExpectationType(name, category, family, build)


def _within(low: Any, high: Any) -> Callable[[Column], Column]:
    def test(observed: Column) -> Column:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (observed >= F.lit(low))
        if high is not None:
            inside = inside & (observed <= F.lit(high))
        return F.coalesce(inside, F.lit(False))

    return test


def _mostly(predicate: Callable[[Target, dict], Column]):
    """Share of the non-NULL values that satisfy a predicate, at least `mostly`."""

    def build(t: Target, p: dict):
        share = percent(F.count_if(t.value.isNotNull() & predicate(t, p)), F.count(t.value), 100.0) / 100
        return share, _within(p.get("mostly", 1.0), None)

    return build


def _bounded(aggregate: Callable[[Target], Column]):
    def build(t: Target, p: dict):
        return aggregate(t), _within(p.get("min_value"), p.get("max_value"))

    return build


def _parses(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).isNotNull()


def _pair(predicate: Callable[[Column, Column], Column]):
    """Share of the rows with both values for which a relation holds."""

    def build(t: Target, p: dict):
        other = F.col(p["column_b"])
        both = t.value.isNotNull() & other.isNotNull()
        share = percent(F.count_if(both & predicate(t.value, other)), F.count_if(both), 100.0) / 100
        return share, _within(p.get("mostly", 1.0), None)

    return build


# --- Fixed values: date formats and format letters ------------------------------------

DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
]

STRFTIME_LETTERS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
    "%z": "xx",
}


def spark_format(strftime: str) -> str:
    """A strftime format as a Spark datetime pattern: directives by the table, letters of their own quoted."""
    out = []
    for part in re.findall(r"%.|[^%]+", strftime):
        if part == "%%":
            out.append("%")
        elif part[0] == "%":
            if part not in STRFTIME_LETTERS:
                raise ValueError(f"unknown format directive {part}")
            out.append(STRFTIME_LETTERS[part])
        else:
            out.append(re.sub("[A-Za-z'\\[\\]{}#]+", lambda m: "'" + m[0].replace("'", "''") + "'", part))
    return "".join(out)


_add("row_count_min", "volume", build=lambda t, p: (rows(), _within(p["min_value"], None)))
_add("row_count_max", "volume", build=lambda t, p: (rows(), _within(None, p["max_value"])))
_add("row_count_exact", "volume", build=lambda t, p: (rows(), _within(p["value"], p["value"])))
_add("null_count", "nulls", build=lambda t, p: (F.count_if(t.value.isNull()), _within(None, p["max_value"])))
_add(
    "null_percent",
    "nulls",
    build=lambda t, p: (percent(F.count_if(t.value.isNull()), rows(), 0.0), _within(None, p["max_percent"])),
)
_add("not_null", "nulls", build=lambda t, p: (F.count_if(t.value.isNull()), _within(None, 0)))
_add(
    "completeness_percent",
    "nulls",
    build=lambda t, p: (
        percent(F.count(t.value), rows(), 100.0) / 100,
        _within(p.get("min_value"), p.get("max_value")),
    ),
)


def _outside(t: Target, p: dict):
    low, high = p.get("min_value"), p.get("max_value")
    out = F.lit(False)
    if low is not None:
        out = out | (t.value < F.lit(low))
    if high is not None:
        out = out | (t.value > F.lit(high))
    return F.count_if(out), _within(None, 0)


_add("value_range", "numeric", build=_outside)
_add("regex_pattern", "patterns", build=_mostly(lambda t, p: t.text.rlike(p["pattern"])))
_add("regex_not_match", "patterns", build=_mostly(lambda t, p: ~t.text.rlike(p["pattern"])))
_add("like_pattern", "patterns", build=_mostly(lambda t, p: t.text.like(p["pattern"])))
_add("allowed_values", "accepted_values", build=_mostly(lambda t, p: t.among(p["allowed_values"])))
_add("forbidden_values", "accepted_values", build=_mostly(lambda t, p: ~t.among(p["forbidden_values"])))
_add("column_pair_comparison", "comparison", build=_pair(lambda a, b: a > b))
_add("column_pair_equal", "comparison", build=_pair(lambda a, b: a == b))
_add("column_min", "numeric", build=_bounded(lambda t: F.min(t.number)))
_add("column_max", "numeric", build=_bounded(lambda t: F.max(t.number)))
_add("column_mean", "numeric", build=_bounded(lambda t: F.avg(t.number)))
_add("column_stddev", "statistical", build=_bounded(lambda t: F.stddev_samp(t.number)))
_add("column_sum", "numeric", build=_bounded(lambda t: F.sum(t.number)))
_add(
    "text_length_range",
    "text",
    build=_mostly(
        lambda t, p: _within(p.get("min_value"), p.get("max_value"))(F.length(t.text))
    ),
)
_add("text_length_exact", "text", build=_mostly(lambda t, p: F.length(t.text) == p["value"]))
_add("date_parseable", "datatype", build=_mostly(lambda t, p: _parses(t.text, p.get("formats", DATE_FORMATS))))
_add("json_parseable", "datatype", build=_mostly(lambda t, p: F.try_parse_json(t.text).isNotNull()))
_add("datetime_format", "datetime", build=_mostly(lambda t, p: _parses(t.text, [spark_format(p["format"])])))

_add("unique", "uniqueness", "distinct")
_add("uniqueness_percent", "uniqueness", "distinct")
_add("distinct_values_in_set", "accepted_values", "distinct")
_add("most_common_value", "uniqueness", "distinct")
_add("column_median", "numeric", "percentile")
_add("column_quantile", "numeric", "percentile")
_add("values_increasing", "change_detection", "ordering")
_add("values_decreasing", "change_detection", "ordering")
_add("composite_key_unique", "uniqueness", "keys")
_add("multicolumn_unique", "uniqueness", "keys")
_add("row_count_compare", "comparison", "compare")
_add("schema_column_exists", "schema", "schema")
_add("schema_column_count", "schema", "schema")
_add("schema_column_list", "schema", "schema")
_add("schema_column_order", "schema", "schema")
_add("column_type", "datatype", "schema")
_add("custom_sql", "custom_sql", "query")


def _verdict(e: Expect, observed: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(e.expectation_id).alias("expectation_id"),
        F.lit(e.check_type).alias("check_type"),
        observed.cast("double").alias("observed_value"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _scan(df: DataFrame, group: list[Expect]) -> list[DataFrame]:
    frames = []
    for start in range(0, len(group), 48):
        aggregates, verdicts = [], []
        for i, e in enumerate(group[start : start + 48]):
            target = Target(e.column, df.schema[e.column].dataType.simpleString()) if e.column else None
            observed, test = EXPECTATIONS[e.check_type].build(target, e.params)
            aggregates.append(observed.alias(f"e{i}"))
            verdicts.append(_verdict(e, F.col(f"e{i}"), test(F.col(f"e{i}"))))
        frames.append(df.agg(*aggregates).select(F.inline(F.array(*verdicts))))
    return frames


def _distinct(df: DataFrame, group: list[Expect]) -> list[DataFrame]:
    """From one row per distinct value with its number of rows."""
    frames = []
    per_column = defaultdict(list)
    for e in group:
        per_column[e.column].append(e)
    for column, members in per_column.items():
        target = Target("value", df.schema[column].dataType.simpleString())
        counted = (
            df.filter(named(column).isNotNull())
            .groupBy(named(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        aggregates = [
            F.count(F.lit(1)).alias("distinct"),
            F.coalesce(F.sum("copies"), F.lit(0)).alias("present"),
            F.count_if(F.col("copies") > 1).alias("repeated"),
        ]
        for i, e in enumerate(members):
            if e.check_type == "distinct_values_in_set":
                aggregates.append(F.count_if(~target.among(e.params["value_set"])).alias(f"strange{i}"))
        summed = counted.agg(*aggregates)
        verdicts = []
        for i, e in enumerate(members):
            if e.check_type == "unique":
                verdicts.append(_verdict(e, F.col("repeated"), F.col("repeated") == 0))
            elif e.check_type == "uniqueness_percent":
                share = percent(F.col("distinct"), F.col("present"), 100.0) / 100
                verdicts.append(_verdict(e, share, _within(e.params.get("min_value"), e.params.get("max_value"))(share)))
            elif e.check_type == "distinct_values_in_set":
                verdicts.append(_verdict(e, F.col(f"strange{i}"), F.col(f"strange{i}") == 0))
        if verdicts:
            frames.append(summed.select(F.inline(F.array(*verdicts))))
        for e in members:
            if e.check_type == "most_common_value":
                frames.append(_most_common(counted, target, e))
    return frames


def _most_common(counted: DataFrame, target: Target, e: Expect) -> DataFrame:
    """Modes: the values whose count is the highest. All must be in the set, or, with ties_okay, one."""
    known = target.among(e.params["value_set"])
    # Per count: how many values have it, how many of them are known. The top row is the modes.
    modes = (
        counted.groupBy("copies")
        .agg(F.count(F.lit(1)).alias("modes"), F.count_if(known).alias("known"))
        .agg(F.max(F.struct("copies", "modes", "known")).alias("top"))
    )
    one = F.col("top.known") >= 1
    if not e.params.get("ties_okay", True):
        one = one & (F.col("top.modes") == 1)
    return modes.select(F.inline(F.array(_verdict(e, F.col("top.modes"), one))))


def _percentile(df: DataFrame, group: list[Expect]) -> list[DataFrame]:
    wanted: dict[str, list[float]] = defaultdict(list)
    for e in group:
        wanted[e.column] += e.params.get("quantiles", [0.5])
    series = F.array(
        *[
            F.struct(F.lit(c).alias("series"), Target(c, df.schema[c].dataType.simpleString()).number.cast("double").alias("v"))
            for c in wanted
        ]
    )
    found = exact_percentiles(df.select(F.inline(series)), [], wanted)
    frames = []
    aggregates, verdicts = [], []
    for i, e in enumerate(group):
        quantiles = e.params.get("quantiles", [0.5])
        ranges = e.params.get("ranges", [[e.params.get("min_value"), e.params.get("max_value")]])
        inside = F.lit(0)
        for j, (q, (low, high)) in enumerate(zip(quantiles, ranges)):
            mine = (F.col("series") == e.column) & (F.col("fraction") == float(q))
            aggregates.append(F.max(F.when(mine, F.col("value"))).alias(f"q{i}_{j}"))
            inside = inside + _within(low, high)(F.col(f"q{i}_{j}")).cast("int")
        observed = F.col(f"q{i}_0") if e.check_type == "column_median" else inside
        verdicts.append(_verdict(e, observed, inside == len(quantiles)))
    frames.append(found.agg(*aggregates).select(F.inline(F.array(*verdicts))))
    return frames


def _ordering(df: DataFrame, e: Expect) -> DataFrame:
    pairs = ordered_pairs(
        df,
        e.column,
        e.params["order_by"],
        by=e.params.get("by"),
        descending=e.check_type == "values_decreasing",
        strictly=e.params.get("strictly", False),
    )
    share = percent(F.col("ordered"), F.col("pairs"), 100.0) / 100
    return pairs.select(F.inline(F.array(_verdict(e, share, share >= e.params.get("mostly", 1.0)))))


def _keys(df: DataFrame, e: Expect) -> DataFrame:
    unique = share_of_unique_rows(df, e.params["column_list"])
    share = F.col("unique_share")
    return unique.select(F.inline(F.array(_verdict(e, share, share >= e.params.get("mostly", 1.0)))))


def _compare(df: DataFrame, e: Expect, tables: dict[str, DataFrame]) -> DataFrame:
    other = tables[e.params["other_table"]]
    sides = df.agg(F.count(F.lit(1)).alias("here"), F.lit(0).cast("bigint").alias("there")).unionByName(
        other.agg(F.lit(0).cast("bigint").alias("here"), F.count(F.lit(1)).alias("there"))
    )
    both = sides.agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    gap = F.col("here") - F.col("there")
    return both.select(F.inline(F.array(_verdict(e, gap, gap == 0))))


def _schema(df: DataFrame, group: list[Expect]) -> DataFrame:
    """The column list against the statement; the count also proves the table can be read."""
    names = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    verdicts = []
    for e in group:
        p = e.params
        if e.check_type == "schema_column_exists":
            observed, passed = float(e.column in names), e.column in names
        elif e.check_type == "schema_column_count":
            observed, passed = len(names), len(names) == p["expected_value"]
        elif e.check_type == "schema_column_list":
            missing = [c for c in p["column_list"] if c not in names]
            extra = [c for c in names if c not in p["column_list"]] if p.get("exact_match", True) else []
            observed, passed = len(missing) + len(extra), not missing and not extra
        elif e.check_type == "schema_column_order":
            observed, passed = len(names), names == list(p["column_list"])
        else:
            observed, passed = float(types.get(e.column) == p["type_"]), types.get(e.column) == p["type_"]
        verdicts.append(_verdict(e, F.lit(float(observed)), F.lit(bool(passed))))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*verdicts)))


def _query(df: DataFrame, e: Expect, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over the named tables that must return nothing."""
    unexpected = df.sparkSession.sql(e.params["custom_sql"], **tables).agg(F.count(F.lit(1)).alias("rows"))
    return unexpected.select(F.inline(F.array(_verdict(e, F.col("rows"), F.col("rows") == 0))))


def expect(df: DataFrame, expectations: list[Expect], *, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Judge expectations about one table: expectation_id, check_type, observed_value, passed.

    Queries name tables in braces, as in `SELECT * FROM {orders} WHERE ...`.
    """
    tables = tables or {}
    frames: list[DataFrame] = []
    family: dict[str, list[Expect]] = defaultdict(list)
    for e in expectations:
        family[EXPECTATIONS[e.check_type].family].append(e)
    if family["scan"]:
        frames += _scan(df, family["scan"])
    if family["distinct"]:
        frames += _distinct(df, family["distinct"])
    if family["percentile"]:
        frames += _percentile(df, family["percentile"])
    frames += [_ordering(df, e) for e in family["ordering"]]
    frames += [_keys(df, e) for e in family["keys"]]
    frames += [_compare(df, e, tables) for e in family["compare"]]
    if family["schema"]:
        frames.append(_schema(df, family["schema"]))
    frames += [_query(df, e, tables) for e in family["query"]]
    return reduce(DataFrame.unionByName, frames)
