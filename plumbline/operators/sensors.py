"""The sensors: named measurements of a table or of one of its columns.

A sensor turns into one number per table (or per partition). How it is computed
decides its family, and the family decides the Spark job it can share:

scan        plain aggregates; all of a table's scan sensors share one pass
distinct    needs the exact number of distinct values
percentile  needs an exact order statistic
duplicates  needs whole rows compared
top_values  needs the most frequent values
reference   compares an aggregate with the same aggregate of another table
foreign_key looks values up in another table
history     compares a metric with its own earlier reading
schema      reads the column list
files       reads file modification times
external    takes a number measured elsewhere
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.names import quoted
from plumbline.functions.shares import (
    at_timestamp,
    percent,
    relative_change,
    rows,
    seconds_since,
    share,
    share_of_present,
)
from plumbline.functions.text import (
    contains_pattern,
    has_outer_whitespace,
    is_code,
    is_placeholder,
    matches,
    misses_format,
    whole,
    words,
)


class Target:
    """One column in the shapes sensors ask for."""

    def __init__(self, name: str, data_type: str):
        self.name = name
        self.data_type = data_type
        is_text = data_type == "string"
        self.value = F.col(quoted(name))
        self.text = self.value if is_text else self.value.cast("string")
        if is_text:
            self.number = self.value.try_cast("double")
        elif data_type == "date" or data_type.startswith("timestamp"):
            self.number = self.value.cast("timestamp").cast("double")
        else:
            self.number = self.value
        self.flag = self.value if data_type == "boolean" else self.value.try_cast("boolean")
        self.moment = self.value.try_cast("timestamp") if is_text else self.value

    def literals(self, values: list[Any]) -> list[Column]:
        """The values as literals of the column's own type."""
        return [F.lit(v).try_cast(self.data_type) for v in values]

    def among(self, values: list[Any]) -> Column:
        return self.value.isin(*self.literals(values)) if values else F.lit(False)


Params = dict[str, Any]


@dataclass(frozen=True)
class Sensor:
    """A named measurement.

    `build(target, params)` gives an aggregate Column for scan sensors. For the
    other families its meaning is described where the family is measured.
    """

    name: str
    family: str
    build: Callable[..., Any] | None = None
    defaults: Params = field(default_factory=dict)
    required: tuple[str, ...] = ()
    needs_column: bool = True
    present_only: bool = False

    def params(self, given: Params | None) -> Params:
        return {**self.defaults, **{k: v for k, v in (given or {}).items() if v is not None}}


SENSORS: dict[str, Sensor] = {}


def _add(name: str, family: str, build=None, **options) -> None:
    defaults = options.pop("defaults", {})
    SENSORS[name] = Sensor(name, family, build, defaults, **options)


def _scan(name: str, build, **options) -> None:
    _add(name, "scan", build, **options)


# --- whole table ---------------------------------------------------------------------

_scan("row_count", lambda t, p: rows(), needs_column=False)
_scan(
    "row_count_change",
    lambda t, p: relative_change(rows(), p["baseline_count"]),
    defaults={"baseline_count": 0},
    needs_column=False,
)
_scan("table_availability", lambda t, p: F.least(rows(), F.lit(0)) + 1, needs_column=False)
_scan(
    "sql_condition_passed_percent",
    lambda t, p: share(F.expr(p["sql_condition"]), 100),
    defaults={"sql_condition": "1=1"},
    needs_column=False,
)
_scan(
    "sql_condition_failed_count",
    lambda t, p: F.count_if(~F.expr(p["sql_condition"])),
    defaults={"sql_condition": "1=1"},
    required=("sql_condition",),
    needs_column=False,
)
_scan(
    "sql_aggregate_value",
    lambda t, p: F.expr(p["sql_expression"]),
    required=("sql_expression",),
    needs_column=False,
)
_scan(
    "sql_invalid_record_count",
    lambda t, p: F.count_if(F.expr(p["sql_condition"])),
    defaults={"sql_condition": "1=0"},
    needs_column=False,
)
_scan(
    "data_staleness",
    lambda t, p: seconds_since(F.max(p["timestamp_column"]), p.get("as_of")),
    required=("timestamp_column",),
    needs_column=False,
)
_scan("data_freshness", lambda t, p: seconds_since(F.max(t.moment), p.get("as_of")))
_scan("data_ingestion_delay", lambda t, p: seconds_since(F.max(t.moment), p.get("as_of")))

# --- NULLs -------------------------------------------------------------------------------

_scan("nulls_count", lambda t, p: F.count_if(t.value.isNull()))
_scan("nulls_percent", lambda t, p: share(t.value.isNull(), 0))
_scan("not_nulls_count", lambda t, p: F.count(t.value))
_scan("not_nulls_percent", lambda t, p: share(t.value.isNotNull(), 100))
_scan(
    "nulls_percent_change",
    lambda t, p: F.abs(share(t.value.isNull(), 0) - F.lit(float(p["baseline_percent"]))),
    defaults={"baseline_percent": 0.0},
)

# --- numbers -------------------------------------------------------------------------------

_scan("min_value", lambda t, p: F.min(t.number))
_scan("max_value", lambda t, p: F.max(t.number))
_scan("sum_value", lambda t, p: F.sum(t.number))
_scan("mean_value", lambda t, p: F.avg(t.number))
_scan("stddev_sample", lambda t, p: F.stddev_samp(t.number))
_scan("stddev_population", lambda t, p: F.stddev_pop(t.number))
_scan("variance_sample", lambda t, p: F.var_samp(t.number))
_scan("variance_population", lambda t, p: F.var_pop(t.number))
_scan(
    "number_below_min_percent",
    lambda t, p: share(t.number < F.lit(p["min_value"]), 0),
    defaults={"min_value": 0},
)
_scan(
    "number_above_max_percent",
    lambda t, p: share(t.number > F.lit(p["max_value"]), 0),
    defaults={"max_value": 100},
)
_scan("negative_value_count", lambda t, p: F.count_if(t.number < 0))
_scan("negative_value_percent", lambda t, p: share(t.number < 0, 0))
_scan("non_negative_value_count", lambda t, p: F.count_if(t.number >= 0))
_scan("non_negative_value_percent", lambda t, p: share(t.number >= 0, 100))
for _name in ("integer_in_range_percent", "number_in_range_percent"):
    _scan(
        _name,
        lambda t, p: share(t.number.between(p["min_value"], p["max_value"]), 100),
        defaults={"min_value": 0, "max_value": 100},
    )
_scan(
    "mean_change",
    lambda t, p: relative_change(F.avg(t.number.cast("double")), p["baseline_value"]),
    defaults={"baseline_value": 0.0},
)
_scan(
    "sum_change",
    lambda t, p: relative_change(F.sum(t.number.cast("double")), p["baseline_value"]),
    defaults={"baseline_value": 0.0},
)
_scan("invalid_latitude_count", lambda t, p: F.count_if(F.abs(t.number) > 90))
_scan("invalid_longitude_count", lambda t, p: F.count_if(F.abs(t.number) > 180))
_scan("valid_latitude_percent", lambda t, p: share(t.number.between(-90, 90), 100))
_scan("valid_longitude_percent", lambda t, p: share(t.number.between(-180, 180), 100))

# --- text length and content -----------------------------------------------------------------

_LENGTHS = {"min_length": 1, "max_length": 255}
_scan("text_min_length", lambda t, p: F.min(F.length(t.text)))
_scan("text_max_length", lambda t, p: F.max(F.length(t.text)))
_scan("text_mean_length", lambda t, p: F.avg(F.length(t.text)))
_scan(
    "text_length_below_min",
    lambda t, p: F.count_if(F.length(t.text) < p["min_length"]),
    defaults={"min_length": 1},
)
_scan(
    "text_length_above_max",
    lambda t, p: F.count_if(F.length(t.text) > p["max_length"]),
    defaults={"max_length": 255},
)
_scan(
    "text_length_below_min_percent",
    lambda t, p: share_of_present(t.value, F.length(t.text) < p["min_length"], 0),
    defaults={"min_length": 1},
)
_scan(
    "text_length_above_max_percent",
    lambda t, p: share_of_present(t.value, F.length(t.text) > p["max_length"], 0),
    defaults={"max_length": 255},
)
_scan(
    "text_length_in_range_percent",
    lambda t, p: share_of_present(
        t.value, F.length(t.text).between(p["min_length"], p["max_length"]), 100
    ),
    defaults=_LENGTHS,
)
_scan("text_word_count_min", lambda t, p: F.min(words(t.text)))
_scan("text_word_count_max", lambda t, p: F.max(words(t.text)))
_scan("empty_text_count", lambda t, p: F.count_if(t.text == ""))
_scan("empty_text_percent", lambda t, p: share(t.text == "", 0))
_scan("whitespace_text_count", lambda t, p: F.count_if(t.text.rlike(fixed.WHITESPACE_ONLY)))
_scan("whitespace_text_percent", lambda t, p: share(t.text.rlike(fixed.WHITESPACE_ONLY), 0))
_scan("null_placeholder_text_count", lambda t, p: F.count_if(is_placeholder(t.text)))
_scan("null_placeholder_text_percent", lambda t, p: share(is_placeholder(t.text), 0))
_scan("text_surrounded_whitespace_count", lambda t, p: F.count_if(has_outer_whitespace(t.text)))
_scan("text_surrounded_whitespace_percent", lambda t, p: share(has_outer_whitespace(t.text), 0))

_PATTERN = {"regex_pattern": ".*"}


def _misses_pattern(t: Target, p: Params) -> Column:
    return t.value.isNull() | ~t.text.rlike(p["regex_pattern"])


_scan("regex_match_count", lambda t, p: F.count_if(t.text.rlike(p["regex_pattern"])), defaults=_PATTERN)
_scan("regex_match_percent", lambda t, p: share(t.text.rlike(p["regex_pattern"]), 100), defaults=_PATTERN)
_scan("regex_not_match_count", lambda t, p: F.count_if(_misses_pattern(t, p)), defaults=_PATTERN)
_scan("regex_not_match_percent", lambda t, p: share(_misses_pattern(t, p), 0), defaults=_PATTERN)

# --- formats and personal data -----------------------------------------------------------------


def _format_sensors(kind: str, pattern: str) -> None:
    _scan(f"invalid_{kind}_format_count", lambda t, p: F.count_if(misses_format(t.text, pattern)))
    _scan(f"invalid_{kind}_format_percent", lambda t, p: share(misses_format(t.text, pattern), 0))


def _leak_sensor(kind: str, pattern: str) -> None:
    _scan(f"contains_{kind}_percent", lambda t, p: share(contains_pattern(t.text, pattern), 0))


for _kind, _pattern in (
    ("email", fixed.EMAIL),
    ("uuid", fixed.UUID),
    ("ip4", fixed.IP4),
    ("ip6", fixed.IP6),
    ("phone", fixed.US_PHONE),
    ("zipcode", fixed.US_ZIPCODE),
):
    _format_sensors(_kind, _pattern)
for _kind, _pattern in (
    ("phone", fixed.US_PHONE),
    ("email", fixed.EMAIL),
    ("zipcode", fixed.US_ZIPCODE),
    ("ip4", fixed.IP4),
    ("ip6", fixed.IP6_FULL),
):
    _leak_sensor(_kind, _pattern)

# --- booleans and dates ----------------------------------------------------------------------------

_scan("true_count", lambda t, p: F.count_if(t.flag))
_scan("true_percent", lambda t, p: share(t.flag, 0))
_scan("false_count", lambda t, p: F.count_if(~t.flag))
_scan("false_percent", lambda t, p: share(~t.flag, 0))


def _in_future(t: Target, p: Params) -> Column:
    return t.moment.cast("timestamp") > at_timestamp(p.get("as_of"))


def _in_dates(t: Target, p: Params) -> Column:
    return t.moment.between(F.to_date(F.lit(p["min_date"])), F.to_date(F.lit(p["max_date"])))


_DATES = {"min_date": "1900-01-01", "max_date": "2099-12-31"}
_scan("future_date_count", lambda t, p: F.count_if(_in_future(t, p)))
_scan("future_date_percent", lambda t, p: share(_in_future(t, p), 0))
_scan("date_in_range_count", lambda t, p: F.count_if(_in_dates(t, p)), defaults=_DATES)
_scan("date_in_range_percent", lambda t, p: share(_in_dates(t, p), 100), defaults=_DATES)

# --- sets of values ------------------------------------------------------------------------------------

_VALUES = {"expected_values": []}
for _name in ("text_in_set_percent", "number_in_set_percent"):
    _scan(_name, lambda t, p: share(t.among(p["expected_values"]), 100), defaults=_VALUES)
for _name in ("expected_text_in_use_count", "expected_number_in_use_count"):
    _add(
        _name,
        "distinct",
        lambda d, p: d.values,
        defaults=_VALUES,
    )
_add("expected_texts_top_n_count", "top_values", defaults={**_VALUES, "top_n": 10})


def _in_codes(t: Target, p: Params) -> Column:
    return is_code(t.name, p["expected_values"])


_scan("valid_country_code_percent", lambda t, p: share(_in_codes(t, p), 100))
_scan(
    "valid_currency_code_percent",
    lambda t, p: share(_in_codes(t, p), 100),
    defaults={"expected_values": fixed.CURRENCY_CODES},
)
_scan(
    "sql_invalid_value_on_column_count",
    lambda t, p: F.count_if(t.text.isin(*p["invalid_values"])) if p["invalid_values"] else F.lit(0) * rows(),
    defaults={"invalid_values": []},
)

# --- what a text column holds ----------------------------------------------------------------------------

_DATE_PATTERN = {"date_pattern": fixed.DEFAULT_DATE_PATTERN}
_scan(
    "text_not_matching_date_count",
    lambda t, p: F.count_if(~t.text.rlike(p["date_pattern"])),
    defaults=_DATE_PATTERN,
)
_scan(
    "text_not_matching_date_percent",
    lambda t, p: share(~t.text.rlike(p["date_pattern"]), 0),
    defaults=_DATE_PATTERN,
)
_scan("text_match_date_percent", lambda t, p: share(t.text.rlike(p["date_pattern"]), 100), defaults=_DATE_PATTERN)
_scan("text_not_matching_name_percent", lambda t, p: share(~t.text.rlike(whole(fixed.PERSON_NAME)), 0))
_scan("text_parsable_boolean_percent", lambda t, p: share(F.upper(t.text).isin(*fixed.BOOLEAN_WORDS), 100))
_scan("text_parsable_integer_percent", lambda t, p: share(matches(t.text, fixed.INTEGER_TEXT), 100))
_scan(
    "text_parsable_float_percent",
    lambda t, p: share(matches(t.text, fixed.DECIMAL_TEXT, fixed.BARE_DECIMAL_TEXT), 100),
)
_scan(
    "text_parsable_date_percent",
    lambda t, p: share(
        matches(t.text, fixed.DATE_DASHED_YMD, fixed.DATE_SLASHED, fixed.DATE_DASHED_DMY), 100
    ),
)


def _detected(t: Target) -> Column:
    """1 integer, 2 float, 3 date, 4 boolean, 5 text: the first held by 95 % of all rows."""
    kinds = [
        matches(t.text, fixed.INTEGER_TEXT),
        matches(t.text, fixed.DECIMAL_TEXT, fixed.BARE_DECIMAL_TEXT),
        matches(t.text, fixed.DATE_DASHED_YMD),
        F.upper(t.text).isin(*fixed.DETECTED_BOOLEAN_WORDS),
    ]
    code = F.lit(5)
    for number, predicate in reversed(list(enumerate(kinds, start=1))):
        code = F.when(share(predicate, 0) >= 95, F.lit(number)).otherwise(code)
    return code


_scan("detected_datatype", lambda t, p: _detected(t))
_scan(
    "detected_datatype_changed",
    lambda t, p: F.lit(0) * rows()
    if p.get("baseline_datatype") is None
    else (_detected(t) != F.lit(int(p["baseline_datatype"]))).cast("int"),
)

# --- user SQL on a column ---------------------------------------------------------------------------------

_scan(
    "sql_condition_failed_on_column_count",
    lambda t, p: F.count_if(t.value.isNotNull() & ~F.expr(p["sql_condition"])),
    defaults={"sql_condition": "1=1"},
    required=("sql_condition",),
)
_scan(
    "sql_condition_passed_on_column_percent",
    lambda t, p: share_of_present(t.value, F.expr(p["sql_condition"]), 100),
    defaults={"sql_condition": "1=1"},
)
_scan(
    "sql_aggregate_on_column_value",
    lambda t, p: F.expr(p["sql_expression"]),
    defaults={"sql_expression": "COUNT(*)"},
    present_only=True,
)

# --- distinct values: build(d, params), d has distinct, present, rows and values -------------------------

_add("distinct_count", "distinct", lambda d, p: d.distinct)
_add("distinct_percent", "distinct", lambda d, p: percent(d.distinct, d.present, 0))
_add("distinct_share_of_rows", "distinct", lambda d, p: percent(d.distinct, d.rows, 0))
_add("duplicate_count", "distinct", lambda d, p: d.present - d.distinct)
_add("duplicate_percent", "distinct", lambda d, p: percent(d.present - d.distinct, d.present, 0))
_add(
    "distinct_count_change",
    "distinct",
    lambda d, p: relative_change(d.distinct, p["baseline_count"]),
    defaults={"baseline_count": 0},
)
_add(
    "distinct_percent_change",
    "distinct",
    lambda d, p: F.abs(percent(d.distinct, d.rows, 0) - F.lit(float(p["baseline_percent"]))),
    defaults={"baseline_percent": 0.0},
)

# --- percentiles: build(value, params) finishes the order statistic ----------------------------------------

_add("percentile", "percentile", lambda v, p: v, defaults={"percentile": 0.5})
for _name, _fraction in (
    ("median_value", 0.5),
    ("percentile_10", 0.1),
    ("percentile_25", 0.25),
    ("percentile_75", 0.75),
    ("percentile_90", 0.9),
):
    _add(_name, "percentile", lambda v, p: v, defaults={"percentile": _fraction})
_add(
    "median_change",
    "percentile",
    lambda v, p: relative_change(v, p["baseline_value"]),
    defaults={"percentile": 0.5, "baseline_value": 0.0},
)

# --- whole rows -----------------------------------------------------------------------------------------------

_add("duplicate_record_count", "duplicates", lambda dup, n: dup, needs_column=False)
_add("duplicate_record_percent", "duplicates", lambda dup, n: percent(dup, n, 0), needs_column=False)

# --- against another table ------------------------------------------------------------------------------------

for _name, _statistic in (
    ("row_count_match_percent", "row_count"),
    ("sum_match_percent", "sum_value"),
    ("min_match_percent", "min_value"),
    ("max_match_percent", "max_value"),
    ("average_match_percent", "mean_value"),
    ("not_null_count_match_percent", "not_nulls_count"),
):
    _add(
        _name,
        "reference",
        defaults={"statistic": _statistic, "reference_column": "id", "tolerance_percent": 0.01},
        required=("reference_table",),
        needs_column=_statistic != "row_count",
    )
for _name in ("foreign_key_not_found_count", "foreign_key_found_percent"):
    _add(_name, "foreign_key", defaults={"reference_column": "id"}, required=("reference_table",))

# --- against the same metric earlier -----------------------------------------------------------------------------

# Metric, sensor of its current value, whether the change is relative to |previous|.
_EARLIER = (
    ("row_count", "row_count", False),
    ("nulls_percent", "nulls_percent", False),
    ("distinct_count", "distinct_count", False),
    ("distinct_percent", "distinct_share_of_rows", False),
    ("mean", "mean_value", True),
    ("median", "median_value", True),
    ("sum", "sum_value", True),
)
for _metric, _base, _absolute in _EARLIER:
    for _label, _days in (("1_day", 1), ("7_days", 7), ("30_days", 30)):
        _add(
            f"{_metric}_change_{_label}",
            "history",
            defaults={"base": _base, "days": _days, "absolute": _absolute},
            needs_column=_metric != "row_count",
        )

# --- column list, files, numbers from elsewhere --------------------------------------------------------------------

_add("column_count", "schema", needs_column=False)
_add("column_exists", "schema")
_add("column_type_changed", "schema", defaults={"expected_type": "string"})
for _name in ("column_list_hash", "column_list_or_order_hash", "column_types_hash"):
    _add(_name, "schema", defaults={"expected_hash": ""}, needs_column=False)
_add("reload_lag", "files", needs_column=False)
for _name in ("import_custom_result_on_table", "import_custom_result_on_column"):
    _add(_name, "external", defaults={"imported_value": 0.0}, needs_column=_name.endswith("column"))
