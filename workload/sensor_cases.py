"""One case per sensor: what to measure, and the SQL for the same number."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

from plumbline import fixed
from workload.tables import relation

AS_OF = "2024-02-01 00:00:00"
DAY = "1998-08-02"  # the day whose metrics are compared with earlier days
DAY_AS_OF = "1998-08-03 00:30:00"


@dataclass
class Case:
    sensor: str
    table: str
    column: str | None
    params: dict[str, Any] = field(default_factory=dict)
    sql: str | None = None  # aggregate expression over the table
    statement: str | None = None  # or a whole statement giving one number

    def scalar(self) -> str | None:
        """SQL for the number alone."""
        if self.statement is not None:
            return self.statement
        return None if self.sql is None else f"SELECT {self.sql} AS v FROM {relation(self.table)}"


def pct(predicate: str, empty: float) -> str:
    return f"CASE WHEN count(*) = 0 THEN {empty} ELSE 100.0 * count(*) FILTER (WHERE {predicate}) / count(*) END"


def pct_nn(column: str, predicate: str, empty: float) -> str:
    return (
        f"CASE WHEN count({column}) = 0 THEN {empty} "
        f"ELSE 100.0 * count(*) FILTER (WHERE {column} IS NOT NULL AND ({predicate})) / count({column}) END"
    )


def cnt(predicate: str) -> str:
    return f"count(*) FILTER (WHERE {predicate})"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def change(value: str, base: float) -> str:
    if base == 0:
        return f"CASE WHEN {value} IS NULL OR {value} = 0 THEN 0.0 ELSE 100.0 END"
    return f"CASE WHEN {value} IS NULL THEN 100.0 ELSE abs(100.0 * ({value} - {base}) / {base}) END"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


CASES: dict[str, Case] = {}


def case(sensor: str, table: str, column: str | None, params: dict | None = None, sql=None, statement=None) -> None:
    CASES[sensor] = Case(sensor, table, column, params or {}, sql, statement)


# --- tables ---------------------------------------------------------------------------

case("row_count", "lineitem", None, {}, "count(*)")
case("row_count_change", "lineitem", None, {"baseline_count": 50000}, change("count(*)", 50000))
case("table_availability", "lineitem", None, {}, "least(count(*), 0) + 1")
case("sql_condition_passed_percent", "lineitem", None, {"sql_condition": "l_quantity > 5 AND l_discount < 0.09"},
     pct("l_quantity > 5 AND l_discount < 0.09", 100))
case("sql_condition_failed_count", "graded_documents", None, {"sql_condition": "quality = 1"}, cnt("NOT (quality = 1)"))
case("sql_aggregate_value", "lineitem", None, {"sql_expression": "max(l_extendedprice) - min(l_extendedprice)"},
     "max(l_extendedprice) - min(l_extendedprice)")
case("sql_invalid_record_count", "graded_documents", None, {"sql_condition": "toxic = 1 AND quality = 1"},
     cnt("toxic = 1 AND quality = 1"))
case("data_staleness", "events", None, {"timestamp_column": "ts", "as_of": AS_OF},
     f"floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(max(ts)))")
case("data_freshness", "events", "ts", {"as_of": AS_OF}, f"floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(max(ts)))")
case("data_ingestion_delay", "orders", "o_orderdate", {"as_of": AS_OF},
     f"floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(max(o_orderdate)))")

# --- NULLs, numbers -----------------------------------------------------------------------

case("nulls_count", "graded_documents", "quality", {}, cnt("quality IS NULL"))
case("nulls_percent", "graded_documents", "quality", {}, pct("quality IS NULL", 0))
case("not_nulls_count", "graded_documents", "quality", {}, "count(quality)")
case("not_nulls_percent", "graded_documents", "quality", {}, pct("quality IS NOT NULL", 100))
case("nulls_percent_change", "graded_documents", "toxic", {"baseline_percent": 12.5},
     f"abs({pct('toxic IS NULL', 0)} - 12.5)")
case("min_value", "lineitem", "l_extendedprice", {}, "min(l_extendedprice)")
case("max_value", "lineitem", "l_extendedprice", {}, "max(l_extendedprice)")
case("sum_value", "lineitem", "l_quantity", {}, "sum(l_quantity)")
case("mean_value", "lineitem", "l_quantity", {}, "avg(l_quantity)")
for _name, _fn in (("stddev_sample", "stddev_samp"), ("stddev_population", "stddev_pop"),
                   ("variance_sample", "var_samp"), ("variance_population", "var_pop")):
    case(_name, "lineitem", "l_quantity", {}, f"{_fn}(l_quantity)")
case("number_below_min_percent", "customer", "c_acctbal", {"min_value": 100}, pct("c_acctbal < 100", 0))
case("number_above_max_percent", "customer", "c_acctbal", {"max_value": 9000}, pct("c_acctbal > 9000", 0))
case("negative_value_count", "customer", "c_acctbal", {}, cnt("c_acctbal < 0"))
case("negative_value_percent", "customer", "c_acctbal", {}, pct("c_acctbal < 0", 0))
case("non_negative_value_count", "event_points", "longitude", {}, cnt("longitude >= 0"))
case("non_negative_value_percent", "event_points", "longitude", {}, pct("longitude >= 0", 100))
case("integer_in_range_percent", "part", "p_size", {"min_value": 5, "max_value": 40}, pct("p_size BETWEEN 5 AND 40", 100))
case("number_in_range_percent", "part", "p_retailprice", {"min_value": 905.5, "max_value": 990},
     pct("p_retailprice BETWEEN 905.5 AND 990", 100))
case("mean_change", "lineitem", "l_quantity", {"baseline_value": 20}, change("avg(l_quantity)", 20))
case("sum_change", "lineitem", "l_quantity", {"baseline_value": 1000000}, change("sum(l_quantity)", 1000000))
case("invalid_latitude_count", "event_points", "latitude", {}, cnt("latitude < -90 OR latitude > 90"))
case("invalid_longitude_count", "event_points", "longitude", {}, cnt("longitude < -180 OR longitude > 180"))
case("valid_latitude_percent", "event_points", "latitude", {}, pct("latitude BETWEEN -90 AND 90", 100))
case("valid_longitude_percent", "event_points", "longitude", {}, pct("longitude BETWEEN -180 AND 180", 100))

# --- text -----------------------------------------------------------------------------------

case("text_min_length", "documents", "text", {}, "min(length(text))")
case("text_max_length", "documents", "text", {}, "max(length(text))")
case("text_mean_length", "documents", "text", {}, "avg(length(text))")
case("text_length_below_min", "documents", "text", {"min_length": 200}, cnt("length(text) < 200"))
case("text_length_above_max", "documents", "text", {"max_length": 2000}, cnt("length(text) > 2000"))
case("text_length_below_min_percent", "event_points", "note", {"min_length": 4}, pct_nn("note", "length(note) < 4", 0))
case("text_length_above_max_percent", "event_points", "note", {"max_length": 6}, pct_nn("note", "length(note) > 6", 0))
case("text_length_in_range_percent", "event_points", "note", {"min_length": 4, "max_length": 8},
     pct_nn("note", "length(note) BETWEEN 4 AND 8", 100))
_WORDS = r"len(regexp_split_to_array(text, '\s+'))"
case("text_word_count_min", "documents", "text", {}, f"min({_WORDS}) FILTER (WHERE length(text) > 0)")
case("text_word_count_max", "documents", "text", {}, f"max({_WORDS}) FILTER (WHERE length(text) > 0)")
case("empty_text_count", "event_points", "note", {}, cnt("note = ''"))
case("empty_text_percent", "event_points", "note", {}, pct("note = ''", 0))
case("whitespace_text_count", "event_points", "note", {}, cnt(rx("note", fixed.WHITESPACE_ONLY)))
case("whitespace_text_percent", "event_points", "note", {}, pct(rx("note", fixed.WHITESPACE_ONLY), 0))
_PLACEHOLDER = "upper(note) IN ('NULL', 'N/A', 'NA', 'NONE', 'NIL', 'EMPTY', 'MISSING')"
case("null_placeholder_text_count", "event_points", "note", {}, cnt(_PLACEHOLDER))
case("null_placeholder_text_percent", "event_points", "note", {}, pct(_PLACEHOLDER, 0))
_SURROUNDED = " OR ".join(
    rx("note", p) for p in (fixed.SURROUNDED_BOTH, fixed.SURROUNDED_BEFORE, fixed.SURROUNDED_AFTER)
)
case("text_surrounded_whitespace_count", "event_points", "note", {}, cnt(_SURROUNDED))
case("text_surrounded_whitespace_percent", "event_points", "note", {}, pct(_SURROUNDED, 0))
_RX = {"regex_pattern": "^[a-z]+$"}
case("regex_match_count", "event_points", "note", _RX, cnt(rx("note", "^[a-z]+$")))
case("regex_match_percent", "event_points", "note", _RX, pct(rx("note", "^[a-z]+$"), 100))
case("regex_not_match_count", "event_points", "note", _RX, cnt(f"note IS NULL OR NOT {rx('note', '^[a-z]+$')}"))
case("regex_not_match_percent", "event_points", "note", _RX, pct(f"note IS NULL OR NOT {rx('note', '^[a-z]+$')}", 0))

for _kind, _column, _pattern in (
    ("email", "email", fixed.EMAIL),
    ("uuid", "uuid", fixed.UUID),
    ("ip4", "ip4", fixed.IP4),
    ("ip6", "ip6", fixed.IP6),
    ("phone", "phone", fixed.US_PHONE),
    ("zipcode", "zipcode", fixed.US_ZIPCODE),
):
    _bad = f"{_column} <> '' AND NOT {rx(_column, whole(_pattern))}"
    case(f"invalid_{_kind}_format_count", "contacts", _column, {}, cnt(_bad))
    case(f"invalid_{_kind}_format_percent", "contacts", _column, {}, pct(_bad, 0))
for _kind, _table, _column, _pattern in (
    ("phone", "documents", "text", fixed.US_PHONE),
    ("email", "documents", "text", fixed.EMAIL),
    ("zipcode", "documents", "text", fixed.US_ZIPCODE),
    ("ip4", "documents", "text", fixed.IP4),
    ("ip6", "contacts", "ip6", fixed.IP6_FULL),
):
    case(f"contains_{_kind}_percent", _table, _column, {}, pct(rx(_column, _pattern), 0))

# --- booleans, dates, sets ------------------------------------------------------------------------

case("true_count", "event_points", "is_purchase", {}, cnt("is_purchase"))
case("true_percent", "event_points", "is_purchase", {}, pct("is_purchase", 0))
case("false_count", "event_points", "is_purchase", {}, cnt("NOT is_purchase"))
case("false_percent", "event_points", "is_purchase", {}, pct("NOT is_purchase", 0))
_THEN = {"as_of": "2024-01-20 06:00:00"}
case("future_date_count", "events", "ts", _THEN, cnt("ts > TIMESTAMP '2024-01-20 06:00:00'"))
case("future_date_percent", "events", "ts", _THEN, pct("ts > TIMESTAMP '2024-01-20 06:00:00'", 0))
_RANGE = {"min_date": "2024-01-05", "max_date": "2024-01-25"}
case("date_in_range_count", "events", "ts", _RANGE, cnt("ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"))
case("date_in_range_percent", "events", "ts", _RANGE, pct("ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", 100))
_KINDS = {"expected_values": ["click", "view", "refund"]}
case("text_in_set_percent", "events", "event_type", _KINDS, pct("event_type IN ('click', 'view', 'refund')", 100))
case("number_in_set_percent", "part", "p_size", {"expected_values": [1, 2, 3, 60]}, pct("p_size IN (1, 2, 3, 60)", 100))
case("expected_text_in_use_count", "events", "event_type", _KINDS,
     "count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view', 'refund'))")
case("expected_number_in_use_count", "part", "p_size", {"expected_values": [1, 2, 3, 60]},
     "count(DISTINCT p_size) FILTER (WHERE p_size IN (1, 2, 3, 60))")
case("expected_texts_top_n_count", "part", "p_name", {"expected_values": ["red bolt", "small ring", "hot gear"], "top_n": 30},
     None, "SELECT count(*) AS v FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 30) "
     "WHERE p_name IN ('red bolt', 'small ring', 'hot gear')")
# Of the values in this column, DE, ES and FR are country codes and EN is none.
case("valid_country_code_percent", "contacts", "country", {}, pct("upper(country) IN ('DE', 'ES', 'FR')", 100))
_CODES = ", ".join(f"'{c}'" for c in fixed.CURRENCY_CODES)
case("valid_currency_code_percent", "contacts", "currency", {}, pct(f"upper(currency) IN ({_CODES})", 100))

# --- what a text holds --------------------------------------------------------------------------------

_YMD = rx("day_text", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
case("text_not_matching_date_count", "event_points", "day_text", {}, cnt(f"NOT {_YMD}"))
case("text_not_matching_date_percent", "event_points", "day_text", {}, pct(f"NOT {_YMD}", 0))
case("text_match_date_percent", "event_points", "day_text", {}, pct(_YMD, 100))
case("text_not_matching_name_percent", "contacts", "first_word", {}, pct(f"NOT {rx('first_word', whole(fixed.PERSON_NAME))}", 0))
case("text_parsable_boolean_percent", "event_points", "mixed_text", {},
     pct("upper(mixed_text) IN ('TRUE', 'FALSE', 'YES', 'NO', '1', '0', 'T', 'F')", 100))
case("text_parsable_integer_percent", "event_points", "mixed_text", {}, pct(rx("mixed_text", fixed.INTEGER_TEXT), 100))
case("text_parsable_float_percent", "event_points", "mixed_text", {},
     pct(f"{rx('mixed_text', fixed.DECIMAL_TEXT)} OR {rx('mixed_text', fixed.BARE_DECIMAL_TEXT)}", 100))
case("text_parsable_date_percent", "event_points", "day_text", {},
     pct(" OR ".join(rx("day_text", p) for p in (fixed.DATE_DASHED_YMD, fixed.DATE_SLASHED, fixed.DATE_DASHED_DMY)), 100))


def detected(column: str) -> str:
    integer = rx(column, fixed.INTEGER_TEXT)
    number = f"{rx(column, fixed.DECIMAL_TEXT)} OR {rx(column, fixed.BARE_DECIMAL_TEXT)}"
    date = rx(column, fixed.DATE_DASHED_YMD)
    flag = f"upper({column}) IN ('TRUE', 'FALSE', 'YES', 'NO', '1', '0')"
    arms = " ".join(
        f"WHEN {pct(p, 0)} >= 95 THEN {i}" for i, p in enumerate((integer, number, date, flag), start=1)
    )
    return f"CASE {arms} ELSE 5 END"


case("detected_datatype", "event_points", "k_text", {}, detected("k_text"))
case("detected_datatype_changed", "event_points", "mixed_text", {"baseline_datatype": 2},
     f"CASE WHEN {detected('mixed_text')} <> 2 THEN 1 ELSE 0 END")

# --- user SQL ---------------------------------------------------------------------------------------------

case("sql_condition_failed_on_column_count", "graded_documents", "quality", {"sql_condition": "n_chars > 500"},
     cnt("quality IS NOT NULL AND NOT (n_chars > 500)"))
case("sql_condition_passed_on_column_percent", "graded_documents", "quality", {"sql_condition": "n_chars > 500"},
     pct_nn("quality", "n_chars > 500", 100))
case("sql_aggregate_on_column_value", "graded_documents", "quality", {"sql_expression": "SUM(n_chars)"},
     "sum(n_chars) FILTER (WHERE quality IS NOT NULL)")
case("sql_invalid_value_on_column_count", "events", "event_type", {"invalid_values": ["error", "lost"]},
     cnt("event_type IN ('error', 'lost')"))

# --- distinct values, percentiles, duplicates -------------------------------------------------------------------

case("distinct_count", "orders", "o_custkey", {}, "count(DISTINCT o_custkey)")
case("distinct_percent", "orders", "o_custkey", {}, "100.0 * count(DISTINCT o_custkey) / count(o_custkey)")
case("distinct_share_of_rows", "graded_documents", "toxic", {}, "100.0 * count(DISTINCT toxic) / count(*)")
case("duplicate_count", "documents", "text", {}, "count(text) - count(DISTINCT text)")
case("duplicate_percent", "documents", "text", {}, "100.0 * (count(text) - count(DISTINCT text)) / count(text)")
case("distinct_count_change", "orders", "o_custkey", {"baseline_count": 900}, change("count(DISTINCT o_custkey)", 900))
case("distinct_percent_change", "orders", "o_custkey", {"baseline_percent": 12.0},
     "abs(100.0 * count(DISTINCT o_custkey) / count(*) - 12.0)")
case("percentile", "lineitem", "l_extendedprice", {"percentile": 0.333}, "quantile_cont(l_extendedprice, 0.333)")
case("median_value", "orders", "o_totalprice", {}, "quantile_cont(o_totalprice, 0.5)")
for _n in (10, 25, 75, 90):
    case(f"percentile_{_n}", "lineitem", "l_extendedprice", {}, f"quantile_cont(l_extendedprice, {_n / 100})")
case("median_change", "events", "value", {"baseline_value": 30}, change("quantile_cont(value, 0.5)", 30))
_GROUPED = (
    "FROM (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, count(*) AS n FROM lineitem "
    "GROUP BY ALL)"
)
case("duplicate_record_count", "row_copies", None, {}, None, f"SELECT sum(n - 1) AS v {_GROUPED}")
case("duplicate_record_percent", "row_copies", None, {}, None, f"SELECT 100.0 * sum(n - 1) / sum(n) AS v {_GROUPED}")

# --- other tables ---------------------------------------------------------------------------------------------------

_REF = {"reference_table": "supplier", "reference_column": "s_acctbal"}


def _against(expression: str) -> str:
    return (
        "SELECT " + expression + " AS v FROM (SELECT count(*) AS n, sum(c_acctbal) AS s, min(c_nationkey) AS lo, "
        "max(c_acctbal) AS hi, avg(c_acctbal) AS m, count(c_acctbal) AS k FROM customer) c, "
        "(SELECT count(*) AS n, sum(s_acctbal) AS s, min(s_nationkey) AS lo, max(s_acctbal) AS hi, "
        "avg(s_acctbal) AS m, count(s_acctbal) AS k FROM supplier) r"
    )


case("row_count_match_percent", "customer", None, {"reference_table": "orders"}, None,
     "SELECT least(100.0 * (SELECT count(*) FROM customer) / (SELECT count(*) FROM orders), 100.0) AS v")
case("sum_match_percent", "customer", "c_acctbal", _REF, None, _against("least(abs(c.s) / abs(r.s) * 100, 100.0)"))
case("min_match_percent", "customer", "c_nationkey", {"reference_table": "supplier", "reference_column": "s_nationkey"},
     None, _against("CASE WHEN c.lo = r.lo THEN 100.0 ELSE 0.0 END"))
case("max_match_percent", "customer", "c_acctbal", _REF, None, _against("CASE WHEN c.hi = r.hi THEN 100.0 ELSE 0.0 END"))
case("average_match_percent", "customer", "c_acctbal", _REF, None,
     _against("CASE WHEN abs(c.m - r.m) / abs(r.m) <= 0.01 THEN 100.0 ELSE least((1 - abs(c.m - r.m) / abs(r.m)) * 100, 100.0) END"))
case("not_null_count_match_percent", "graded_documents", "quality",
     {"reference_table": "documents", "reference_column": "text"}, None,
     "SELECT least(100.0 * (SELECT count(quality) FROM labels) / (SELECT count(text) FROM documents), 100.0) AS v")
_FK = {"reference_table": "orders", "reference_column": "o_orderkey"}
case("foreign_key_not_found_count", "order_keys", "l_orderkey", _FK, None,
     f"SELECT count(*) AS v FROM {relation('order_keys')} WHERE l_orderkey IS NOT NULL "
     "AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
case("foreign_key_found_percent", "order_keys", "l_orderkey", _FK, None,
     "SELECT 100.0 * count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) / count(l_orderkey) "
     f"AS v FROM {relation('order_keys')}")

# --- schema, files, numbers from elsewhere -----------------------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_TYPED = sorted(
    ["o_orderkey:bigint", "o_custkey:bigint", "o_orderstatus:string", "o_totalprice:double", "o_orderdate:date", "o_orderpriority:string"]
)


def _md5(parts: list[str]) -> str:
    return hashlib.md5(",".join(parts).encode()).hexdigest()


_SPARK_TYPE = (
    "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
)
_LIST_HASH = {"expected_hash": _md5(sorted(_ORDERS))}
_ORDER_HASH = {"expected_hash": _md5(sorted(_ORDERS))}
_TYPES_HASH = {"expected_hash": _md5(_TYPED)}
case("column_count", "orders", None, {}, None, "SELECT count(*) AS v FROM (DESCRIBE orders)")
case("column_exists", "orders", "o_clerk", {}, None,
     "SELECT count(*) FILTER (WHERE column_name = 'o_clerk') AS v FROM (DESCRIBE orders)")
case("column_type_changed", "orders", "o_totalprice", {"expected_type": "decimal(12,2)"}, None,
     f"SELECT max(CASE WHEN {_SPARK_TYPE} = 'decimal(12,2)' THEN 0 ELSE 1 END) AS v FROM (DESCRIBE orders) "
     "WHERE column_name = 'o_totalprice'")
case("column_list_hash", "orders", None, _LIST_HASH, None,
     "SELECT CASE WHEN md5(string_agg(column_name, ',' ORDER BY column_name)) "
     f"= '{_LIST_HASH['expected_hash']}' THEN 0 ELSE 1 END AS v FROM (DESCRIBE orders)")
case("column_list_or_order_hash", "orders", None, _ORDER_HASH, None,
     "SELECT CASE WHEN md5(string_agg(column_name, ',' ORDER BY i)) "
     f"= '{_ORDER_HASH['expected_hash']}' THEN 0 ELSE 1 END AS v "
     "FROM (SELECT column_name, row_number() OVER () AS i FROM (DESCRIBE orders))")
case("column_types_hash", "orders", None, _TYPES_HASH, None,
     f"SELECT CASE WHEN md5(string_agg(column_name || ':' || {_SPARK_TYPE}, ',' ORDER BY column_name)) "
     f"= '{_TYPES_HASH['expected_hash']}' THEN 0 ELSE 1 END AS v FROM (DESCRIBE orders)")
case("reload_lag", "lineitem", None, {"as_of": "2030-01-01 00:00:00"})
case("import_custom_result_on_table", "orders", None, {"imported_value": 97.5}, "97.5 + 0 * count(*)")
case("import_custom_result_on_column", "orders", "o_totalprice", {"imported_value": 3.0}, "3.0 + 0 * count(*)")

# --- earlier days -------------------------------------------------------------------------------------------------------

DAILY_SQL = (
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS row_count, "
    f"{pct('o_custkey IS NULL', 0)} AS nulls_percent, count(DISTINCT o_custkey) AS distinct_count, "
    "100.0 * count(DISTINCT o_custkey) / count(*) AS distinct_percent, avg(o_totalprice) AS mean, "
    "quantile_cont(o_totalprice, 0.5) AS median, sum(o_totalprice) AS sum FROM orders GROUP BY 1"
)
EARLIER_METRICS = {
    "row_count": None,
    "nulls_percent": "o_custkey",
    "distinct_count": "o_custkey",
    "distinct_percent": "o_custkey",
    "mean": "o_totalprice",
    "median": "o_totalprice",
    "sum": "o_totalprice",
}
for _metric, _column in EARLIER_METRICS.items():
    for _label, _days in (("1_day", 1), ("7_days", 7), ("30_days", 30)):
        _now = f"(SELECT {_metric} FROM daily WHERE day = DATE '{DAY}')"
        _then = f"(SELECT nullif({_metric}, 0) FROM daily WHERE day = DATE '{DAY}' - {_days})"
        case(
            f"{_metric}_change_{_label}", "orders", _column, {"as_of": DAY_AS_OF}, None,
            f"SELECT ({_now} - {_then}) / {_then} * 100 AS v FROM (SELECT 1) "
            .replace("FROM daily", f"FROM ({DAILY_SQL})"),
        )
