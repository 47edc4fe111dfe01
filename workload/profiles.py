"""Queries that profile tables, infer what columns hold, and propose checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators import catalog as catalogs
from plumbline.operators import compare, keys, promises, suggest
from plumbline.operators.duplicates import duplicate_rows, key_groups
from plumbline.operators.inference import infer
from plumbline.operators.key_sets import identifying_sets
from plumbline.operators.profile import candidate_keys, profile
from plumbline.operators.rules import RULE_THRESHOLDS
from plumbline.operators.sample import repeatable_sample
from plumbline.sources.results import cached_sample
from workload.sensor_cases import rx
from workload.folders import shared_folder
from workload.tables import GIVEN, load, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The columns of the tables profiled, with their types, for writing the SQL.
COLUMNS = {
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp",
    },
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "number",
        "o_orderdate": "timestamp", "o_orderpriority": "string",
    },
    "customer": {
        "c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string",
    },
    "part": {
        "p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
        "p_retailprice": "number",
    },
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "number"},
    "events": {
        "event_id": "integer", "ts": "timestamp", "user_id": "integer", "event_type": "string", "value": "number",
        "props": "string",
    },
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "string", "text": "string"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
}


def _query(name: str, function, sql: str | None = None) -> None:
    QUERIES[name] = function
    if sql is not None:
        SQL[name] = sql


# --- profiles -------------------------------------------------------------------------------


def _profile_sql(table: str, pii: tuple[str, ...] = (), approximate: bool = False) -> str:
    parts = []
    for column, kind in COLUMNS[table].items():
        hidden = column in pii
        number = kind in ("integer", "number")
        shown = kind == "string" and not hidden
        parts.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS logical_type, count(*) AS row_count, "
            f"count({column}) AS value_count, count(*) - count({column}) AS null_count, "
            + ("" if approximate else f"{'NULL' if hidden else f'count(DISTINCT {column})'}::BIGINT AS distinct_count, ")
            + (f"min({column})" if shown else "NULL") + "::VARCHAR AS min_text, "
            + (f"max({column})" if shown else "NULL") + "::VARCHAR AS max_text, "
            + (f"min({column})" if number else "NULL") + "::DOUBLE AS min_number, "
            + (f"max({column})" if number else "NULL") + "::DOUBLE AS max_number, "
            + (f"min(length({column}))" if shown else "NULL") + "::INT AS min_length, "
            + (f"max(length({column}))" if shown else "NULL") + f"::INT AS max_length FROM {relation(table)}"
        )
    return " UNION ALL ".join(parts)


def _profile(table: str, pii: tuple[str, ...] = (), exact: bool = True):
    def run(spark, sf_dir):
        is_text = F.col("logical_type") == "string"
        profiled = profile(load(spark, sf_dir, table), table, pii=pii, exact=exact).select(
            "column_name", "logical_type", "row_count", "value_count", "null_count", "distinct_count",
            F.when(is_text, F.col("min_value")).alias("min_text"), F.when(is_text, F.col("max_value")).alias("max_text"),
            "min_number", "max_number", "min_length", "max_length",
        )
        return profiled if exact else profiled.drop("distinct_count")

    return run


for _table in COLUMNS:
    _query(f"profile_of_{_table}", _profile(_table), _profile_sql(_table))
_query("profile_with_personal_columns", _profile("customer", ("c_name", "c_acctbal")),
       _profile_sql("customer", ("c_name", "c_acctbal")).replace("min(c_acctbal)::DOUBLE", "NULL::DOUBLE").replace("max(c_acctbal)::DOUBLE", "NULL::DOUBLE"))
_query("profile_with_sketches", _profile("lineitem", (), False), _profile_sql("lineitem", (), True))


def _candidate_keys(spark, sf_dir):
    profiled = reduce(DataFrame.unionByName, [profile(load(spark, sf_dir, t), t) for t in COLUMNS])
    return candidate_keys(profiled)


_query("candidate_keys", _candidate_keys, " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} HAVING count(DISTINCT {c}) = count(*) AND count(*) > 0"
    for t, columns in COLUMNS.items() for c in columns
))



def _identifying_sets(spark, sf_dir):
    found = reduce(DataFrame.unionByName, [identifying_sets(load(spark, sf_dir, t), t, width=2) for t in COLUMNS])
    return found.select("table_name", F.concat_ws(",", "columns").alias("key_columns"), "width")


def _identifying_sets_sql() -> str:
    parts = []
    for t, columns in COLUMNS.items():
        for c in columns:
            parts.append(f"SELECT '{t}' AS t, ['{c}'] AS k FROM {t} HAVING count(*) > 0 AND count(DISTINCT {c}) = count(*)")
        for a, b in combinations(columns, 2):
            parts.append(
                f"SELECT '{t}', ['{a}', '{b}'] FROM {t} HAVING count(*) > 0 AND count({a}) = count(*) AND count({b}) = count(*) "
                f"AND count(DISTINCT ({a}, {b})) = count(*)"
            )
    return (
        f"WITH f AS ({' UNION ALL '.join(parts)}) SELECT t AS table_name, array_to_string(k, ',') AS key_columns, len(k)::INT AS width FROM f "
        "WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.t = f.t AND len(g.k) < len(f.k) AND list_has_all(f.k, g.k))"
    )


_query("identifying_column_sets", _identifying_sets, _identifying_sets_sql())

# --- inference ----------------------------------------------------------------------------------

_INFERRED = tuple(COLUMNS)


def _inferred(spark, sf_dir, tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [infer(load(spark, sf_dir, t), t) for t in tables])


def _inferred_ranges(spark, sf_dir):
    return _inferred(spark, sf_dir, _INFERRED).select(
        "table_name", "column_name", F.concat_ws(",", "enum_values").alias("enum_values"),
        F.col("enum_values").isNotNull().alias("is_enum"), "length_min", "length_max", "numeric_min", "numeric_max",
        "date_min", "date_max",
    )


def _ranges_sql() -> str:
    parts = []
    for t in _INFERRED:
        for c, kind in COLUMNS[t].items():
            number, date, text = kind in ("integer", "number"), kind == "timestamp", kind == "string"
            d = f"count(DISTINCT {c})"
            enum = f"{d} BETWEEN 1 AND 20 AND count({c}) >= 1.5 * {d}"
            wide = f"(count(DISTINCT {c}) = 0 OR count(DISTINCT {c}) >= 5)"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                f"CASE WHEN {enum} THEN array_to_string(list_sort(list(DISTINCT {c}::VARCHAR)), ',') ELSE '' END AS enum_values, "
                f"{enum} AS is_enum, "
                + (f"floor(min(length({c})) * 0.95)::INT AS length_min, greatest(floor(max(length({c})) * 1.05 + 0.5)::INT, max(length({c})))::INT AS length_max, "
                   if text else "NULL::INT AS length_min, NULL::INT AS length_max, ")
                + (f"CASE WHEN {wide} THEN min({c})::DOUBLE END AS numeric_min, CASE WHEN {wide} THEN max({c})::DOUBLE END AS numeric_max, "
                   if number else "NULL::DOUBLE AS numeric_min, NULL::DOUBLE AS numeric_max, ")
                + (f"strftime(min({c}), '%Y-%m-%d') AS date_min, strftime(max({c}), '%Y-%m-%d') AS date_max "
                   if date else "NULL::VARCHAR AS date_min, NULL::VARCHAR AS date_max ")
                + f"FROM {t}"
            )
    return " UNION ALL ".join(parts)


_query("inferred_enums_and_ranges", _inferred_ranges, _ranges_sql())

_FORMAT_COLUMNS = ["email", "ip4", "phone", "zipcode", "uuid", "ip6", "first_word", "country", "currency"]


def _inferred_formats(spark, sf_dir):
    contacts = load(spark, sf_dir, "contacts").withColumn("page", F.concat(F.lit("https://"), "lang", F.lit(".example.org/"), "doc_id"))
    found = infer(contacts.drop("doc_id", "lang"), "contacts")
    return found.select(
        "column_name", "format", F.round("format_coverage", 6).alias("format_coverage"), "codelist",
        F.round("codelist_coverage", 6).alias("codelist_coverage"),
    )


def _formats_sql() -> str:
    view = f"(SELECT *, 'https://' || lang || '.example.org/' || doc_id AS page FROM {relation('contacts')})"
    currencies = ", ".join(f"'{c}'" for c in fixed.CURRENCY_CODES)
    parts = []
    for c in [*_FORMAT_COLUMNS, "page"]:
        shares = [
            f"count(*) FILTER (WHERE {rx(c, p)}) / nullif(count({c}), 0)::DOUBLE" for p in fixed.INFERRED_FORMATS.values()
        ]
        pairs = ", ".join(f"{{'s': {s}, 'n': '{n}'}}" for n, s in zip(fixed.INFERRED_FORMATS, shares))
        # Of the values in these columns, DE, ES and FR are the only country codes of two letters.
        lists = (
            f"{{'s': count(*) FILTER (WHERE length({c}) = 2 AND upper({c}) IN ('DE', 'ES', 'FR')) / nullif(count(*) FILTER (WHERE length({c}) = 2), 0)::DOUBLE, 'n': 'ISO_3166_alpha2'}}, "
            f"{{'s': count(*) FILTER (WHERE length({c}) = 3 AND upper({c}) IN ({currencies})) / nullif(count(*) FILTER (WHERE length({c}) = 3), 0)::DOUBLE, 'n': 'ISO_4217'}}"
        )
        if c == "first_word":
            lists = lists.split("}, ")[1]
        parts.append(
            f"SELECT '{c}' AS column_name, [{pairs}] AS f, [{lists}] AS l FROM {view}"
        )
    best = "list_filter({x}, lambda e: e.s >= 0.95 AND e.s = list_max(list_transform({x}, lambda i: i.s)))"
    f, l = best.format(x="f"), best.format(x="l")
    return (
        f"SELECT column_name, {f}[1].n AS format, round({f}[1].s, 6) AS format_coverage, {l}[1].n AS codelist, "
        f"round({l}[1].s, 6) AS codelist_coverage FROM ({' UNION ALL '.join(parts)})"
    )


_query("inferred_formats_and_code_lists", _inferred_formats, _formats_sql())

_FIXED_LENGTH = {"customer": ["c_name"], "orders": ["o_orderstatus"], "documents": ["lang"], "supplier": ["s_name"]}
_OTHER_LENGTH = {"part": ["p_brand", "p_name"], "documents": ["source"], "conversations": ["role"]}


def _inferred_patterns(spark, sf_dir):
    parts = []
    for t in sorted({*_FIXED_LENGTH, *_OTHER_LENGTH}):
        wanted = _FIXED_LENGTH.get(t, []) + _OTHER_LENGTH.get(t, [])
        parts.append(infer(load(spark, sf_dir, t).select(*wanted), t).select("table_name", "column_name", "regex"))
    return reduce(DataFrame.unionByName, parts)


_ESCAPE = r"regexp_replace({x}, '([\\^$.*+?()\[\]{{}}|\-&~#\s])', '\\\1', 'g')"


def _class_sql(char: str) -> str:
    return (
        f"CASE WHEN min({char}) = max({char}) THEN {_ESCAPE.format(x=f'min({char})')} "
        + rf"WHEN bool_and(regexp_matches({char}, '\A\p{{Nd}}+\z')) THEN '\d' "
        + rf"WHEN bool_and(regexp_matches({char}, '\A\p{{Lu}}+\z')) THEN '[A-Z]' "
        + rf"WHEN bool_and(regexp_matches({char}, '\A\p{{Ll}}+\z')) THEN '[a-z]' "
        + rf"WHEN bool_and(regexp_matches({char}, '\A\p{{L}}+\z')) THEN '[A-Za-z]' "
        + rf"WHEN bool_and(regexp_matches({char}, '\A[\p{{L}}\p{{N}}]+\z')) THEN '\w' END"
    )


def _patterns_sql() -> str:
    parts = []
    for t, columns in _FIXED_LENGTH.items():
        for c in columns:
            parts.append(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, '^' || string_agg(piece, '' ORDER BY start) || '$' AS regex FROM (
  SELECT min(i) AS start, CASE WHEN count(*) = 1 THEN atom ELSE atom || '{{' || count(*) || '}}' END AS piece FROM (
    SELECT i, atom, i - row_number() OVER (PARTITION BY atom ORDER BY i) AS island FROM (
      SELECT i, {_class_sql('ch')} AS atom FROM (SELECT i, substr({c}, i::INT, 1) AS ch FROM {t}, range(1, 129) r(i) WHERE i <= length({c}))
      GROUP BY i)) GROUP BY atom, island)""")
    for t, columns in _OTHER_LENGTH.items():
        for c in columns:
            # Shared prefix of the extremes, shorter when a text would end with it.
            parts.append(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name,
  CASE WHEN n > 0 THEN (SELECT '^' || {_ESCAPE.format(x=f'any_value(left({c}, n::INT))')} || {_class_sql(f'substr({c}, n::INT + 1)')}
    || '{{' || min(length({c}) - n) || ',' || max(length({c}) - n) || '}}$' FROM {t}) END AS regex
FROM (SELECT least(count(*) FILTER (WHERE left(lo, i::INT) = left(hi, i::INT) AND i <= length(lo)), any_value(shortest) - 1) AS n
  FROM (SELECT min({c}) AS lo, max({c}) AS hi, min(length({c})) AS shortest FROM {t}), range(1, 129) r(i))""")
    return " UNION ALL ".join(parts)


_query("inferred_patterns", _inferred_patterns, _patterns_sql())

# --- column lists -------------------------------------------------------------------------------------

_SPARK_TYPE = (
    "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"
)
_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, (row_number() OVER ())::INT AS ordinal_position, {_SPARK_TYPE} AS data_type "
    f"FROM (DESCRIBE {t})" for t in GIVEN
)
_COUNTED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, nulls AS null_count, (SELECT count(*) FROM {t}) AS row_count FROM "
    f"(UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE nulls)" for t in GIVEN
)


def _catalog(spark, sf_dir) -> DataFrame:
    return catalogs.catalog({t: load(spark, sf_dir, t) for t in GIVEN})


_query("catalog_of_all_tables", lambda spark, sf_dir: _catalog(spark, sf_dir).drop("is_nullable"),
       f"SELECT d.table_name, d.column_name, ordinal_position, data_type, row_count, null_count FROM ({_DESCRIBED}) d "
       f"JOIN ({_COUNTED}) c ON d.table_name = c.table_name AND d.column_name = c.column_name")
_query("schema_fingerprints", lambda spark, sf_dir: catalogs.fingerprints(_catalog(spark, sf_dir)), f"""
SELECT table_name, count(*) AS column_count, md5(string_agg(column_name, ',' ORDER BY column_name)) AS column_list_hash,
  md5(string_agg(column_name, ',' ORDER BY ordinal_position)) AS column_list_or_order_hash,
  md5(string_agg(column_name || ':' || data_type, ',' ORDER BY column_name)) AS column_types_hash,
  sha256(string_agg(column_name || '|' || data_type || '|1|', '' ORDER BY column_name)) AS schema_fingerprint
FROM ({_DESCRIBED}) GROUP BY 1""")


def _missing(spark, sf_dir):
    live = _catalog(spark, sf_dir)
    declared = live.filter("table_name = 'customer'").select(
        F.lit("supplier").alias("table_name"), F.regexp_replace("column_name", "^c_", "s_").alias("column_name")
    )
    return catalogs.missing_columns(declared, live)


_query("declared_columns_missing", _missing, f"""
WITH d AS ({_DESCRIBED}) SELECT 'supplier' AS table_name, 's_' || column_name[3:] AS column_name FROM d WHERE table_name = 'customer'
AND 's_' || column_name[3:] NOT IN (SELECT column_name FROM d WHERE table_name = 'supplier')""")

# --- samples ---------------------------------------------------------------------------------------------


def _sample(spark, sf_dir):
    return repeatable_sample(load(spark, sf_dir, "orders"), ["o_orderkey"], 7, 500, pii=("o_custkey",)).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


_query("repeatable_sample", _sample,
       "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 500")


def _reused_sample(spark, sf_dir):
    folder = shared_folder(spark, "samples")
    df = load(spark, sf_dir, "customer")
    first = cached_sample(df, "customer", ["c_custkey"], 3, 100, folder)
    again = cached_sample(df, "customer", ["c_custkey"], 3, 100, folder)
    return again.join(first.select("c_custkey"), "c_custkey").select("c_custkey", "c_name")


_query("sample_reused_by_fingerprint", _reused_sample,
       "SELECT c_custkey, c_name FROM customer ORDER BY md5('3|' || c_custkey), c_custkey LIMIT 100")

# --- duplicates, keys, comparisons --------------------------------------------------------------------------

_query("duplicate_rows_per_flag",
       lambda spark, sf_dir: duplicate_rows(load(spark, sf_dir, "row_copies"), by=["l_returnflag"]), """
SELECT l_returnflag, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM (
  SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
_query("duplicate_documents",
       lambda spark, sf_dir: key_groups(load(spark, sf_dir, "documents"), ["text"]).filter("copies > 1").select(
           F.md5("text").alias("text_md5"), "copies"),
       "SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
_query("orphaned_order_keys",
       lambda spark, sf_dir: keys.orphan_keys(load(spark, sf_dir, "order_keys"), "l_orderkey", load(spark, sf_dir, "orders"), "o_orderkey"),
       f"SELECT l_orderkey, count(*) AS rows FROM {relation('order_keys')} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
_query("key_lookup_per_line_number",
       lambda spark, sf_dir: keys.key_lookup(load(spark, sf_dir, "order_keys"), "l_orderkey", load(spark, sf_dir, "orders"), "o_orderkey", ["l_linenumber"])
       .select("l_linenumber", keys.missing_count().alias("missing"), keys.found_percent().alias("found_percent")), f"""
SELECT l_linenumber, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing,
  100.0 * count(o_orderkey) / count(*) AS found_percent
FROM {relation('order_keys')} LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")


def _per_nation(spark, sf_dir):
    wanted = {"rows": ("row_count", None), "mean": ("mean_value", "balance"), "top": ("max_value", "balance")}
    left = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    right = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    both = compare.paired(
        compare.statistics(left, wanted, ["nation"]), compare.statistics(right, wanted, ["nation"]), ["nation", "statistic"]
    )
    agreement = compare.agreement(F.col("current_value"), F.col("reference_value"))
    return both.select("nation", "statistic", F.round(agreement, 6).alias("agreement"))


_query("two_sources_compared_per_nation", _per_nation, """
WITH c AS (SELECT c_nationkey AS nation, count(*)::DOUBLE AS rows, avg(c_acctbal) AS mean, max(c_acctbal) AS top FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS nation, count(*)::DOUBLE AS rows, avg(s_acctbal) AS mean, max(s_acctbal) AS top FROM supplier GROUP BY 1),
cu AS (UNPIVOT c ON rows, mean, top INTO NAME statistic VALUE a), su AS (UNPIVOT s ON rows, mean, top INTO NAME statistic VALUE b)
SELECT coalesce(cu.nation, su.nation) AS nation, coalesce(cu.statistic, su.statistic) AS statistic,
  round(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(abs(a), abs(b)) = 0 THEN 100.0
    ELSE least(abs(a), abs(b)) / greatest(abs(a), abs(b)) * 100 END, 6) AS agreement
FROM cu FULL JOIN su ON cu.nation = su.nation AND cu.statistic = su.statistic""")

# --- promises and proposals --------------------------------------------------------------------------------------

_RULES = list(RULE_THRESHOLDS)
_PROMISES = ["99", "95%", "100 %", "-5%", "101", "24h", "5min", "30s", "2 days", "1.5", "weekly", "", "97.5%"]


def _promised(spark, sf_dir):
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("c_custkey") % len(_RULES) + 1).cast("int"))
    promise = F.element_at(F.array(*map(F.lit, _PROMISES)), (F.col("c_custkey") % len(_PROMISES) + 1).cast("int"))
    made = load(spark, sf_dir, "customer").select("c_custkey", rule.alias("rule"), promise.alias("promise"))
    t = promises.thresholds_of(F.col("rule"), F.col("promise"))
    kept = ("min_percent", "max_percent", "max_change_percent", "max_count", "max_value")
    return (
        made.withColumn("t", t)
        .withColumn("percent", promises.percent_of(F.col("promise")))
        .withColumn("hours", F.round(promises.hours_of(F.col("promise")), 6))
        .select("c_custkey", "rule", "percent", "hours",
                *[F.col(f"t.warning.{k}").alias(f"warning_{k}") for k in kept],
                *[F.col(f"t.error.{k}").alias(f"error_{k}") for k in kept])
    )


def _promises_sql() -> str:
    rules = "[" + ", ".join(f"'{r}'" for r in _RULES) + "]"
    texts = "[" + ", ".join(f"'{p}'" for p in _PROMISES) + "]"
    known = "[" + ", ".join("NULL" if x is None else str(x) for x in (99, 95, 100, None, None, None, None, None, None, 1.5, None, None, 97.5)) + "]"
    # -5% and 101 are no percentages, but as bare numbers or not at all they are hours.
    hours = "[" + ", ".join("NULL" if x is None else str(x) for x in (99, None, None, None, 101, 24, "5/60.0", "30/3600.0", 48, 1.5, None, None, None)) + "]"
    return f"""
WITH m AS (SELECT c_custkey, {rules}[c_custkey % {len(_RULES)} + 1] AS rule, {texts}[c_custkey % {len(_PROMISES)} + 1] AS promise,
  {known}[c_custkey % {len(_PROMISES)} + 1]::DOUBLE AS percent, {hours}[c_custkey % {len(_PROMISES)} + 1]::DOUBLE AS h FROM customer),
s AS (SELECT *, 100 - percent AS slack, h * 3600 AS sec FROM m)
SELECT c_custkey, rule, percent, round(h, 6) AS hours,
  CASE rule WHEN 'min_percent' THEN CASE WHEN percent IS NOT NULL THEN least(100.0, percent + 2) END WHEN 'min_max_percent' THEN percent END AS warning_min_percent,
  CASE rule WHEN 'max_percent' THEN CASE WHEN percent IS NOT NULL THEN greatest(0.0, slack - 2) END WHEN 'min_max_percent' THEN CASE WHEN percent IS NOT NULL THEN 100.0 END END AS warning_max_percent,
  CASE WHEN rule = 'max_change_percent' AND percent IS NOT NULL THEN greatest(0.0, slack - 2) END AS warning_max_change_percent,
  NULL::DOUBLE AS warning_max_count,
  CASE WHEN rule = 'max_value' THEN sec END AS warning_max_value,
  CASE rule WHEN 'min_percent' THEN percent WHEN 'min_max_percent' THEN CASE WHEN percent IS NOT NULL THEN greatest(0.0, percent - slack) END END AS error_min_percent,
  CASE rule WHEN 'max_percent' THEN slack WHEN 'min_max_percent' THEN CASE WHEN percent IS NOT NULL THEN 100.0 END END AS error_max_percent,
  CASE WHEN rule = 'max_change_percent' THEN slack END AS error_max_change_percent,
  CASE WHEN rule = 'max_count' AND percent >= 99 THEN 0.0::DOUBLE END AS error_max_count,
  CASE WHEN rule = 'max_value' AND sec IS NOT NULL THEN greatest(sec * 1.5, sec + 3600) END AS error_max_value
FROM s"""


_query("thresholds_from_promises", _promised, _promises_sql())

_ALL_PROMISES = [
    ("orders", "completeness", "99"), ("orders", "conformity", "95%"), ("orders", "uniqueness", "99"),
    ("orders", "timeliness", "24h"), ("orders", "coverage", "yes"), ("orders", "consistency", "yes"),
    ("orders", "validity", "98"), ("orders", "accuracy", "97"),
    ("customer", "completeness", "95"), ("customer", "conformity", ""), ("customer", "accuracy", "99"), ("customer", "timeliness", "1h"),
    ("events", "validity", "90"), ("events", "timeliness", "30m"), ("events", "coverage", "yes"),
]
_TABLES = [
    ("orders", "o_orderdate", 1000, 20000, "customer"),
    ("customer", None, None, None, None),
    ("events", "ts", None, None, None),
]


def _declared(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields as inferred, first column of a table its key; tables and promises as declared."""
    fields = _inferred(spark, sf_dir, [t[0] for t in _TABLES]).withColumn(
        "primary_key", F.col("column_name").isin("o_orderkey", "c_custkey", "event_id")
    )
    tables = spark.createDataFrame(
        _TABLES, "table_name string, freshness_column string, expected_min_rows bigint, expected_max_rows bigint, consistent_with string"
    )
    return fields, tables, spark.createDataFrame(_ALL_PROMISES, "table_name string, dimension string, promise string")


def _suggested(spark, sf_dir):
    proposed = suggest.suggest(*_declared(spark, sf_dir))
    return proposed.select("table_name", "check_type", "column_name", "dimension", "source", "warning", "error")


def _suggest_sql() -> str:
    """The proposals, worked out from the column types and the facts inference relies on."""
    out = []

    def add(table, check, column, dimension, source, warning=None, error=None, given=None):
        def quoted(x):
            return "NULL::VARCHAR" if x is None else f"'{x}'"

        guard = f" WHERE {given}" if given else ""
        out.append(
            f"SELECT '{table}' AS table_name, '{check}' AS check_type, {quoted(column)} AS column_name, '{dimension}' AS dimension, "
            f"'{source}' AS source, {quoted(warning)} AS warning, {quoted(error)} AS error FROM (SELECT 1){guard}"
        )

    def at_least(w, e):
        return f'{{"min_percent":{w}}}', f'{{"min_percent":{e}}}'

    def at_most(w, e):
        return f'{{"max_percent":{w}}}', f'{{"max_percent":{e}}}'

    key = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}
    for t in key:
        for c, kind in COLUMNS[t].items():
            distinct = f"(SELECT count(DISTINCT {c}) FROM {t})"
            enum = f"{distinct} <= 20 AND (SELECT count({c}) FROM {t}) >= 1.5 * {distinct}"
            if t == "orders":
                add(t, "column_exists", c, "conformity", "default")
                if c == key[t]:
                    add(t, "distinct_percent", c, "uniqueness", "declaration", '{"min_percent":100.0,"max_percent":100.0}', '{"min_percent":100.0,"max_percent":100.0}')
                    add(t, "nulls_count", c, "completeness", "declaration", None, '{"max_count":0.0}')
                else:
                    add(t, "nulls_percent", c, "completeness", "default", *at_most("0.0", "1.0"))
                if kind == "string":
                    for dirty in ("empty_text_percent", "whitespace_text_percent", "null_placeholder_text_percent", "text_surrounded_by_whitespace_percent"):
                        add(t, dirty, c, "conformity", "default", *at_most("3.0", "5.0"))
                    add(t, "text_length_in_range_percent", c, "conformity", "inference", *at_least("97.0", "95.0"))
                    add(t, "text_found_in_set_percent", c, "validity", "inference", *at_least("100.0", "98.0"), given=enum)
                elif kind == "timestamp":
                    add(t, "date_values_in_future_percent", c, "conformity", "default", *at_most("3.0", "5.0"))
                    add(t, "date_in_range_percent", c, "conformity", "inference", *at_least("97.0", "95.0"))
                else:
                    add(t, "number_in_range_percent", c, "conformity", "inference", *at_least("97.0", "95.0"), given=f"{distinct} >= 5")
            elif t == "customer" and c != key[t]:
                add(t, "nulls_percent", c, "completeness", "default", *at_most("3.0", "5.0"))
            elif t == "events" and kind == "string":
                add(t, "text_found_in_set_percent", c, "validity", "inference", *at_least("92.0", "90.0"), given=enum)
    add("orders", "text_matching_regex_percent", "o_orderstatus", "conformity", "inference", *at_least("97.0", "95.0"))
    add("orders", "data_freshness", "o_orderdate", "timeliness", "declaration", '{"max_value":86400.0}', '{"max_value":129600.0}')
    add("orders", "row_count", None, "coverage", "declaration", '{"min_count":1000.0,"max_count":20000.0}', '{"min_count":900.0,"max_count":22000.0}')
    add("orders", "total_row_count_match_percent", None, "accuracy", "declaration", *at_least("99.0", "97.0"))
    add("orders", "column_count", None, "conformity", "default")
    for c in ("column_list_changed", "column_types_changed"):
        add("orders", c, None, "consistency", "default")
    for t in ("orders", "events"):
        add(t, "table_availability", None, "coverage", "default")
    add("events", "data_freshness", "ts", "timeliness", "declaration", '{"max_value":1800.0}', '{"max_value":5400.0}')
    return " UNION ALL ".join(out)


_query("suggested_checks", _suggested, _suggest_sql())


def _not_assessed(spark, sf_dir):
    fields, tables, promised = _declared(spark, sf_dir)
    return suggest.not_assessed(promised, tables, suggest.suggest(fields, tables, promised))


_query("promised_dimensions_not_assessed", _not_assessed,
       "SELECT 'customer' AS table_name, 'accuracy' AS dimension, 'no_authoritative_source' AS reason "
       "UNION ALL SELECT 'customer', 'timeliness', 'no_freshness_column'")


def _owned_and_desired(spark, sf_dir):
    owned = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), "c_nationkey").alias("table_name"),
        F.lower("c_mktsegment").alias("check_type"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("c"), F.col("c_custkey") % 50)).alias("column_name"),
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("check_id"),
        (F.col("c_custkey") % 7 != 0).alias("is_active"),
        (F.col("c_custkey") % 4).cast("string").alias("thresholds"),
    )
    desired = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 25).alias("table_name"),
        F.when(F.col("o_orderstatus") == "F", "machinery").when(F.col("o_orderstatus") == "O", "building").otherwise("household").alias("check_type"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_orderkey") % 60)).alias("column_name"),
        F.when(F.col("o_custkey") % 25 > 5, (F.col("o_custkey") % 25 % 4).cast("string")).alias("thresholds"),
    )
    return owned, desired.distinct()


_query("checks_reconciled", lambda spark, sf_dir: suggest.reconcile(*_owned_and_desired(spark, sf_dir)), """
WITH o AS (SELECT 't' || c_nationkey AS table_name, lower(c_mktsegment) AS check_type,
    CASE WHEN c_custkey % 3 <> 0 THEN 'c' || (c_custkey % 50) ELSE '' END AS column_name, lpad(c_custkey::VARCHAR, 9, '0') AS check_id,
    c_custkey % 7 <> 0 AS is_active, (c_custkey % 4)::VARCHAR AS thresholds FROM customer),
d AS (SELECT 't' || (o_custkey % 25) AS table_name, CASE o_orderstatus WHEN 'F' THEN 'machinery' WHEN 'O' THEN 'building' ELSE 'household' END AS check_type,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || (o_orderkey % 60) ELSE '' END AS column_name,
    max(CASE WHEN o_custkey % 25 > 5 THEN (o_custkey % 25 % 4)::VARCHAR END) AS t FROM orders GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY table_name, check_type, column_name ORDER BY check_id) AS nth FROM o)
SELECT coalesce(n.table_name, d.table_name) AS table_name, coalesce(n.check_type, d.check_type) AS check_type,
  coalesce(n.column_name, d.column_name) AS column_name, check_id,
  CASE WHEN check_id IS NULL THEN 'create' WHEN d.table_name IS NULL OR nth > 1 THEN 'delete'
    WHEN (t IS NOT NULL AND t IS DISTINCT FROM thresholds) OR NOT is_active THEN 'update' ELSE 'keep' END AS action,
  coalesce(t, thresholds) AS thresholds
FROM n FULL JOIN d ON n.table_name = d.table_name AND n.check_type = d.check_type AND n.column_name = d.column_name""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
