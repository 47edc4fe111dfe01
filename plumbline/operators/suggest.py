"""Proposing checks from declarations, inferences and promises.

Each field or table row lists the checks it could get; they are exploded, joined
with the promises of their dimension and given thresholds. A catalogue of
thousands of tables is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.operators.checks import CHECKS
from plumbline.operators.promises import promised, thresholds_of

FIELD_COLUMNS = {
    "table_name": "string",
    "column_name": "string",
    "logical_type": "string",
    "primary_key": "boolean",
    "unique_values": "boolean",
    "is_pii": "boolean",
    "declared_format": "string",
    "declared_pattern": "string",
    "accepted_values": "array<string>",
    "accepted_low": "string",
    "accepted_high": "string",
    "accepted_min_length": "int",
    "accepted_max_length": "int",
    # what inference found
    "codelist": "string",
    "enum_values": "array<string>",
    "regex": "string",
    "length_min": "int",
    "length_max": "int",
    "numeric_min": "double",
    "numeric_max": "double",
    "date_min": "string",
    "date_max": "string",
}
TABLE_COLUMNS = {
    "table_name": "string",
    "freshness_column": "string",
    "expected_min_rows": "bigint",
    "expected_max_rows": "bigint",
    "consistent_with": "string",
}

# --- Fixed values: reasons a promised dimension is not assessed ---------------------

NO_VALIDITY = "no_validity_decl"
NO_SOURCE = "no_authoritative_source"
NO_FRESHNESS = "no_freshness_column"
NO_ROW_COUNT = "no_expected_row_count"
NO_CONSISTENT = "no_consistent_with"

_CANDIDATE = "struct<check_type:string,column_name:string,source:string,parameters:string,own_promise:string,bare:boolean>"


def complete(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with every column of a declaration; absent ones are NULL."""
    return rows.select(
        *[
            (F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind)).alias(n)
            for n, kind in columns.items()
        ]
    )


def _candidate(
    when: Column,
    check_type: str | Column,
    source: str | Column,
    column: Column | None = None,
    parameters: Column | None = None,
    own_promise: str | None = None,
    bare: bool = False,
) -> Column:
    """A check this row would get; `bare` checks need no thresholds, `own_promise` replaces the dimension's."""

    def text(x):
        return x if isinstance(x, Column) else F.lit(x)

    made = F.struct(
        text(check_type).alias("check_type"),
        (column if column is not None else F.lit(None).cast("string")).alias("column_name"),
        text(source).alias("source"),
        (F.to_json(parameters) if parameters is not None else F.lit("{}")).alias("parameters"),
        F.lit(own_promise).cast("string").alias("own_promise"),
        F.lit(bare).alias("bare"),
    )
    return F.when(F.coalesce(when, F.lit(False)), made).cast(_CANDIDATE)


def _field_candidates() -> list[Column]:
    c = F.col
    name = c("column_name")
    kind = F.lower("logical_type")
    is_text = c("logical_type").isNull() | kind.isin(*fixed.TEXT_TYPES)
    is_number = F.coalesce(kind.isin(*fixed.NUMERIC_TYPES), F.lit(False))
    is_date = F.coalesce(kind.isin(*fixed.DATE_TYPES), F.lit(False))
    key, unique = F.coalesce("primary_key", F.lit(False)), F.coalesce("unique_values", F.lit(False))
    public = ~F.coalesce("is_pii", F.lit(False))

    def declared(x: Column) -> Column:
        return F.when(x.isNotNull(), "declaration").otherwise("inference")

    values = F.coalesce(c("accepted_values"), F.when(public & is_text, c("enum_values")))
    set_type = F.when(is_number, "number_found_in_set_percent").otherwise("text_found_in_set_percent")
    low = F.coalesce(c("accepted_low"), F.when(is_date, c("date_min")).otherwise(c("numeric_min").cast("string")))
    high = F.coalesce(c("accepted_high"), F.when(is_date, c("date_max")).otherwise(c("numeric_max").cast("string")))
    dates = F.struct(low.alias("min_date"), high.alias("max_date"))
    numbers = F.struct(low.try_cast("double").alias("min_value"), high.try_cast("double").alias("max_value"))
    shortest = F.coalesce(c("accepted_min_length"), F.when(public, c("length_min")))
    longest = F.coalesce(c("accepted_max_length"), F.when(public, c("length_max")))
    lengths = F.struct(shortest.alias("min_length"), longest.alias("max_length"))
    format_ = c("declared_format")
    by_name = F.coalesce(format_.isin("country_code", "currency_code"), F.lit(False))
    known_format = F.lit(None).cast("string")
    for label, pattern in fixed.DECLARED_FORMATS.items():
        known_format = F.when(format_ == label, F.lit(pattern)).otherwise(known_format)
    own_pattern = F.coalesce(c("declared_pattern"), known_format)
    pattern = F.coalesce(own_pattern, F.when(is_text & public, c("regex")))
    standard = F.when(c("codelist") == "ISO_3166_alpha2", "text_valid_country_code_percent").when(
        c("codelist") == "ISO_4217", "text_valid_currency_code_percent"
    )
    placeholders = F.struct(F.array(*map(F.lit, ["NULL", "N/A", "NA", "NONE"])).alias("placeholders"))
    return [
        _candidate(key, "distinct_percent", "declaration", name, own_promise="100"),
        _candidate(key, "nulls_count", "declaration", name, own_promise="99"),
        _candidate(unique & ~key, "distinct_percent", "declaration", name),
        _candidate(
            values.isNotNull(), set_type, declared(c("accepted_values")), name, F.struct(values.alias("expected_values"))
        ),
        _candidate(is_date & low.isNotNull() & high.isNotNull(), "date_in_range_percent", declared(c("accepted_low")), name, dates),
        _candidate(
            ~is_date & low.isNotNull() & high.isNotNull(), "number_in_range_percent", declared(c("accepted_low")), name, numbers
        ),
        _candidate(
            is_text & shortest.isNotNull(), "text_length_in_range_percent", declared(c("accepted_min_length")), name, lengths
        ),
        _candidate(format_ == "country_code", "text_valid_country_code_percent", "declaration", name),
        _candidate(format_ == "currency_code", "text_valid_currency_code_percent", "declaration", name),
        _candidate(~by_name & public & standard.isNotNull(), standard, "inference", name),
        _candidate(
            ~by_name & pattern.isNotNull(), "text_matching_regex_percent", declared(own_pattern), name,
            F.struct(pattern.alias("regex_pattern")),
        ),
        _candidate(is_text, "empty_text_percent", "default", name),
        _candidate(is_text, "whitespace_text_percent", "default", name),
        _candidate(is_text, "null_placeholder_text_percent", "default", name, placeholders),
        _candidate(is_text, "text_surrounded_by_whitespace_percent", "default", name),
        _candidate(is_date, "date_values_in_future_percent", "default", name),
        _candidate(F.lit(True), "column_exists", "default", name, bare=True),
        _candidate(~key, "nulls_percent", "default", name),
    ]


def _table_candidates() -> list[Column]:
    c, always = F.col, F.lit(True)
    other = F.struct(c("consistent_with").alias("reference_table"))
    return [
        _candidate(c("freshness_column").isNotNull(), "data_freshness", "declaration", c("freshness_column")),
        _candidate(c("expected_min_rows").isNotNull(), "row_count", "declaration", bare=True),
        _candidate(
            c("consistent_with").isNotNull(), "total_row_count_match_percent", "declaration", parameters=other
        ),
        _candidate(always, "table_availability", "default", bare=True),
        _candidate(~c("has_key"), "duplicate_record_percent", "default"),
        _candidate(always, "column_count", "default", bare=True),
        _candidate(always, "column_list_changed", "default", bare=True),
        _candidate(always, "column_types_changed", "default", bare=True),
    ]


def _check_types(spark: SparkSession) -> DataFrame:
    """Rule and dimension per check type: one row per type, whatever the data."""
    rows = [(name, c.rule, c.dimension) for name, c in CHECKS.items()]
    return spark.createDataFrame(rows, "check_type string, rule string, dimension string")


def suggest(fields: DataFrame, tables: DataFrame, promises: DataFrame) -> DataFrame:
    """Checks worth having for the promised dimensions: one row per proposed check.

    `fields` and `tables` follow FIELD_COLUMNS and TABLE_COLUMNS (absent columns
    count as not declared); `promises` has table_name, dimension, promise.
    """
    fields, tables = complete(fields, FIELD_COLUMNS), complete(tables, TABLE_COLUMNS)
    keyed = fields.groupBy("table_name").agg(F.bool_or(F.coalesce("primary_key", F.lit(False))).alias("has_key"))
    described = tables.join(keyed, "table_name", "left").withColumn("has_key", F.coalesce("has_key", F.lit(False)))
    # Expected row counts become bounds, ten percent wider for an error.
    bounds = F.when(
        F.col("expected_min_rows").isNotNull(),
        F.struct(
            F.col("expected_min_rows").cast("double").alias("warn_min"),
            F.col("expected_max_rows").cast("double").alias("warn_max"),
            F.greatest(F.lit(0.0), F.floor(F.col("expected_min_rows") * 0.9).cast("double")).alias("err_min"),
            F.floor(F.col("expected_max_rows") * 1.1).cast("double").alias("err_max"),
        ),
    )
    no_bounds = F.lit(None).cast("struct<warn_min:double,warn_max:double,err_min:double,err_max:double>")
    per_field = fields.select("table_name", no_bounds.alias("bounds"), F.explode(F.array(*_field_candidates())).alias("c"))
    per_table = described.select("table_name", bounds.alias("bounds"), F.explode(F.array(*_table_candidates())).alias("c"))
    candidates = (
        per_field.unionByName(per_table)
        .filter(F.col("c").isNotNull())
        .select("table_name", "bounds", "c.*")
        .join(F.broadcast(_check_types(fields.sparkSession)), "check_type")
    )
    wanted = candidates.join(promised(promises), ["table_name", "dimension"])
    both_kept = promised(promises).filter(F.col("dimension") == "uniqueness").select("table_name")
    # A key's zero-NULL check belongs to its uniqueness promise as well.
    wanted = wanted.join(both_kept.withColumn("unique_promised", F.lit(True)), "table_name", "left").filter(
        (F.col("check_type") != "nulls_count") | F.coalesce("unique_promised", F.lit(False))
    )
    levels = thresholds_of(F.col("rule"), F.coalesce("own_promise", "promise"))

    def limits(level: str) -> Column:
        mine = F.to_json(F.col("levels")[level])
        low, high = ("warn_min", "warn_max") if level == "warning" else ("err_min", "err_max")
        rows = F.to_json(F.struct(F.col(f"bounds.{low}").alias("min_count"), F.col(f"bounds.{high}").alias("max_count")))
        return F.when(F.col("check_type") == "row_count", rows).when(~F.col("bare"), mine)

    return (
        wanted.withColumn("levels", levels)
        .filter(F.col("bare") | F.col("levels").isNotNull())
        .select(
            "table_name",
            "check_type",
            "column_name",
            "dimension",
            "rule",
            "source",
            "parameters",
            limits("warning").alias("warning"),
            limits("error").alias("error"),
        )
    )


def not_assessed(promises: DataFrame, tables: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Promised dimensions no proposed check covers, and why."""
    open_ = promised(promises).join(
        suggestions.select("table_name", "dimension").distinct(), ["table_name", "dimension"], "left_anti"
    )
    c = F.col
    reason = (
        F.when(c("dimension") == "validity", NO_VALIDITY)
        .when(c("dimension") == "accuracy", NO_SOURCE)
        .when((c("dimension") == "timeliness") & c("freshness_column").isNull(), NO_FRESHNESS)
        .when((c("dimension") == "coverage") & c("expected_min_rows").isNull(), NO_ROW_COUNT)
        .when((c("dimension") == "consistency") & c("consistent_with").isNull(), NO_CONSISTENT)
        .otherwise(NO_VALIDITY)
    )
    return open_.join(complete(tables, TABLE_COLUMNS), "table_name", "left").select(
        "table_name", "dimension", reason.alias("reason")
    )


_KEY = ["table_name", "check_type", "column_name"]


def reconcile(owned: DataFrame, desired: DataFrame) -> DataFrame:
    """What turns the owned checks into the desired ones: create, update, delete or keep.

    Both sides have table_name, check_type, column_name and thresholds (text, NULL
    = leave as is); owned rows also check_id and is_active. Of owned rows with the
    same key the first check_id stays, the others are deleted.
    """
    blank = {"column_name": ""}
    first = owned.fillna(blank).groupBy(*_KEY).agg(F.min("check_id").alias("kept_id"))
    mine = owned.fillna(blank).join(first, _KEY).withColumn("is_first", F.col("check_id") == F.col("kept_id"))
    wanted = (
        desired.fillna(blank)
        .groupBy(*_KEY)
        .agg(F.max("thresholds").alias("new_thresholds"))
        .withColumn("wanted", F.lit(True))
    )
    drifted = F.col("new_thresholds").isNotNull() & ~F.col("thresholds").eqNullSafe(F.col("new_thresholds"))
    action = (
        F.when(F.col("wanted").isNull() | ~F.col("is_first"), "delete")
        .when(drifted | ~F.col("is_active"), "update")
        .otherwise("keep")
    )
    # Two one-sided joins instead of a full one: a key with very many copies can be split.
    known = mine.join(wanted, _KEY, "left").select(
        *_KEY, "check_id", action.alias("action"), F.coalesce("new_thresholds", "thresholds").alias("thresholds")
    )
    new = wanted.join(first, _KEY, "left_anti").select(
        *_KEY, F.lit(None).cast("string").alias("check_id"), F.lit("create").alias("action"), F.col("new_thresholds").alias("thresholds")
    )
    return known.unionByName(new)
