"""Table profiles: one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import literal, named, quoted
from pyspark.sql import types as T

_COLUMNS_PER_PASS = 8
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def logical_type(data_type: T.DataType) -> str:
    """string, integer, number, boolean, date, timestamp or the type's own name."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return data_type.simpleString()


def profile(df: DataFrame, table: str, *, pii: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """Rows, NULLs, distinct values, extremes and text lengths of every column.

    Personal columns give counts only; booleans and nested columns have no
    extremes. Everything but exact distinct counts comes from one pass, a few
    columns at a time; an exact distinct count is one aggregate per column, which
    shuffles that column's distinct values and nothing else.
    """
    frames = []
    fields = df.schema.fields
    for start in range(0, len(fields), _COLUMNS_PER_PASS):
        part = fields[start : start + _COLUMNS_PER_PASS]
        aggregates, rows = ["count(1) AS rows"], []
        for i, f in enumerate(part):
            kind, c = logical_type(f.dataType), quoted(f.name)
            is_pii, nested = f.name in pii, isinstance(f.dataType, _NESTED)
            has_extremes = not (is_pii or nested or kind == "boolean")
            is_number, is_text = kind in ("integer", "number"), kind == "string"
            wanted = {"present": f"count({c})"}
            if not (exact or is_pii or nested):
                wanted["approx"] = f"approx_count_distinct({c})"
            if has_extremes:
                wanted |= {"lo": f"min({c})", "hi": f"max({c})"}
            if is_text and not is_pii:
                wanted |= {"shortest": f"min(length({c}))", "longest": f"max(length({c}))"}
            aggregates += [f"{sql} AS {name}{i}" for name, sql in wanted.items()]

            def made(name: str, type_: str, known: bool = True, here=wanted, i=i) -> str:
                return f"CAST({f'{name}{i}' if known and name in here else 'NULL'} AS {type_})"

            values = {
                "column_name": literal(f.name),
                "logical_type": f"'{kind}'",
                "is_pii": str(is_pii).lower(),
                "row_count": "rows",
                "value_count": f"present{i}",
                "null_count": f"rows - present{i}",
                "distinct_count": made("approx", "BIGINT"),
                "min_value": made("lo", "STRING"),
                "max_value": made("hi", "STRING"),
                "min_number": made("lo", "DOUBLE", is_number),
                "max_number": made("hi", "DOUBLE", is_number),
                "min_length": made("shortest", "INT"),
                "max_length": made("longest", "INT"),
            }
            rows.append("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in values.items()) + ")")
        counted = df.agg(*map(F.expr, aggregates))
        frames.append(counted.selectExpr(f"{literal(table)} AS table_name", f"inline(array({', '.join(rows)}))"))
    profiled = reduce(DataFrame.unionByName, frames)
    if not exact:
        return profiled
    counted = [
        df.groupBy(named(f.name).alias("value"))
        .agg(F.lit(1))
        .agg(F.count("value").alias("distinct_count"))
        .select(F.lit(f.name).alias("column_name"), "distinct_count")
        for f in fields
        if f.name not in pii and not isinstance(f.dataType, _NESTED)
    ]
    if not counted:
        return profiled
    columns = profiled.columns
    distinct = reduce(DataFrame.unionByName, counted)
    return profiled.drop("distinct_count").join(distinct, "column_name", "left").select(*columns)


def candidate_keys(profiles: DataFrame) -> DataFrame:
    """Columns that identify the rows: a value in every row, and never the same twice."""
    whole = (F.col("distinct_count") == F.col("row_count")) & (F.col("value_count") == F.col("row_count"))
    return profiles.filter(whole & (F.col("row_count") > 0)).select("table_name", "column_name")
