"""Column lists as data: drift detection, type checks, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG_COLUMNS = "array<struct<column_name:string,ordinal_position:int,data_type:string,is_nullable:boolean>>"


def column_list(df: DataFrame) -> Column:
    """The table's columns as an array literal of (name, position, type, nullable)."""
    return F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(i).alias("ordinal_position"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("is_nullable"),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
    )


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table, with the table's rows and the column's NULLs.

    The counts come from one aggregate per table, so the listing is also a
    reachability test: a table that cannot be read fails here.
    """
    parts = []
    for name, df in tables.items():
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls)
        per_column = F.arrays_zip(
            column_list(df).alias("column"), F.array(*[F.col(f"n{i}") for i in range(len(nulls))]).alias("null_count")
        )
        parts.append(
            counts.select(F.lit(name).alias("table_name"), "row_count", F.explode(per_column).alias("c")).select(
                "table_name", "c.column.*", "row_count", "c.null_count"
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _joined(value: Column, order: Column, separator: str = ",") -> Column:
    """Texts of a group, in order, as one text."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.concat_ws(separator, F.transform(pairs, lambda p: p["v"]))


def fingerprints(columns: DataFrame) -> DataFrame:
    """Per table: column count, the three drift hashes and the schema fingerprint."""
    name, position = F.col("column_name"), F.col("ordinal_position")
    typed = F.concat_ws(":", "column_name", "data_type")
    nullable = F.when(F.col("is_nullable"), "1").otherwise("0")
    return columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.md5(_joined(name, name)).alias("column_list_hash"),
        F.md5(_joined(name, position)).alias("column_list_or_order_hash"),
        F.md5(_joined(typed, name)).alias("column_types_hash"),
        F.sha2(_joined(F.concat_ws("|", "column_name", "data_type", nullable, F.lit("")), name, ""), 256).alias(
            "schema_fingerprint"
        ),
    )


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 over (name, type, nullable) of the columns, sorted by name."""
    import hashlib

    digest = hashlib.sha256()
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        digest.update(f"{f.name}|{f.dataType.simpleString()}|{int(f.nullable)}|".encode())
    return digest.hexdigest()


def missing_columns(declared: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared (table_name, column_name) rows that the live tables lack."""
    return declared.join(columns, ["table_name", "column_name"], "left_anti")


def schema_reading(df: DataFrame, sensor: str, column: str | None, params: dict) -> float | None:
    """Value of a schema sensor; the schema is known without reading data."""
    import hashlib

    fields = df.schema.fields
    types = {f.name: f.dataType.simpleString() for f in fields}
    if sensor == "column_count":
        return float(len(fields))
    if sensor == "column_exists":
        return float(column in types)
    if sensor == "column_type_changed":
        return None if column not in types else float(types[column] != params["expected_type"])
    if not params["expected_hash"]:
        return 0.0
    ordered = {
        "column_list_hash": sorted(types),
        "column_list_or_order_hash": [f.name for f in fields],
        "column_types_hash": [f"{n}:{types[n]}" for n in sorted(types)],
    }[sensor]
    return float(hashlib.md5(",".join(ordered).encode()).hexdigest() != params["expected_hash"])
