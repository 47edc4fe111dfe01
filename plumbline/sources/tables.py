"""Reading what is to be measured."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_KINDS = ("parquet", "orc", "csv", "json", "text", "avro")


def read_table(
    spark: SparkSession, kind: str, location: str, *, where: str | None = None, schema: str | None = None, **options: str
) -> DataFrame:
    """A target as a DataFrame: files by format, `table` or `view` by name, `query` as SQL, `jdbc` by URL.

    `where` is the partition filter: it is applied first, so that it reaches the
    scan (partition pruning, pushed filters, or the database behind JDBC).
    """
    if kind in FILE_KINDS:
        reader = spark.read.options(**options)
        if schema:
            reader = reader.schema(schema)
        df = reader.format(kind).load(location)
    elif kind in ("table", "view"):
        df = spark.table(location)
    elif kind == "query":
        df = spark.sql(location)
    elif kind == "jdbc":
        df = spark.read.format("jdbc").options(url=location, **options).load()
    else:
        df = spark.read.format(kind).options(**options).load(location)
    return df.filter(F.expr(where)) if where else df


def is_available(spark: SparkSession, kind: str, location: str, **options: str) -> bool:
    """Whether a target can be read: it resolves, and a first row can be fetched."""
    try:
        read_table(spark, kind, location, **options).limit(1).collect()
    except (PySparkException, Py4JJavaError):
        return False
    return True


def listed_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of every table the session catalog lists: table, name, position, type, nullability."""
    rows = []
    for table in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(table.name, table.database), start=1):
            rows.append((table.database, table.name, c.name, i, c.dataType, c.nullable))
    return spark.createDataFrame(
        rows,
        "database string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean",
    )
