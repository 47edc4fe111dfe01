"""What the values of a column look like: format, code list, enum, pattern, ranges.

Two steps: a profile, then one pass for what only makes sense given the profile.
The profile brought to the driver has one row per column. Everything else is
aggregated over whole columns by Spark, not over a sample.
"""

from __future__ import annotations

import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbline import fixed
from plumbline.functions.names import literal, named, quoted
from plumbline.functions.text import code_lists, escape_pattern
from plumbline.operators.profile import profile

COVERAGE = 0.95
MAX_ENUM = 20
MIN_REPEAT = 1.5
MAX_PATTERN = 128
MIN_DISTINCT_FOR_RANGE = 5
_PADDING = 0.05


def _best(candidates: list[tuple[str, str, str]]) -> str:
    """The first candidate (name, hits, of) with the highest coverage, as a struct; SQL text."""
    structs = ", ".join(
        f"if({whole} > 0, named_struct('coverage', {hits} / {whole}, 'order', -{i}, 'name', '{name}'), NULL)"
        for i, (name, hits, whole) in enumerate(candidates)
    )
    return f"array_max(array({structs}))"


def _texts(df: DataFrame, columns: list[Row], lists: dict[str, list[str]]) -> list[DataFrame]:
    """Format and code list of text-shaped columns, one pass for eight columns."""
    frames = []
    for start in range(0, len(columns), 8):
        aggregates, rows = [], []
        for i, c in enumerate(columns[start : start + 8]):
            text = f"CAST({quoted(c.column_name)} AS STRING)"
            aggregates.append(f"count({text}) AS n{i}")
            for j, pattern in enumerate(fixed.INFERRED_FORMATS.values()):
                aggregates.append(f"count_if({text} RLIKE r'{pattern}') AS f{i}_{j}")
            for j, codes in enumerate(lists.values()):
                known = ", ".join(f"'{code}'" for code in codes)
                long_enough = f"length({text}) = {len(codes[0])}"
                aggregates.append(f"count_if({long_enough}) AS e{i}_{j}")
                aggregates.append(f"count_if({long_enough} AND upper({text}) IN ({known})) AS h{i}_{j}")
            formats = [(name, f"f{i}_{j}", f"n{i}") for j, name in enumerate(fixed.INFERRED_FORMATS)]
            codelists = [(name, f"h{i}_{j}", f"e{i}_{j}") for j, name in enumerate(lists)]
            rows.append(
                f"named_struct('column_name', {literal(c.column_name)}, 'f', {_best(formats)}, 'l', {_best(codelists)})"
            )
        best = df.agg(*map(F.expr, aggregates)).selectExpr(f"inline(array({', '.join(rows)}))")
        frames.append(
            best.selectExpr(
                "column_name",
                f"if(f.coverage >= {COVERAGE}, f.name, NULL) AS format",
                f"if(f.coverage >= {COVERAGE}, f.coverage, NULL) AS format_coverage",
                f"if(l.coverage >= {COVERAGE}, l.name, NULL) AS codelist",
                f"if(l.coverage >= {COVERAGE}, l.coverage, NULL) AS codelist_coverage",
            )
        )
    return frames


def _enums(df: DataFrame, columns: list[Row]) -> list[DataFrame]:
    """The values of columns known to have at most twenty of them."""
    sets = [F.array_sort(F.collect_set(named(c.column_name).cast("string"))).alias(f"s{i}") for i, c in enumerate(columns)]
    rows = [
        F.struct(
            F.lit(c.column_name).alias("column_name"),
            # An estimated distinct count may have let a column with more values through.
            F.when(F.size(f"s{i}") <= MAX_ENUM, F.col(f"s{i}")).alias("enum_values"),
        )
        for i, c in enumerate(columns)
    ]
    return [df.agg(*sets).select(F.inline(F.array(*rows)))] if columns else []


# Bits for the kinds of characters seen: digit, upper, lower, other letter, other alphanumeric, anything else.
_DIGIT, _UPPER, _LOWER, _LETTER, _ALNUM, _OTHER = 1, 2, 4, 8, 16, 32


def _kind(ch: Column) -> Column:
    return (
        F.when(ch.between("0", "9"), _DIGIT)
        .when(ch.between("A", "Z"), _UPPER)
        .when(ch.between("a", "z"), _LOWER)
        .when(ch.rlike(r"\p{Nd}"), _DIGIT)
        .when(ch.rlike(r"\p{Lu}"), _UPPER)
        .when(ch.rlike(r"\p{Ll}"), _LOWER)
        .when(ch.rlike(r"\p{L}"), _LETTER)
        .when(ch.rlike(r"\p{N}"), _ALNUM)
        .otherwise(_OTHER)
    )


def _class_of(bits: Column, low: Column, high: Column) -> Column:
    """The narrowest class for a set of characters, NULL when there is none."""
    letters, alnum = _UPPER | _LOWER | _LETTER, _DIGIT | _UPPER | _LOWER | _LETTER | _ALNUM
    return (
        F.when(low == high, escape_pattern(low))
        .when(bits == _DIGIT, F.lit(r"\d"))
        .when(bits == _UPPER, F.lit("[A-Z]"))
        .when(bits == _LOWER, F.lit("[a-z]"))
        .when(bits.bitwiseAND(F.lit(~letters)) == 0, F.lit("[A-Za-z]"))
        .when(bits.bitwiseAND(F.lit(~alnum)) == 0, F.lit(r"\w"))
    )


def _fixed_length_patterns(df: DataFrame, columns: list[Row]) -> list[DataFrame]:
    """A class per position; runs of equal classes are counted. At most 128 positions per column."""
    if not columns:
        return []
    texts = F.array(
        *[F.struct(F.lit(c.column_name).alias("column_name"), named(c.column_name).alias("t")) for c in columns]
    )
    # Characters collapse into one row per column, position and character before the shuffle. Counts are hash aggregates:
    # a task holds its few distinct characters; extremes of texts alone would sort all characters that it reads.
    characters = (
        df.select(F.inline(texts))
        .filter(F.col("t").isNotNull())
        .select("column_name", F.posexplode(F.split("t", "", -1)).alias("pos", "ch"))
        .filter(F.col("ch") != "")
        .groupBy("column_name", "pos", "ch")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0")  # always so; without a use of the count Spark would join both aggregates into one
    )
    positions = characters.groupBy("column_name", "pos").agg(
        F.bit_or(_kind(F.col("ch"))).alias("bits"), F.min("ch").alias("low"), F.max("ch").alias("high")
    )
    along = Window.partitionBy("column_name").orderBy("pos")
    atoms = positions.withColumn("atom", _class_of(F.col("bits"), F.col("low"), F.col("high")))
    changed = F.coalesce((F.col("atom") != F.lag("atom").over(along)).cast("int"), F.lit(1))
    runs = (
        atoms.withColumn("changed", changed)
        .withColumn("run", F.sum("changed").over(along))
        .groupBy("column_name", "run")
        .agg(F.first("atom").alias("atom"), F.count(F.lit(1)).alias("n"))
        .withColumn(
            "piece", F.when(F.col("n") == 1, F.col("atom")).otherwise(F.format_string("%s{%d}", "atom", "n"))
        )
    )
    pieces = F.array_sort(F.collect_list(F.struct("run", "piece")))
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(pieces, lambda x: x["piece"]), ""), F.lit("$"))
    return [
        runs.groupBy("column_name").agg(
            F.when(F.bool_and(F.col("atom").isNotNull()), pattern).alias("regex")
        )
    ]


def _variable_length_patterns(df: DataFrame, columns: list[Row]) -> list[DataFrame]:
    """Common prefix, one class for all that follows, and its length range."""
    wanted = []
    for c in columns:
        # The prefix shared by the smallest and the largest text is shared by all.
        prefix = os.path.commonprefix([c.min_value, c.max_value])
        if len(prefix) >= c.min_length:
            prefix = prefix[: c.min_length - 1] if c.min_length else ""
        if prefix and len(prefix) + 6 <= MAX_PATTERN:
            wanted.append((c, prefix))
    if not wanted:
        return []
    aggregates, rows = [], []
    for i, (c, prefix) in enumerate(wanted):
        tail = F.substr(named(c.column_name), F.lit(len(prefix) + 1))
        head = F.left(tail, F.lit(1))
        only = F.bool_and(tail == F.repeat(head, F.length(tail)))
        kinds = {_DIGIT: r"\A\p{Nd}+\z", _UPPER: r"\A\p{Lu}+\z", _LOWER: r"\A\p{Ll}+\z", _LETTER: r"\A\p{L}+\z", _ALNUM: r"\A[\p{L}\p{N}]+\z"}
        aggregates += [F.bool_and(tail.rlike(p)).alias(f"k{i}_{bit}") for bit, p in kinds.items()]
        aggregates += [only.alias(f"one{i}"), F.min(head).alias(f"lo{i}"), F.max(head).alias(f"hi{i}")]
        # Narrowest kind that holds for every tail; _OTHER when none does.
        bits = F.lit(_OTHER)
        for bit in reversed(kinds):
            bits = F.when(F.col(f"k{i}_{bit}"), F.lit(bit)).otherwise(bits)
        literal = F.col(f"one{i}") & (F.col(f"lo{i}") == F.col(f"hi{i}"))
        low, high = F.when(literal, F.col(f"lo{i}")).otherwise(""), F.when(literal, F.col(f"hi{i}")).otherwise("x")
        shortest, longest = c.min_length - len(prefix), c.max_length - len(prefix)
        rows.append(
            F.struct(
                F.lit(c.column_name).alias("column_name"),
                F.concat(
                    F.lit("^"),
                    escape_pattern(F.lit(prefix)),
                    _class_of(bits, low, high),
                    F.lit(f"{{{shortest},{longest}}}$"),
                ).alias("regex"),
            )
        )
    return [df.agg(*aggregates).select(F.inline(F.array(*rows)))]


FOUND_SCHEMA = (
    "column_name string, format string, format_coverage double, codelist string, codelist_coverage double, "
    "enum_values array<string>, regex string"
)


def infer(df: DataFrame, table: str, *, pii: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """The profile of a table with everything that can be inferred about each column.

    Personal columns keep their counts and get no inference.
    """
    spark = df.sparkSession
    profiled = profile(df, table, pii=pii, exact=exact)
    columns = profiled.collect()  # one row per column
    open_columns = [c for c in columns if not c.is_pii and c.value_count > 0]
    text_shaped = [c for c in open_columns if c.logical_type in ("string", "date", "timestamp")]
    texts = [c for c in open_columns if c.logical_type == "string"]
    enums = [
        c
        for c in open_columns
        if c.distinct_count is not None
        and 0 < c.distinct_count <= MAX_ENUM
        and c.value_count >= MIN_REPEAT * c.distinct_count
    ]
    same_length = [c for c in texts if c.min_length == c.max_length and 0 < c.max_length <= MAX_PATTERN]
    other_length = [c for c in texts if c.min_length != c.max_length]

    known = spark.createDataFrame(columns, profiled.schema)
    low, high = F.col("min_length"), F.col("max_length")
    longest = F.floor(high * (1 + _PADDING) + 0.5).cast("int")
    is_number = F.col("logical_type").isin("integer", "number")
    enough = (F.col("distinct_count") == 0) | (F.col("distinct_count") >= MIN_DISTINCT_FOR_RANGE)
    is_range = is_number & enough & (F.col("max_number") >= F.col("min_number"))
    is_date = F.col("logical_type").isin("date", "timestamp")
    result = (
        known.withColumn("length_min", F.floor(low * (1 - _PADDING)).cast("int"))
        .withColumn("length_max", F.greatest(longest, high))
        .withColumn("numeric_min", F.when(is_range, F.col("min_number")))
        .withColumn("numeric_max", F.when(is_range, F.col("max_number")))
        .withColumn("date_min", F.when(is_date, F.left("min_value", F.lit(10))))
        .withColumn("date_max", F.when(is_date, F.left("max_value", F.lit(10))))
    )
    found = [
        spark.createDataFrame([], FOUND_SCHEMA),
        *_texts(df, text_shaped, code_lists(spark)),
        *_enums(df, enums),
        *_fixed_length_patterns(df, same_length),
        *_variable_length_patterns(df, other_length),
    ]
    # Every frame has a few rows per column; together they are one small shuffle.
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    per_column = together.groupBy("column_name").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in together.columns if c != "column_name"]
    )
    return result.join(per_column, "column_name", "left")
