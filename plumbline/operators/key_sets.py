"""Sets of columns that identify the rows, smallest sets first.

A level-wise search: the sets of one size are looked at together, and a set that
holds a key is not looked at again. A set stays in question if

* every column of it has a value in every row,
* its columns have enough distinct values between them (their product), and
* a sketch of its distinct values, taken for many sets in one scan, reaches the rows
  but for seven standard errors.

What stays is looked through for a repeated tuple in a slice of all tuples, by hash: one
that is found is proof that the set is no key, and most sets that are none move that slice
of the rows only. The others are counted exactly over all rows, map-side first. Each set
moves its own columns only.
The driver holds column names and one number per set, nothing that grows with rows.
A set is ruled out wrongly only if a sketch errs by more than seven standard errors.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import named

SKETCH_ERROR = 0.02
#: The least estimate that a unique set can have, as a share of the rows.
_LEAST = 1 - 7 * SKETCH_ERROR
_PER_SCAN = 32
_EXACT_TOGETHER = 8
#: One tuple in so many is in the slice that is looked through first.
_SLICES = 32


def identifying_sets(
    df: DataFrame, table: str, *, width: int = 3, columns: list[str] | None = None
) -> DataFrame:
    """table_name, columns (in the table's order), width: the minimal keys of up to `width` columns.

    Columns that cannot be grouped (maps) or hold a NULL are in no key. A table without
    rows has no key; a table with a repeated row has none either.
    """
    fields = [f for f in df.schema.fields if not _ungroupable(f.dataType) and (columns is None or f.name in columns)]
    found = _search(df, [f.name for f in fields], width) if fields else []
    return df.sparkSession.createDataFrame(
        [(table, list(key), len(key)) for key in found], "table_name string, columns array<string>, width int"
    )


def _ungroupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(_ungroupable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _ungroupable(data_type.elementType)
    return isinstance(data_type, (T.MapType, T.VariantType))


def _search(df: DataFrame, names: list[str], width: int) -> list[tuple[str, ...]]:
    counted = df.agg(F.count(F.lit(1)), *[F.count(named(n)) for n in names]).first()
    rows = counted[0]
    names = [n for n, present in zip(names, counted[1:]) if present == rows]
    if not rows or not names:
        return []
    keys: list[tuple[str, ...]] = []
    most: dict[str, float] = {}  # upper bounds of the distinct values of a column
    for size in range(1, min(width, len(names)) + 1):
        asked = [
            s
            for s in combinations(names, size)
            if not any(set(key) <= set(s) for key in keys)
            and (size == 1 or prod(most[n] for n in s) >= rows)
        ]
        estimates = _estimates(df, asked)
        if size == 1:
            most = {s[0]: e / _LEAST + 1 for s, e in estimates.items()}
        open_ = [s for s in asked if estimates[s] >= _LEAST * rows]
        open_ = [s for s, unique in zip(open_, _unique(df, open_, _SLICES)) if unique]
        keys += [s for s, unique in zip(open_, _unique(df, open_)) if unique]
    return keys


def _estimates(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    found: dict[tuple[str, ...], int] = {}
    for start in range(0, len(sets), _PER_SCAN):
        part = sets[start : start + _PER_SCAN]
        sketches = [F.approx_count_distinct(F.xxhash64(*map(named, s)), SKETCH_ERROR) for s in part]
        found |= dict(zip(part, df.agg(*sketches).first()))
    return found


def _unique(df: DataFrame, sets: list[tuple[str, ...]], slices: int = 1) -> list[bool]:
    """Whether no tuple of a set is repeated, among all or those of one of `slices` slices; equal tuples are in one slice."""
    answers: dict[int, bool] = {}
    for start in range(0, len(sets), _EXACT_TOGETHER):
        frames = []
        for k, s in enumerate(sets[start : start + _EXACT_TOGETHER], start):
            rows = df if slices == 1 else df.filter(F.pmod(F.xxhash64(F.lit(7), *map(named, s)), F.lit(slices)) == 0)
            copies = rows.groupBy(*map(named, s)).agg(F.count(F.lit(1)).alias("_copies"))
            # A slice without rows has no repeated tuple.
            frames.append(copies.agg(F.coalesce(F.max("_copies") == 1, F.lit(True)).alias("is_key")).select(F.lit(k).alias("k"), "is_key"))
        answers |= {r.k: r.is_key for r in reduce(DataFrame.unionByName, frames).collect()}
    return [answers[k] for k in range(len(sets))]
