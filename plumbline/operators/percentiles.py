"""Exact percentiles in two passes, without gathering a column in one task.

`percentile` keeps every distinct value of a group in one task's memory, which a
billion-value column does not survive. Here the first pass brackets the wanted ranks with
a mergeable quantile summary, whose rank error is bounded (`percentile_approx`: one
`ACCURACY`-th of the rows, at any order of merging). The second pass counts: all rows below
the bracket as one counter, the distinct values inside it, and all rows above as another.
Equal values collapse before the shuffle, so one that fills a third of the table costs a
counter. The values inside are looked through slice by slice, so that no task sorts
more than a slice of a bracket. A rank that is not inside its bracket raises an error, so
that no wrong value is returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
_SLICES = 1024
_LOG_STEPS = 64
_FEW_GROUPS = 10_000
_BELOW, _ABOVE = -1_000_000, 1_000_000


def log_bucket(v: Column) -> Column:
    """An order-keeping bucket number for any double, NaN last as in a sort."""
    step = F.floor(F.least(F.log1p(F.abs(v)), F.lit(750.0)) * _LOG_STEPS)
    return F.when(F.isnan(v), F.lit(100_000).cast("bigint")).otherwise(
        (step * F.signum(v)).cast("bigint")
    )


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))


def _rank_holders(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of each group's rows keep the one that holds the rank; make the rank relative to it."""
    upto = F.sum("cnt").over(
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counts.withColumn("before", upto - F.col("cnt"))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("cnt")))
        .withColumn("rank", F.col("rank") - F.col("before"))
        .drop("before")
    )


def brackets(values: DataFrame, group: list[str], fractions: dict[str, list[float]], accuracy: int) -> DataFrame:
    """Per group and fraction: `position` of the percentile among the sorted values, and `lo` and `hi` around it."""
    names = sorted({float(f) for fs in fractions.values() for f in fs})
    margin = 3 / accuracy  # one for the error of the summary, and room for a whole rank
    around = [bound for f in names for bound in (max(f - margin, 0.0), min(f + margin, 1.0))]
    summed = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", around, accuracy).alias("around"),
    )
    few = F.col("total") <= 2 * accuracy  # too few for a margin in whole ranks: all are inside
    bounds = [
        F.struct(
            F.lit(series).alias("series"),
            F.lit(float(f)).alias("fraction"),
            F.when(few, F.col("least")).otherwise(F.col("around")[2 * names.index(float(f))]).alias("lo"),
            F.when(few, F.col("most")).otherwise(F.col("around")[2 * names.index(float(f)) + 1]).alias("hi"),
        )
        for series, fs in fractions.items()
        for f in sorted(set(fs))
    ]
    return (
        summed.withColumn("w", F.explode(F.array(*bounds)))
        .filter(F.col("w.series") == F.col("series"))
        .select(*group, "w.fraction", (F.col("w.fraction") * (F.col("total") - 1)).alias("position"), "w.lo", "w.hi")
    )


def exact_percentiles(
    values: DataFrame, keys: list[str], fractions: dict[str, list[float]], *, few_groups: int = _FEW_GROUPS, accuracy: int = ACCURACY
) -> DataFrame:
    """Interpolated percentiles (percentile_cont) per group and series.

    `values` has the key columns, `series` and a double `v`; NULLs are left out, NaN is the
    largest value. `fractions` names the percentiles of each series. Up to `few_groups`
    groups, the brackets are broadcast, else joined. Returns keys, series, fraction, value.
    """
    # The brackets, one per group and percentile, are broadcast if the groups are few.
    small = not keys or values.select(*keys).distinct().limit(few_groups + 1).count() <= few_groups
    values = values.filter(F.col("v").isNotNull())
    group = [*keys, "series"]
    target = [*group, "fraction", "position"]

    def side(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if small else frame

    known = brackets(values, group, fractions, accuracy)
    width = F.col("hi") - F.col("lo")
    finite = (width > 0) & (width < float("inf"))
    place = (
        F.when(F.col("v") < F.col("lo"), _BELOW)
        .when(F.col("v") > F.col("hi"), _ABOVE)
        .when(finite, F.floor((F.col("v") - F.col("lo")) / width * _SLICES))
        .otherwise(log_bucket(F.col("v")))  # a bracket without end, or of one value
    )
    inside = F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v"))
    counted = (
        values.alias("a")
        .join(side(known).alias("t"), _same("a", "t", group))
        .select(*[F.col(f"t.{c}") for c in target], place.alias("slice"), inside.alias("v"))
        .groupBy(*target, "slice", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    position = F.col("position")
    ranks = F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position))))
    slices = counted.groupBy(*target, "slice").agg(F.sum("cnt").alias("cnt")).withColumn("final_rank", ranks)
    slices = slices.withColumn("rank", F.col("final_rank"))
    holders = _rank_holders(slices, [*target, "final_rank"], "slice").drop("cnt")
    same = _same("a", "t", [*target, "slice"])
    last = counted.alias("a").join(side(holders).alias("t"), same).select("t.*", "a.v", "a.cnt")
    found = _rank_holders(last, [*target, "final_rank"], "v")
    value = F.when(F.col("slice").isin(_BELOW, _ABOVE), F.raise_error(F.lit("a rank is outside its bracket"))).otherwise(F.col("v"))
    low, high = F.min("value"), F.max("value")
    return (
        found.withColumn("value", value.cast("double"))
        .groupBy(*target)
        .agg(F.when(low == high, low).otherwise(low + (high - low) * F.any_value(position - F.floor(position))).alias("value"))
        .drop("position")
    )
