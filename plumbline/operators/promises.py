"""Quality promises ("99%", "24h") and the thresholds they turn into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import THRESHOLD_TYPE, THRESHOLDS


def percent_of(promise: Column) -> Column:
    """A percentage from 0 to 100, with or without the sign; NULL for anything else."""
    digits = F.regexp_extract(F.trim(promise), r"\A(-?[0-9]+(?:\.[0-9]+)?)\s*%?\z", 1)
    number = F.when(digits != "", digits).try_cast("double")
    return F.when(number.between(0, 100), number)


def hours_of(promise: Column) -> Column:
    """A time span in hours: number and unit (s, m, h, d), or a bare number of hours."""
    text = F.lower(F.trim(promise))
    span = r"([0-9]+(?:\.[0-9]+)?)\s*(second|sec|s|minute|min|m|hour|hr|h|day|d)"
    amount = F.regexp_extract(text, span, 1)
    unit = F.left(F.regexp_extract(text, span, 2), F.lit(1))
    number = F.when(amount != "", amount).try_cast("double")
    bare = text.try_cast("double")
    return (
        F.when(unit == "s", number / 3600)
        .when(unit == "m", number / 60)
        .when(unit == "h", number)
        .when(unit == "d", number * 24)
        .otherwise(F.when(~F.isnan(bare), bare))
    )


def _limits(**given: Column) -> Column:
    return F.struct(
        *[given.get(name, F.lit(None)).cast("double").alias(name) for name in THRESHOLDS]
    ).cast(THRESHOLD_TYPE)


def thresholds_of(rule: Column, promise: Column) -> Column:
    """Struct(warning, error) of limits a promise means for a rule; NULL when it means nothing."""
    kept = percent_of(promise)
    slack = 100 - kept
    seconds = hours_of(promise) * 3600
    nothing = F.lit(None).cast(THRESHOLD_TYPE)

    def levels(warning: Column, error: Column) -> Column:
        return F.struct(warning.alias("warning"), error.alias("error"))

    hundred, zero = F.lit(100.0), F.lit(0.0)
    known = kept.isNotNull()
    return (
        F.when(
            (rule == "min_percent") & known,
            levels(_limits(min_percent=F.least(hundred, kept + 2)), _limits(min_percent=kept)),
        )
        .when(
            (rule == "max_percent") & known,
            levels(_limits(max_percent=F.greatest(zero, slack - 2)), _limits(max_percent=slack)),
        )
        .when(
            (rule == "max_change_percent") & known,
            levels(_limits(max_change_percent=F.greatest(zero, slack - 2)), _limits(max_change_percent=slack)),
        )
        .when(
            (rule == "min_max_percent") & known,
            levels(
                _limits(min_percent=kept, max_percent=hundred),
                _limits(min_percent=F.greatest(zero, kept - slack), max_percent=hundred),
            ),
        )
        .when((rule == "max_count") & (kept >= 99), levels(nothing, _limits(max_count=zero)))
        .when(
            (rule == "max_value") & seconds.isNotNull(),
            levels(_limits(max_value=seconds), _limits(max_value=F.greatest(seconds * 1.5, seconds + 3600))),
        )
    )


def promised(promises: DataFrame) -> DataFrame:
    """The (table_name, dimension, promise) rows that promise something."""
    return promises.filter(F.trim(F.coalesce("promise", F.lit(""))) != "")
