"""Joining many rows with a lookup table, whatever the skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALTS = 16


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", *, broadcast_up_to: int = 1_000_000
) -> DataFrame:
    """Join rows with a lookup table, broadcast if it is counted and found small.

    A larger one is joined by shuffle: rows of one key are spread over salts by
    their content, the lookup table is repeated once per salt.
    """
    if lookup.limit(broadcast_up_to + 1).count() <= broadcast_up_to:
        return rows.join(F.broadcast(lookup), keys, how)
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salted = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
    salt = F.pmod(F.xxhash64(*hashable), F.lit(_SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, [*keys, "_salt"], how).drop("_salt")
