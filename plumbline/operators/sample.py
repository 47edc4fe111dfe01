"""Repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGITS = 12
_SPARE = 4


def repeatable_sample(
    df: DataFrame, key: list[str], seed: int, rows: int = 1000, *, pii: tuple[str, ...] = ()
) -> DataFrame:
    """The `rows` rows with the smallest hash of seed and key; personal columns are dropped.

    The same seed gives the same rows wherever the data lies, another seed others.
    On a large table the sort would collect `rows` rows of every task, so rows whose
    hash is far too large are dropped first. The cut leaves about four times the
    rows wanted; should it leave too few, the whole table is sorted.
    """
    if rows < 0:
        raise ValueError("a sample has at least 0 rows")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    kept = [c for c in df.columns if c not in pii]
    hashed = df.withColumn("_digest", digest)
    share = _SPARE * rows / max(1, df.count())
    if share < 1:
        low = hashed.filter(F.left("_digest", F.lit(_DIGITS)) < format(int(share * 16**_DIGITS), f"0{_DIGITS}x"))
        if low.select("_digest").count() >= rows:
            hashed = low
    return hashed.orderBy("_digest", *key).limit(rows).select(*kept)
