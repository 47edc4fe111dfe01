"""What the training-data operators share: reading tables, cutting lineage, words and their hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Longest memo of a Python worker, in entries; a full memo is emptied, so memory stays bounded.
MEMO_ENTRIES = 400_000
#: Rows that a task holds at least before small partitions are not put together any more.
TASK_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir of the session.

    Where it is unset (one machine, as in tests) a folder of this machine is set in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="plumbline-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The name of a new folder below the shared one."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


#: Spark's setting that the shuffle files of a query are removed when it ends, and not when the driver happens to collect garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made inside leave no shuffle files behind when an action on them ends. A frame should have one action."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder: a lost executor costs no recomputation.

    The shuffles behind them are not needed any more; their files are removed.
    """
    shared_root(df.sparkSession)
    with tidy_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame of its own, as the setting holds for frames made under it


def packed(df: DataFrame, n_rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same rows, about n_rows, in fewer tasks where they are dealt over more partitions than they fill.

    Partitions are put together up to `task_rows` rows a task, and to no less than two tasks a core: a larger table stays as it is.
    """
    return df.coalesce(max(_least_tasks(df.sparkSession), -(-n_rows // task_rows))) if packs(df.sparkSession) else df


def _least_tasks(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def packs(spark: SparkSession) -> bool:
    """Do shuffles have so many partitions that `packed` may put some together?"""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) > _least_tasks(spark)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text as UTF-8, A-Z lower-cased; none for null."""
    return text.encode().lower().split() if text else []


#: Memos of this worker that outlive a task's function.
_memos: list[dict] = []


def give_back() -> None:
    """Empty the memos of this worker and return free memory to the machine; for the end of a task, as workers are used again."""
    for memo in _memos:
        memo.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which gives its worker's memory back at the end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound and within a task."""

    def __init__(self) -> None:
        _memos.append(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return values ^ (values >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; fewer words are one run; no words, none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        run = hashes[:n].copy()
        for k in range(1, width):
            run = mix(run * _ODD + hashes[k : k + n])
        run += np.uint64(width)
    return np.unique(run)
