"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last `SPAN` bytes ends a chunk wherever its value is one less than
a multiple of the block size, so equal stretches of two texts are cut at equal places.
Each chunk gives one character of the signature. Block sizes are 3 * 2^k; the one taken is
the smallest that makes at most `CHUNKS` chunks, so a signature is bounded and the text is
used whole. A fingerprint is `block:signature:...`, four signatures, at that block size and
the next three.

Likeness (0 to 1) looks at the smallest block size both fingerprints have: 1 minus the
edit distance of the signatures (a replaced character counts as removed and added) over
their joined length. It is 0 without a common block size, or where signatures share no run
of `RUN` characters (all characters of a shorter one), as unrelated texts agree by chance
here and there.

The query compares each text with the next one in ascending order of doc_id. Texts move
once: they are range-partitioned and sorted, and a task sees the next text right behind
each one. Only the first and last text of a task cross over, by their own small join.

Defined results: a null text is empty, and empty texts have the fingerprint `3::::`; rows
without doc_id come last; rows of one doc_id are ordered by a hash of the text, then by
place; the one row of a table is its own next one; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, table

SPAN = 7
SMALLEST = 3
CHUNKS = 64
SIGNATURES = 4
RUN = 4
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = 0x01000193


def rolling(data: bytes) -> np.ndarray:
    """At every byte, a hash of it and the six before (zeros before the text)."""
    padded = np.frombuffer(bytes(SPAN - 1) + data, np.uint8).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(SPAN):  # the oldest byte has been multiplied most often
        out *= np.uint32(_FACTOR)
        out += padded[k : k + len(data)]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def boundaries(data: bytes) -> tuple[int, list[np.ndarray]]:
    """The block size, and the chunk ends at it and at the following ones."""
    hashes = rolling(data)
    size = SMALLEST
    ends = np.flatnonzero(hashes % np.uint32(size) == size - 1)
    while len(ends) >= CHUNKS:
        size *= 2
        ends = ends[hashes[ends] % np.uint32(size) == size - 1]  # a multiple of 2n is one of n
    found, at = [ends], size
    for _ in range(SIGNATURES - 1):
        at *= 2
        ends = ends[hashes[ends] % np.uint32(min(at, 0xFFFFFFFF)) == at - 1]
        found.append(ends)
    return size, found


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    size, levels = boundaries(data)
    parts = [str(size)]
    for ends in levels:
        start, letters = 0, []
        for end in [*(ends + 1).tolist(), len(data)]:
            if end > start:
                letters.append(_LETTERS[zlib.crc32(data[start:end]) >> 26])
            start = end
        parts.append("".join(letters))
    return ":".join(parts)


def common_letters(left: str, right: str) -> int:
    """Length of the longest common subsequence; the rows of its table are the bits of one number."""
    places: dict[str, int] = {}
    for k, letter in enumerate(left):
        places[letter] = places.get(letter, 0) | 1 << k
    every = (1 << len(left)) - 1
    row = every
    for letter in right:
        match = row & places.get(letter, 0)
        row = (row + match | row - match) & every
    return len(left) - row.bit_count()


def share_a_run(left: str, right: str) -> bool:
    run = min(RUN, len(left), len(right))
    seen = {left[k : k + run] for k in range(len(left) - run + 1)}
    return any(right[k : k + run] in seen for k in range(len(right) - run + 1))


def likeness(left: str, right: str) -> float:
    """How like two fingerprints are, 0 to 1."""
    if left == right:
        return 1.0
    sizes, signatures = [], []
    for mark in (left, right):
        size, *levels = mark.split(":")
        sizes.append([int(size) << k for k in range(len(levels))])
        signatures.append(levels)
    common = sorted(set(sizes[0]) & set(sizes[1]))
    if not common:
        return 0.0
    one, two = (levels[of.index(common[0])] for of, levels in zip(sizes, signatures))
    if not one or not two or not share_a_run(one, two):
        return 0.0
    return 2 * common_letters(one, two) / (len(one) + len(two))


def edited(text: str, following: str) -> str:
    """The text with the last half of its characters replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_MARKED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    data = changed.encode()
    changed_mark = mark if changed == text else fingerprint(changed)
    return (
        doc_id, len(text), hashlib.sha256(data).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [field.split()[0] for field in _MARKED.split(", ")]


def compared_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to each other and to the next document's."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("task"))

    # Rows of a task, its last one without a following text; besides them its first and last text.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, task = None, [], None
        blank = (None,) * 3
        for batch in batches:
            for doc_id, text, task in zip(*(column.to_pylist() for column in batch.columns)):
                mark = fingerprint(text)
                if held is None:
                    out.append((*(None,) * 7, task, "first", text))
                else:
                    out.append((*_row(*held, text, mark), *blank))
                held = (doc_id, text, mark)
                if len(out) >= 500:
                    yield _batch(out, names, types)
                    out = []
        if held is not None:
            out.append((held[0], *(None,) * 6, task, "last", held[1]))
        if out:
            yield _batch(out, names, types)

    names, types = [*_NAMES, "task", "edge", "edge_text"], [*_TYPES, pa.int32(), pa.string(), pa.string()]
    folder = shared_folder(spark, "fingerprints")
    parted.mapInArrow(run, f"{_MARKED}, task int, edge string, edge_text string").write.parquet(folder)
    found = spark.read.parquet(folder)

    # Tasks with rows, in order: their numbers only.
    tasks = sorted(r.task for r in found.where("edge = 'first'").select("task").collect())
    after = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, next_task int")
    first = found.where("edge = 'first'").select(F.col("task").alias("next_task"), F.col("edge_text").alias("following"))
    last = found.where("edge = 'last'").select("task", "doc_id", F.col("edge_text").alias("text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(column.to_pylist() for column in batch.columns)):
                yield _batch([_row(doc_id, text, fingerprint(text), following, fingerprint(following))], _NAMES, _TYPES)

    edges = last.join(after, "task").join(first, "next_task").select("doc_id", "text", "following").mapInArrow(close, _MARKED)
    return found.where("edge IS NULL").select(*_NAMES).unionByName(edges)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, held against edited texts and the next documents."""
    return compared_in_order(table(spark, sf_dir, "documents"))
