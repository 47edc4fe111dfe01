"""Alignment of two tokenizers' tokens by the bytes they cover.

A document is encoded as space and text by a byte-level tokenizer (A, tokenizers
library) and as text by a SentencePiece model (B), which adds that space itself. The
libraries' spans (character offsets of A, spans of B's result proto) are coarse cuts. A
span that is not as long as its token's own bytes belongs to a part of a character, or
to one byte of a fallback run; its cut is put where the decoded bytes end. Cuts that
both sides share part the tokens into groups; tokens whose bytes overlap are linked.
(The proto is the one that the installed sentencepiece still offers; older releases
called it immutable.)

Text is cut at spaces between two other characters before it is encoded: both
encodings part there (no piece of B has a space behind another character, which is
looked up; otherwise texts are encoded whole). So a stretch is aligned once and
remembered, up to a bound in bytes.

How many documents hold an id pair is counted by Spark. Links are scored with the pairs
of the highest counts, a list of bounded length that is broadcast; links of all other
pairs are joined with their counts.

Defined results: null and empty texts, and texts whose joined tokens of either side are
not space and text (a literal U+2581, or a model that rewrites text), have no tokens:
zeros and '' for the digest. A row is a document, with repeated or null doc_id too. No
rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from operator import attrgetter, itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shared_folder, table

#: Bytes of remembered stretches a worker holds, by estimate.
MEMO_BYTES = 96 << 20
#: Most pairs that are broadcast with their counts (17 bytes each).
HEAD_PAIRS = 1_000_000
#: Characters that are encoded at once; one longer text is taken alone.
PART_CHARS = 1 << 21

#: Stretches that are encoded as one text, for fewer calls of the libraries.
TOGETHER = 64

_LETTER_LAST = re.compile(r"\S\Z")
_FREE = re.compile(r"(?<=\S) (?=[\s\S])")
_AFTER_SPACE = re.compile(r"\s ")
_SPAN = attrgetter("id", "end")
_MARKS = (",", ";", "|")
_NOTHING = (np.array([0, 0, 0], np.int64).tobytes(), "", b"")


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def refined(coarse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: where their spans end, or their own bytes where that is inside a character or a fallback run."""
    decoded = np.cumsum(lengths)
    return np.where(coarse == decoded, coarse, decoded)


def linked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens that overlap, in order of A, then B."""
    first = np.searchsorted(b_ends, np.append(0, a_ends[:-1]), "right")
    last = np.searchsorted(np.append(0, b_ends[:-1]), a_ends, "left")
    counts = last - first
    of_a = np.repeat(np.arange(len(a_ends)), counts)
    return of_a, np.arange(len(of_a)) - np.repeat(np.cumsum(counts) - counts - first, counts)


class Aligner:
    """Aligned tokens of whole texts."""

    def __init__(self, byte_level: str, pieces: str, memo_bytes: int = MEMO_BYTES) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        shown = byte_table()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size()  # that of an added token stays empty
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(shown.get(c, 0) for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]
        self.a_lengths = np.array([*map(len, self.a_bytes)], np.int64)
        self.b_lengths = np.array([*map(len, self.b_bytes)], np.int64)
        # Every id with every mark before it, by number of the mark, then id.
        self.stride = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = np.array([mark + str(i) for mark in _MARKS for i in range(self.stride)], object)
        self.parted = not any("▁" in name.lstrip("▁") for name in names)
        self.room = memo_bytes
        self.used = 0
        self.memo: dict[str, tuple[bytes, str, bytes] | None] = {}

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both sides over texts, one behind the other; None if the tokens are not the texts."""
        a, a_coarse, b, b_coarse, want, at = [], [], [], [], [], 0
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        of_b = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        for text, found, proto in zip(texts, of_a, of_b):
            data = text.encode()
            ends = np.array([end for _, end in found.offsets], np.int64)
            if len(data) != len(text):  # characters to bytes
                lead = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
                ends = np.append(np.flatnonzero(lead), len(data))[ends]
            a += found.ids
            a_coarse.append(ends + at)
            spans = [*map(_SPAN, proto.pieces)]
            b += [i for i, _ in spans]
            b_coarse.append(np.array([end for _, end in spans], np.int64) + (at + 1))  # the added space is not in the spans
            want.append(data)
            at += len(data)
        whole = b"".join(want)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        return (
            a_ids,
            refined(np.concatenate(a_coarse), self.a_lengths[a_ids]),
            b_ids,
            refined(np.concatenate(b_coarse), self.b_lengths[b_ids]),
        )

    def aligned(self, stretches: list[str]) -> list[tuple[bytes, str, bytes] | None]:
        """Per stretch (which begins with the space): counts of A tokens, B tokens and groups, groups as text, pairs."""
        texts, start = [], 0
        for k, stretch in enumerate(stretches):  # a stretch that ends in white space must not touch the next one
            if k == len(stretches) - 1 or k - start == TOGETHER or not _LETTER_LAST.search(stretch):
                texts.append("".join(stretches[start : k + 1]))
                start = k + 1
        found = self.joined(texts)
        ends = np.cumsum([len(s.encode()) for s in stretches])
        alone = len(stretches) == 1
        if found is None:
            return [None] if alone else [self.aligned([s])[0] for s in stretches]
        a, a_ends, b, b_ends = found
        shared = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        if not np.isin(ends, shared).all():
            return [None] if alone else [self.aligned([s])[0] for s in stretches]
        of_a, of_b = linked(a_ends, b_ends)
        pairs = (a[of_a] << 32 | b[of_b]).tobytes()
        # Both sides in one order: by group, A before B. The first of a side in its group has its own mark.
        group = np.concatenate([np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        key = (group * 2 + side)[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        marks = np.where(first, side[order] + 1, 0)
        shown = self.shown[marks * self.stride + np.concatenate([a, b])[order]].tolist()
        n_a, n_b, n_groups = (np.searchsorted(e, ends, "right") for e in (a_ends, b_ends, shared))
        n_links = np.searchsorted(a_ends[of_a], ends, "right")
        counts = np.diff(np.stack([n_a, n_b, n_groups], 1), axis=0, prepend=0).tobytes()
        out, item, link = [], 0, 0
        for k, (next_item, next_link) in enumerate(zip((n_a + n_b).tolist(), n_links.tolist())):
            out.append((counts[24 * k : 24 * k + 24], "".join(shown[item:next_item])[1:], pairs[8 * link : 8 * next_link]))
            item, link = next_item, next_link
        return out

    def stretches(self, text: str) -> list[str]:
        """Space and text, cut where both encodings part."""
        if self.parted and text and text[-1] != " " and not _AFTER_SPACE.search(" " + text):  # they part at every space
            return [" " + part for part in text.split(" ")]
        first, *others = _FREE.split(" " + text) if self.parted else [" " + text]
        return [first, *[" " + part for part in others]]

    def know(self, stretches: set[str]) -> None:
        missing = list(stretches.difference(self.memo))
        if self.used > self.room:  # keep what is in use just now
            self.memo = {s: self.memo[s] for s in stretches if s in self.memo}
            self.used = sum(map(self.weight, self.memo.items()))
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            items = [*zip(part, self.aligned(part))]
            self.memo.update(items)
            self.used += sum(map(self.weight, items))

    @staticmethod
    def weight(item: tuple[str, tuple[bytes, str, bytes] | None]) -> int:
        return 260 + len(item[0]) * 2 + (len(item[1][1]) + len(item[1][2]) if item[1] else 0)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """Per text: the three counts, groups as text ('' without tokens), linked pairs in order."""
        parted = [self.stretches(text) if text else [] for text in texts]
        self.know(set().union(*parted))
        for text, parts in zip(texts, parted):
            found = [*map(self.memo.__getitem__, parts)]
            if None in found:  # stretches may differ and their sum not, so the whole text decides
                found = [self.aligned([" " + text])[0] or _NOTHING]
            counts = np.frombuffer(b"".join(map(itemgetter(0), found)), np.int64).reshape(-1, 3).sum(0)
            yield counts, ";".join(map(itemgetter(1), found)), np.frombuffer(b"".join(map(itemgetter(2), found)), np.int64)


def in_parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Few long texts, or many short ones, at a time."""
    part: list[str | None] = []
    chars = 0
    for text in texts:
        part.append(text)
        chars += len(text or "")
        if chars > PART_CHARS or len(part) == 1000:
            yield part
            part, chars = [], 0
    if part:
        yield part


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, pairs array<long>, times array<int>"


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its distinct id pairs and how often each is linked; `row` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces)
        for batch in batches:
            at = 0
            for part in in_parts(batch.column("text").to_pylist()):
                rows, pairs, times, sizes = [], [], [], [0]
                for counts, shown, linked in aligner.documents(part):
                    kinds, often = np.unique(linked, return_counts=True)
                    digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
                    rows.append((*counts.tolist(), len(linked), digest))
                    pairs.append(kinds)
                    times.append(often.astype(np.int32))
                    sizes.append(sizes[-1] + len(kinds))
                numbers = [pa.array(column, pa.int64()) for column in list(zip(*rows))[:4]]
                offsets = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        *numbers,
                        pa.array([r[4] for r in rows], pa.string()),
                        batch.column("row").slice(at, len(part)),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times))),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "pairs", "times"],
                )
                at += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents that hold it, and whether that is the most of any pair with its A id."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")))
    a_id: Column = F.shiftright("pair", 32)
    # As many rows as the vocabulary of A has entries, at most.
    most = F.broadcast(counts.groupBy(a_id.alias("a")).agg(F.max("documents").alias("most")))
    return counts.join(most, a_id == most["a"]).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def head_threshold(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs are held by as many documents."""
    level = F.floor(F.log2("documents")).cast("int")
    found = dict(counts.groupBy(level.alias("level")).count().collect())  # 63 rows at most
    taken = 0
    for level in sorted(found, reverse=True):
        taken += found[level]
        if taken > most:
            return 1 << (level + 1)
    return 1


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long, others array<struct<pair:long,times:int>>"


def scored_documents(aligned: DataFrame, counts: DataFrame, *, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Aligned documents with the sums over their links: n_best and count_sum."""
    spark = aligned.sparkSession
    threshold = head_threshold(counts, head_pairs)
    head = counts.where(F.col("documents") >= threshold).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(head.column(k).to_numpy() for k in ("pair", "documents", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, documents, best = known.value
        for batch in batches:
            lists, often = batch.column("pairs"), batch.column("times")
            kinds, times = lists.flatten().to_numpy(), often.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(pair, kinds), max(len(pair) - 1, 0))
            hit = pair[place] == kinds if len(pair) else np.zeros(len(kinds), bool)
            sums, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner[hit], documents[place[hit]] * times[hit])
            np.add.at(n_best, owner[hit], best[place[hit]] * times[hit])
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))])
            others = pa.StructArray.from_arrays([pa.array(kinds[~hit]), pa.array(times[~hit].astype(np.int32))], ["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(7)]
                + [pa.array(n_best), pa.array(sums), pa.ListArray.from_arrays(pa.array(left, pa.int32()), others)],
                [*batch.schema.names[:7], "n_best", "count_sum", "others"],
            )

    scored = aligned.mapInArrow(run, _SCORED)
    if threshold > 1:  # pairs beyond the head: each of them is held by fewer documents than the threshold
        folder = shared_folder(spark, "scored")
        scored.write.parquet(folder)
        scored = spark.read.parquet(folder)
        tail = counts.where(F.col("documents") < threshold)
        more = (
            scored.select("row", F.inline("others"))
            .join(tail, "pair")
            .groupBy("row")
            .agg(
                F.sum(F.col("documents") * F.col("times")).alias("more_sum"),
                F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"),
            )
        )
        scored = (
            scored.drop("others")
            .join(more, "row", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        )
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, *, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """A row per document: tokens of both sides, groups, links and how usual they are in the corpus."""
    folder = shared_folder(docs.sparkSession, "aligned")
    aligned_documents(docs, byte_level, pieces).write.option("compression", "zstd").parquet(folder)
    aligned = docs.sparkSession.read.parquet(folder)
    return scored_documents(aligned, cut(pair_counts(aligned)), head_pairs=head_pairs)


def op11_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in both vocabularies, aligned by bytes."""
    docs = table(spark, sf_dir, "documents")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
