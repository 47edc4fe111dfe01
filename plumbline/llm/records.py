"""Token ids as length-delimited binary records, with a separate offset index.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4), the
payload, masked checksum of the payload (4); all numbers little-endian. The checksum
is CRC-32, rotated right by 15 bits plus a constant, so that a record that itself
holds checksums is not mistaken for one. The payload holds the ids of one document,
16 bits each if the vocabulary allows it, else 32.

Files hold ascending stretches of doc_id. The index (Parquet) has a row per record:
file, offset, length, so that records can be read in any order. Attempts of a task
write files of their own name and only the index names those that count: a lost
executor or a second attempt leaves no wrong data.

Defined results: a null or empty text is a document with the end id alone; a null
doc_id sorts first; repeated rows are records of their own; no rows give no files
and an empty index.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import MEMO_ENTRIES, cut, shared_folder, table

FILE_BYTES = 32 << 20
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
INDEX = "doc_id long, file_no int, file string, offset long, length long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def unframe(source) -> bytes:
    """The payload at the reader's position; raises on a damaged record."""
    head = source.read(_HEAD.size)
    length, crc = _HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("record length is damaged")
    payload = source.read(length)
    if masked(payload) != _TAIL.unpack(source.read(_TAIL.size))[0]:
        raise ValueError("record is damaged")
    return payload


def _filesystem(folder: str):
    """The store and path of a folder: a local path, or any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


#: A space that no other white space touches always starts a new word of the byte-level pattern.
_TOUCHING = re.compile(r" \s|\s ")
_FREE = re.compile(r"(?<=\S) (?=\S)")


_INNER = re.compile(r"(?!^ )[^\S\n]")
#: Marks that, after a letter or digit, always begin a pre-token of their own.
_MARKS = ".,;:!?|*%#&$)]}"


def atoms(piece: str) -> list[str]:
    """A piece cut further, where the byte-level pattern cuts too: at lone line ends, and before closing marks."""
    if _INNER.search(piece):
        return [piece]
    lines = piece.split("\n")
    if not all(line and line != " " for line in lines):
        return [piece]
    out = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        head = line.rstrip(_MARKS)
        if head != line and head and head[-1].isalnum():
            out += [head, line[len(head) :]]
        else:
            out.append(line)
    return out


class Encoder:
    """Ids of whole texts as bytes, with the tokenizers library.

    Encoding is by pre-token, and a space between two other characters always begins
    one; so pieces cut there are encoded apart, once, and remembered up to a bound.
    Arrow cuts the texts, finds their distinct pieces and puts the ids together; Python
    handles each distinct piece of a batch once.
    As in a plain call of the library, the string of an added token in a text is that
    token; a text with one is encoded as a whole.
    """

    def __init__(self, path: str, width: int, entries: int = 3 * MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [a for a in added if a]
        self.width = np.dtype("<u2" if width == 2 else "<u4")
        self.entries = entries
        self.memo: dict[str, bytes] = {}

    def has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def pieces(self, text: str) -> list[str]:
        if self.has_added(text):
            return [text]
        parts = _FREE.split(text) if _TOUCHING.search(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if len(parts) > 1 else parts

    def is_plain(self, text: str) -> bool:
        """Whether every space of the text begins a piece, and Arrow may mark it with a NUL."""
        return not (_TOUCHING.search(text) or "\0" in text or self.has_added(text))

    def know(self, pieces: set[str], whole_texts: set[str] = frozenset()) -> dict[str, bytes]:
        """The memo, with all these pieces in it; `whole_texts` are not cut further."""
        memo = self.memo
        missing = pieces.difference(memo)
        if len(memo) + 2 * len(missing) > self.entries:  # keep what is in use just now
            memo = self.memo = {p: memo[p] for p in pieces if p in memo}
        cut_up, heads, tails, joined, single = [], [], [], [], set()
        for piece in missing:
            if piece[1:].isalnum() or piece in whole_texts:  # most pieces are words
                single.add(piece)
                continue
            head = piece.rstrip(_MARKS)
            if len(head) < len(piece) and head[1:].isalnum() and (head[0] == " " or not head[0].isspace()):  # a word and its marks
                cut_up.append(piece)
                heads.append(head)
                tails.append(piece[len(head) :])
                continue
            parts = atoms(piece)
            if len(parts) > 1:
                joined.append((piece, parts))
                single.update(parts)
            else:
                single.add(piece)
        single.update(heads, tails)
        order = list(single.difference(memo))
        kind = "H" if self.width.itemsize == 2 else "I"
        for piece, found in zip(order, self.tokenizer.encode_batch_fast(order, add_special_tokens=False)):
            ids = array(kind, found.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            memo[piece] = ids.tobytes()
        known = memo.__getitem__
        memo.update(zip(cut_up, map(add, map(known, heads), map(known, tails))))
        for piece, parts in joined:
            memo[piece] = b"".join([memo[p] for p in parts])
        return memo

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if sum(map(len, filter(None, texts))) > 1 << 22 and len(texts) > 1:  # few long texts at a time
            half = len(texts) // 2
            return self.encode_all(texts[:half]) + self.encode_all(texts[half:])
        out = [b""] * len(texts)
        plain, other = [], []
        for row, text in enumerate(texts):
            if text:
                (plain if self.is_plain(text) else other).append(row)
        if plain:
            for row, ids in zip(plain, self._encode_plain([texts[row] for row in plain])):
                out[row] = ids
        if other:
            whole_texts = {texts[row] for row in other if self.has_added(texts[row])}
            cut_up = [self.pieces(texts[row]) for row in other]
            memo = self.know(set().union(*cut_up), whole_texts)
            for row, pieces in zip(other, cut_up):
                out[row] = b"".join(map(memo.__getitem__, pieces))
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), " ", "\0 "), "\0")
        found = lists.flatten().dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [*map(self.memo.get, pieces)]
        missing = {piece for piece, of in zip(pieces, known) if of is None}
        if missing:
            memo = self.know(missing)
            known = [memo[piece] if of is None else of for piece, of in zip(pieces, known)]
        ids = pa.array(known, pa.binary()).take(found.indices)
        # The ids of all texts lie in one buffer, in order.
        ends, data = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1], ids.buffers()[2]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [data[start:end].to_pybytes() for start, end in zip(bounds, bounds[1:])]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def id_width(path: str, end_id: int | None = None) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    bounds: list[int] | None = None,
    *,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, file_no and payload: the ids of the whole text, the end id last. Files lie between the bounds of doc_id."""
    ends = np.array(bounds or [], np.int64)
    width = id_width(tokenizer_path, end_id)
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path, width).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                found = [ids + end for ids in encode_all(part.column(1).to_pylist())]
                known = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                file_no = np.searchsorted(ends, known, "left").astype(np.int32)  # the number of bounds below
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(file_no), pa.array(found, pa.binary())], ["doc_id", "file_no", "payload"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, file_no int, payload binary")


def write_records(payloads: DataFrame, folder: str, files: int) -> DataFrame:
    """Write payloads (doc_id, file_no, payload) in ascending doc_id order; returns the index, kept in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        out, name, offset, current = None, "", 0, None
        for batch in batches:
            rows = []
            for doc_id, file_no, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file_no != current:
                    if out:
                        out.close()
                    current, offset = file_no, 0
                    name = f"part-{file_no:06d}-{uuid.uuid4().hex}.records"
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                record = frame(payload)
                out.write(record)
                rows.append((doc_id, file_no, name, offset, len(payload)))
                offset += len(record)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file_no", "file", "offset", "length"])
        if out:
            out.close()

    index = (
        payloads.repartitionById(files, "file_no")
        .sortWithinPartitions("file_no", "doc_id", "payload")
        .mapInArrow(run, INDEX)
    )
    index.write.parquet(f"{folder}/index")
    return payloads.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, function, schema: str, *, files: int | None = None) -> DataFrame:
    """Read the records that the index rows name, `function(rows of (doc_id, file_no, payload))` on each task's.

    Any subset of the index in any order of files will do; within a task, records are read by file and offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)

        def payloads():
            name, source = None, None
            for batch in batches:
                for doc_id, file_no, file, offset in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if file != name:
                        if source:
                            source.close()
                        name, source = file, store.open_input_file(f"{path}/{file}")
                    source.seek(offset)
                    yield doc_id, file_no, unframe(source)

        return function(payloads())

    dealt = index.select("doc_id", "file_no", "file", "offset")
    dealt = dealt.repartitionById(files, "file_no") if files else dealt.repartition("file_no")
    return dealt.sortWithinPartitions("file_no", "file", "offset").mapInArrow(run, schema)


def stretches(docs: DataFrame, id_col: str, text_col: str, file_bytes: int = FILE_BYTES) -> list[int]:
    """Upper bounds of doc_id for files of about `file_bytes` of text; one number per file reaches the driver."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    files = max(-(-total // file_bytes), 2 * spark.sparkContext.defaultParallelism) if total else 1
    if files < 2:
        return []
    shares = [k / files for k in range(1, files)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 100 * files)).first()[0] or []
    return sorted(set(found))


def tokenize_to_records(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    *,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, str, int]:
    """Encode every text and write the record files; returns the index, the folder and the number of stretches."""
    folder = folder or shared_folder(docs.sparkSession, "records")
    bounds = stretches(docs, id_col, text_col)
    payloads = encode_documents(docs, tokenizer_path, bounds, end_id=end_id, id_col=id_col, text_col=text_col)
    return write_records(payloads, folder, len(bounds) + 1), folder, len(bounds) + 1


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as records, read back: position, length and checksum of the ids of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    index, folder, files = tokenize_to_records(table(spark, sf_dir, "documents"), path, end_id=2)
    kind = np.dtype("<u2" if id_width(path, 2) == 2 else "<u4")

    def digests(payloads):
        rows, before, current = [], 0, None
        for doc_id, file_no, payload in payloads:
            before, current = (before if file_no == current else 0), file_no
            ids = np.frombuffer(payload, kind)
            rows.append((doc_id, file_no, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            before += len(ids)
            if len(rows) == 5_000:
                yield _digest_batch(rows)
                rows = []
        if rows:
            yield _digest_batch(rows)

    read = cut(read_records(index, folder, digests, "doc_id long, file_no int, _in_file long, n_tokens long, ids_crc32 long", files=files))
    files_before = (
        read.groupBy("file_no")
        .agg(F.sum("n_tokens").alias("_sum"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_sum").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    return read.join(files_before, "file_no").select(
        "doc_id", (F.col("_before") + F.col("_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "file_no", "_in_file", "n_tokens", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
