import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import records
from plumbline.llm.records import Encoder, frame, op2_token_records, read_records, tokenize_to_records, unframe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(library):
    random.seed(5)
    parts = ["word", " ", "  ", "\n", "\n\n", "\t", "it's", "don't.", "12", "...", "é", "漢字", " ", " ", "😀", "'", "a.", " b", "x)", "<|endoftext|>", "\r\n", "´s", "é", "5%", "|"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)] + ["", None]
    encoder = Encoder(PATH, 2, entries=200)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        for text, ids in zip(some, encoder.encode_all(some)):
            assert np.frombuffer(ids, "<u2").tolist() == library(text), repr(text)


def test_frames():
    data = frame(b"abc") + frame(b"")
    source = io.BytesIO(data)
    assert unframe(source) == b"abc" and unframe(source) == b""
    for at in range(len(frame(b"abc"))):
        broken = bytearray(frame(b"abc"))
        broken[at] ^= 1
        with pytest.raises(Exception):
            unframe(io.BytesIO(bytes(broken)))


def expected(texts, library):
    out, start = [], 0
    for doc_id, text in sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0)):
        ids = library(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf_dir, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(tuple(r) for r in op2_token_records(spark, sf_dir).collect())
    assert rows == expected(docs, library)


def test_nulls_repeats_clashes_and_shuffled_reads(spark, library, monkeypatch):
    texts = [(5, "five"), (3, None), (None, "no id"), (5, "five"), (4, ""), (9, "long text " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, payload string, file_no int")
    monkeypatch.setattr(records, "table", lambda *_: docs)
    rows = op2_token_records(spark, "").collect()
    assert sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[:2] if r[0] is not None else 0)) == expected(texts, library)
    assert records.op2_token_records(spark, "").count() == 6
    index, folder, _ = tokenize_to_records(docs, PATH, end_id=2)
    some = index.filter("doc_id IN (9, 3)")

    def lengths(payloads):
        import pyarrow as pa

        found = [(d, len(p)) for d, _, p in payloads]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["doc_id", "n"])

    got = {r.doc_id: r.n for r in read_records(some, folder, lengths, "doc_id long, n long").collect()}
    assert got[3] == 2 and got[9] > 2


def test_empty_table(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(records, "table", lambda *_: docs)
    assert op2_token_records(spark, "").count() == 0


def test_strings_of_added_tokens_are_those_tokens(library):
    texts = ["<|endoftext|>", "a b<|endoftext|>c. d", "x <|endoftext|>, y", "<|endoftext", "no such token"]
    found = [np.frombuffer(ids, "<u2").tolist() for ids in Encoder(PATH, 2).encode_all(texts)]
    assert found == [library(t) for t in texts] and found[0] == [50256] and 50256 in found[1] and 50256 not in found[3]


def test_words_with_marks_take_the_short_way(library, monkeypatch):
    text = "One, two; (three) four. x" + "".join(f" word{n}{mark}" for n in range(30) for mark in (",", ".", "!)", "%;"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    asked = []
    whole = records.atoms
    monkeypatch.setattr(records, "atoms", lambda piece: asked.append(piece) or whole(piece))
    odd = ["\tab,", "\nab,", "(ab,)", " ab,,", "a ,b", ",,", " ,", "é, ü;", text]
    found = Encoder(path, 2).encode_all(odd)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == [library(t) for t in odd]
    assert not [piece for piece in asked if piece.startswith(" word")]
