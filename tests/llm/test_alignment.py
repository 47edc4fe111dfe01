import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from plumbline.llm import alignment
from plumbline.llm.alignment import Aligner, align_tokenizers, byte_table, op11_aligned_tokens, refined

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", "a ", "a  ", " a", "x  y", "héllo wörld", "日本語 テキスト", "😀 x😀y", "a\n\n b\tc   d", "\x00b", "é" * 40,
    "<|endoftext|> <s> <0x41> </s>", "don't we'll  1,234.5", "x" * 3000, " line \u0085 next", "é ‍\U0001F469‍\U0001F4BB end", "a \x1c b",
]


@pytest.fixture(scope="module")
def whole():
    """Both encodings of the whole text, and the bytes of tokens, without spans or stretches."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = byte_table()
    entries = {i: bytes(table[c] for c in e) for e, i in a.get_vocab().items() if i != 50256}

    def of_b(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        one = [(i, entries[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, of_b(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (one, two) if all(b"".join(d for _, d in side) == want for side in (one, two)) else ([], [])

    return tokens


def brute(docs, whole):
    plain, held = [], defaultdict(set)
    for row, (doc_id, text) in enumerate(docs):
        one, two = whole(text)
        spans = []
        for side in (one, two):
            at, found = 0, []
            for i, data in side:
                found.append((i, at, at + len(data)))
                at += len(data)
            spans.append(found)
        first = 0
        links = []
        for a, start, end in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= start:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((a, spans[1][k][0]))
                k += 1
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        ends = {e: k for k, e in enumerate(shared)}
        groups = [([], []) for _ in shared]
        for side in (0, 1):
            k = 0
            for i, _, end in spans[side]:
                groups[k][side].append(i)
                k = ends.get(end, k - 1) + 1 if end in ends else k
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        plain.append((doc_id, len(one), len(two), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if one else ""))
        for pair in links:
            held[pair].add(row)
    most = Counter()
    for (a, _), rows in held.items():
        most[a] = max(most[a], len(rows))
    return sorted(
        (
            (d, n, m, g, len(links), sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), sha)
            for d, n, m, g, links, sha in plain
        ),
        key=repr,
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_entries_are_those_of_the_library():
    tokenizer = Tokenizer.from_file(A)
    table = byte_table()
    assert len(table) == len(set(table.values())) == 256
    for entry in list(tokenizer.get_vocab())[:2000]:
        assert bytes(table[c] for c in entry).decode(errors="replace") == decoders.ByteLevel().decode([entry]) or entry == "<|endoftext|>"


def test_spans_are_refined_by_bytes():
    # A character in two tokens; a token with the end of one character and the start of the next; a fallback run.
    assert refined(np.array([1, 3, 3]), np.array([1, 1, 1])).tolist() == [1, 2, 3]
    assert refined(np.array([3, 6, 6]), np.array([2, 2, 2])).tolist() == [2, 4, 6]
    assert refined(np.array([0, 0, 3, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]


def test_stretches_do_not_change_tokens(whole):
    aligner = Aligner(A, B, memo_bytes=0)  # the memo is emptied each time
    for text, (counts, shown, linked) in zip(ODD, aligner.documents(ODD)):
        one, two = whole(text)
        assert counts.tolist()[:2] == [len(one), len(two)], repr(text)
        groups = [g.split("|") for g in shown.split(";")] if shown else []
        assert [i for g in groups for i in g[0].split(",")] == [str(i) for i, _ in one]
        assert [i for g in groups for i in g[1].split(",")] == [str(i) for i, _ in two]


def test_query_against_brute_force(spark, sf_dir, whole):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op11_aligned_tokens(spark, sf_dir)) == brute(docs, whole)


@pytest.mark.parametrize("head", [1_000_000, 3, 0])
def test_odd_rows_and_any_head(spark, whole, head):
    texts = ODD * 2 + ["literal ▁ mark", None, "the the the"]
    docs = [(k % 7 or None, text) for k, text in enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n_a int, pairs string, row int")
    assert rows(align_tokenizers(frame, A, B, head_pairs=head)) == brute(docs, whole)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(empty, A, B).collect() == []


def test_plain_texts_are_cut_without_the_pattern(monkeypatch):
    aligner = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a b", "one", "x\ty z", " a", "a ", "a  b", "a \tb", "a\u3000 b", "\n a", "a\n b", "é ü, c"]
    want = [[first, *[" " + part for part in others]] for first, *others in (alignment._FREE.split(" " + t) for t in texts)]
    assert [aligner.stretches(t) for t in texts] == want
    monkeypatch.setattr(alignment, "_FREE", None)
    assert aligner.stretches("some words, and more") == [" some", " words,", " and", " more"]
