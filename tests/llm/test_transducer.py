import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm.transducer import MARK, Transducer, decode_pieces, encode_pieces, encoded_documents, encoding_stage, machine, op3_piece_transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(transducer, text):
    return np.frombuffer(transducer.encode(text), transducer.kind).tolist()


def test_like_the_library(library):
    random.seed(4)
    parts = [" ", "  ", "\n", "a", "e", "th", "ing", MARK, "é", "漢", "😀", ".", ",", "==", "-", "12", "the", "\t", "<s>", "<0x0A>", "re", "er"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)] + ["a" * 5000, " " * 300]
    transducer = Transducer.load(PATH, entries=100)
    for text in texts:
        assert ids(transducer, text) == library.encode(text)
        if MARK not in text:
            assert transducer.decode(transducer.encode(text)) == text


def test_longest_pieces_first_is_the_shortest_path_with_fewer_places():
    random.seed(8)
    parts = ["a", "e", "th", "ing", "er", "un", "con", "q", "zz", "12", ".", "=", "é", "tion", "ab", "漢"]
    texts = [MARK + "".join(random.choices(parts, k=random.randint(1, 8))) for _ in range(2000)]
    one, other = Transducer.load(PATH), Transducer.load(PATH)
    for text in texts:
        by_place = [i for p in one.shortest(text) for i in ([p] if p >= 0 else [one.byte_ids[b] for b in text[-1 - p].encode()])]
        assert np.frombuffer(other.written(text), other.kind).tolist() == by_place
    # Every neighbourhood looked up costs a merging of characters; the path place by place looks up all that texts hold.
    assert len(other.joints) < 0.9 * len(one.joints)
    assert other.walked("a" * 3000) == other.shortest("a" * 3000)


def test_no_path_where_a_character_is_no_piece():
    pieces = [("<unk>", 0.0, False), ("a", -1.0, True), ("b", -2.0, True), ("ab", -3.0, True), (MARK, -4.0, True)]
    transducer = Transducer(pieces, {}, merges=True)
    assert transducer.walked("abba") == [3, 2, 1] and transducer.walked("") == []
    assert transducer.walked("abx") is None
    assert ids(transducer, "abxxa") == [4, 3, 0, 1]


def test_scored_pieces_take_the_cheapest_path():
    random.seed(6)
    pieces = [("<unk>", 0.0, False)] + [("".join(p), -random.random() * 5, True) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)]
    pieces += [(MARK, -1.0, True), (MARK + "a", -1.5, True)]
    transducer = Transducer(pieces, {}, merges=False)
    scores = {text: score for text, score, normal in pieces if normal}

    def cheapest(text):
        if not text:
            return 0.0
        return min((cheapest(text[n:]) - scores[text[:n]] for n in range(1, 5) if text[:n] in scores), default=float("inf"))

    for _ in range(200):
        text = "".join(random.choices("ab ", k=random.randint(1, 9)))
        found = ids(transducer, text)
        assert "".join(transducer.texts[i] for i in found) == transducer.normalise(text)
        assert sum(-transducer.scores[i] for i in found) == pytest.approx(cheapest(transducer.normalise(text)))
    assert [transducer.texts[i] for i in ids(transducer, "axxa")][-2:] == ["<unk>", "a"]


def test_query_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op3_piece_transducer(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        expected = library.encode(text)
        assert rows[doc_id].n_pieces == len(expected) and rows[doc_id].same_text
        assert rows[doc_id].ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())


def test_odd_rows(spark, library):
    rows = [(1, "one two"), (1, "one two"), (None, None), (2, ""), (3, "long words " * 30_000), (4, f"a{MARK}b")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_pieces int")
    found = encoded_documents(docs, PATH).collect()
    assert [(r.doc_id, r.ids) for r in found] == [(i, library.encode(t or "")) for i, t in rows]
    assert [r.same_text for r in found] == [True] * 5 + [False]  # the mark itself decodes to a space
    assert encoding_stage(spark, docs.limit(0), "").count() == 0
    back = docs.select("text", decode_pieces(encode_pieces(docs.text, PATH), PATH).alias("back")).collect()
    assert all(r.back == (r.text or "").replace(MARK, " ") for r in back)
    assert machine(PATH) is machine(PATH)
