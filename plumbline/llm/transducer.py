"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three machines are compiled from a model file:

* the normaliser: spaces become the mark U+2581, one is put in front (as the model says);
* the piece transducer: a trie over characters, whose accepting states write a piece;
  a character that is no piece is written as the pieces of its UTF-8 bytes;
* the joint acceptor: which piece may follow which. In a model of merges, two pieces may
  stand side by side exactly if merging their characters alone gives these two pieces
  again; a sequence is the model's encoding exactly if all its neighbours may. In a
  model of scored pieces (unigram) all may, and a piece costs minus its score.

An input is composed with them and the shortest path is taken in the tropical semiring
(costs add along a path, the least wins): a state is a place in the text and the last
piece, so that the path is found place by place. In a model of merges every place has
one state of finite cost at most, as the encoding of a prefix is unique.

As no piece holds a mark after another character, paths split there; such stretches
(words, in effect) are transduced once and remembered up to a bound. Decoding is the
inverse machine.

Defined results: null and empty texts have no ids; repeated rows get equal results; a
null doc_id is passed on; no rows give no rows. Whole texts are encoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import MEMO_ENTRIES, giving_back, table

MARK = "▁"
_INFINITE = float("inf")


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, pieces: list[tuple[str, float, bool]], byte_pieces: dict[int, int], *, merges: bool, unknown: int = 0,
                 prefix: bool = True, squeeze: bool = False, entries: int = 3 * MEMO_ENTRIES // 2) -> None:
        """pieces: text, score and whether it is an ordinary piece, by id; byte_pieces: byte -> id."""
        self.texts = [text for text, _, _ in pieces]
        self.scores = [score for _, score, _ in pieces]
        self.ids = {text: at for at, (text, _, normal) in enumerate(pieces) if normal}
        self.byte_ids = byte_pieces
        self.bytes_of = {at: byte for byte, at in byte_pieces.items()}
        self.merges, self.unknown, self.prefix, self.squeeze = merges, unknown, prefix, squeeze
        self.longest = max(map(len, self.ids), default=1)
        self.splits = not any(MARK in text.lstrip(MARK) for text in self.ids)
        self.size = len(pieces)
        self.entries = entries
        self.memo: dict[str, bytes] = {}
        self.joints: dict[int, bool] = {}
        self.reachable: dict[str, int] = {}
        #: The trie, as all beginnings of pieces: a path stops where its text is no beginning.
        self.beginnings = {text[:n] for text in self.ids for n in range(1, len(text) + 1)}
        if merges:
            self.ids = {text: at for text, at in self.ids.items() if len(text) == 1 or self.merged(text) == [text]}
        width = 2 if self.size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{width}")
        self.decoded = self._decoded()
        self.singles = {text for text in self.ids if len(text) == 1}
        self.coded = [at.to_bytes(width, "little") for at in range(self.size)]
        #: The trie as nested tables of characters, with the piece that ends at a node under the empty text.
        self.trie: dict = {}
        for text, at in self.ids.items() if merges else ():
            node = self.trie
            for character in text:
                node = node.setdefault(character, {})
            node[""] = at

    @classmethod
    def load(cls, path: str, entries: int = 3 * MEMO_ENTRIES // 2) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if len(model.normalizer_spec.precompiled_charsmap):
            raise ValueError("models with a character map are not supported")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [(p.piece, p.score, p.type == kinds.NORMAL) for p in model.pieces]
        byte_pieces = {int(p.piece[3:5], 16): at for at, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        return cls(
            pieces, byte_pieces, merges=model.trainer_spec.model_type == 2, unknown=model.trainer_spec.unk_id,
            prefix=model.normalizer_spec.add_dummy_prefix, squeeze=model.normalizer_spec.remove_extra_whitespaces, entries=entries,
        )

    # The normaliser.

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    # The joint acceptor.

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters of a short text ends with: always the best-scored pair, the first of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = -_INFINITE, -1
            for k in range(len(symbols) - 1):
                piece = self.ids.get(symbols[k] + symbols[k + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def joint(self, left: int, right: int) -> bool:
        """Whether the right piece may follow the left one."""
        key = left * self.size + right
        known = self.joints.get(key)
        if known is None:
            one, other = self.texts[left], self.texts[right]
            whole = one + other
            known = whole not in self.ids and self.merged(whole) == [one, other]
            if len(self.joints) > 3 * MEMO_ENTRIES // 2:
                self.joints.clear()
            self.joints[key] = known
        return known

    # Composition and shortest path.

    def shortest(self, text: str) -> list[int]:
        """Ids along the shortest path through a normalised text; characters without a piece are -1 - place."""
        n = len(text)
        cost = [_INFINITE] * (n + 1)
        cost[0] = 0.0
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        ids, beginnings, longest = self.ids, self.beginnings, self.longest
        for at in range(n):
            if cost[at] == _INFINITE:
                continue
            last = back[at][1] if at else -1
            for end in range(at + 1, min(n, at + longest) + 1):
                arc = text[at:end]
                piece = ids.get(arc)
                if piece is None:
                    if arc not in beginnings:
                        break
                    continue
                if self.merges:
                    # Arcs between pieces that may not meet cost infinity, all others one.
                    own = cost[at] + 1 if at == 0 or last < 0 or self.joint(last, piece) else _INFINITE
                else:
                    own = cost[at] - self.scores[piece]
                if own < cost[end]:
                    cost[end], back[end] = own, (at, piece)
            if text[at] not in ids:
                own = cost[at] + (1 if self.merges else self.penalty)
                if own < cost[at + 1]:
                    cost[at + 1], back[at + 1] = own, (at, -1 - at)
        path, at = [], n
        while at:
            at, piece = back[at]
            path.append(piece)
        return path[::-1]

    def walked(self, text: str) -> list[int] | None:
        """The path of finite cost of a text whose characters are all pieces of a model of merges; None if there is none.

        The longest piece that may follow is taken, and taken back where nothing may follow it; a place is tried once,
        as one piece at most may end there.
        """
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n, at, last, trie, joints, size, longest = len(text), 0, -1, self.trie, self.joints, self.size, self.longest
        path: list[int] = []
        before: list[tuple[int, int, list[tuple[int, int]]]] = []
        dead: set[int] = set()
        arcs: list[tuple[int, int]] | None = None
        while at < n:
            if arcs is None:
                arcs, node, end = [], trie, at
                for character in text[at : at + longest]:
                    node = node.get(character)
                    if node is None:
                        break
                    end += 1
                    if "" in node:
                        arcs.append((end, node[""]))
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                may = True if last < 0 else joints.get(last * size + piece)
                if may or may is None and self.joint(last, piece):
                    before.append((at, last, arcs))
                    path.append(piece)
                    at, last, arcs = end, piece, None
                    break
            else:
                dead.add(at)
                if not before:
                    return None
                at, last, arcs = before.pop()
                path.pop()
        return path

    @property
    def penalty(self) -> float:
        """Cost of a character without a piece: ten more than that of the worst piece."""
        return 10.0 - min((self.scores[at] for at in self.ids.values()), default=0.0)

    def written(self, text: str) -> bytes:
        """Ids of a normalised stretch as bytes."""
        if self.merges and self.singles.issuperset(text):
            path = self.walked(text)
            if path is not None:
                return b"".join(map(self.coded.__getitem__, path))
        out: list[int] = []
        unknown = False
        for piece in self.shortest(text):
            if piece >= 0:
                out.append(piece)
                unknown = False
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in text[-1 - piece].encode()]
            else:
                if not unknown:  # neighbouring unknown characters are one unknown piece
                    out.append(self.unknown)
                unknown = True
        return np.array(out, self.kind).tobytes()

    def stretches(self, text: str) -> list[str]:
        """A text cut before every mark that follows another character."""
        text = self.normalise(text)
        if not self.splits:
            return [text]
        if MARK + MARK in text:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
        parts = text.split(MARK)
        return [*([parts[0]] if parts[0] else []), *[MARK + p for p in parts[1:]]]

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, little-endian."""
        if not text:
            return b""
        parts, memo = self.stretches(text), self.memo
        found = list(map(memo.get, parts))
        if None in found:
            for at, part in enumerate(found):
                if part is None:
                    ids = memo.get(parts[at])
                    if ids is None:
                        if len(memo) >= self.entries:
                            memo.clear()
                        ids = memo[parts[at]] = self.written(parts[at])
                    found[at] = ids
        return b"".join(found)

    # The inverse machine.

    def _decoded(self) -> list[bytes]:
        return [
            bytes([self.bytes_of[at]]) if at in self.bytes_of else text.replace(MARK, " ").encode() if text in self.ids else b""
            for at, text in enumerate(self.texts)
        ]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, self.kind).tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer.load(path)
    return _machines[path]


def encode_pieces(text: Column, model_path: str) -> Column:
    """A column of the ids of `text`: array<int>."""

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = machine(model_path)
        for part in parts:
            yield pa.array([np.frombuffer(transducer.encode(t.as_py()), transducer.kind).astype(np.int32) for t in part], pa.list_(pa.int32()))

    return run(text)


def decode_pieces(ids: Column, model_path: str) -> Column:
    """A column of the text that ids stand for; null for null."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = machine(model_path)
        for part in parts:
            yield pa.array([None if x is None else transducer.decode(np.array(x, transducer.kind).tobytes()) for x in part.to_pylist()], pa.string())

    return run(ids)


def encoded_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32 (little-endian 32-bit ids), same_text (decoding gives the text back), and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = machine(model_path)
        byte_ids = np.zeros(transducer.size, bool)
        byte_ids[list(transducer.bytes_of)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                data = [transducer.encode(t) for t in texts]
                ids = [np.frombuffer(d, transducer.kind) for d in data]
                columns = [
                    part.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(byte_ids[i].sum()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([transducer.decode(d) == (t or "") for d, t in zip(data, texts)], pa.bool_()),
                    *([pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("same_text", pa.bool_())]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        giving_back(run), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, same_text boolean" + (", ids array<int>" if with_ids else "")
    )


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as pieces and back: number and checksum of its ids, and whether decoding gives the text."""
    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids."""
    return encoded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
