"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are found again in documents, also when reworded:

1. Passages are windows of 64 words, each starting 32 words after the one before.
   Terms are the words of the benchmark but for its stop words; their inverse passage
   frequency is counted over the whole corpus.
2. A randomised singular value decomposition of the passages' TF-IDF matrix, the
   benchmark's passages included with a weight, gives the latent space: every task adds
   up its share of A'(A W) for a seeded random W, one row per term, and the sum alone
   gives the leading singular vectors (Nystroem). Nothing in it grows with the corpus.
3. Every passage of every document is compared with every benchmark passage by cosine
   in the latent space. A document and an item of which any two passages reach
   `cosine` are candidates.
4. Candidates are confirmed on words: the longest common subsequence of the item and
   the document around the passage must hold `sure` of the item's words, or `likely`
   of them together with most of the item's answer (its last sentence). Where fewer of the
   item's words than that stand around the passage at all, no subsequence is looked for.

Items are searched in blocks of at most `BLOCK_PASSAGES` passages, so what is sent to
the tasks is bounded; the corpus is read twice per block.

Defined results: null and empty texts, and items without words, match nothing; an item
of fewer than `SHORT` words matches only where all its words stand consecutively;
repeated documents are each reported; a null doc_id is passed on; without items or
documents there are no rows. Whole texts are searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, give_back, giving_back, table
from plumbline.llm.licenses import license_words

HALF = 32
BLOCK_PASSAGES = 512
#: Vectors that are gathered at a time: few enough to stay in a processor's cache.
HITS = 12_000
#: Words in more than this share of a block's items, or of all passages, have no weight.
STOP_ITEMS, STOP_PASSAGES = 0.03, 0.005
#: Terms an item keeps, however frequent they are.
LEAST_TERMS = 8
SHORT = 8
COSINE = 0.4
SURE, LIKELY, ANSWER = 0.75, 0.55, 0.6


def plain_words(text: str | None) -> list[bytes]:
    return license_words(text.lower()) if text else []


def masks(found: list[bytes]) -> dict[bytes, int]:
    """Where each word stands, as bits."""
    out: dict[bytes, int] = {}
    for at, word in enumerate(found):
        out[word] = out.get(word, 0) | 1 << at
    return out


def common(places: dict[bytes, int], n: int, region: list[bytes]) -> int:
    """Length of the longest common subsequence of n words (given by their places) and the region."""
    full = (1 << n) - 1
    state = full
    for word in region:
        if (place := places.get(word)) is not None:
            match = state & place
            state = ((state + match) | (state - match)) & full
    return n - state.bit_count()


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]


def item_of(item_id: int | None, text: str) -> Item:
    """The answer is the last sentence, or the last quarter of a single one."""
    found = plain_words(text)
    sentences = [s for s in map(plain_words, re.split(r"[.!?:\n]", text)) if len(s) >= 3]
    answer = sentences[-1] if len(sentences) > 1 else found[-max(3, len(found) // 4) :]
    return Item(item_id, found, answer)


class Space:
    """What tasks need to search a block of items: terms, latent vectors, item passages and words."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        in_items: dict[bytes, int] = {}
        for item in items:
            for word in set(item.words):
                in_items[word] = in_items.get(word, 0) + 1
        often = STOP_ITEMS * len(items)
        terms: set[bytes] = set()
        self.kept: list[set[bytes]] = []
        for item in items:
            rare = sorted(set(item.words), key=lambda w: (in_items[w], w))
            self.kept.append(set(rare[:LEAST_TERMS]))
            terms |= {w for w in rare if in_items[w] <= max(1, often)} | self.kept[-1]
        self.terms = {word: at for at, word in enumerate(sorted(terms))}
        #: (item, words) of the benchmark's own passages; the last one of an item is as long as the others.
        self.passages = [
            (at, item.words[start : start + 2 * HALF])
            for at, item in enumerate(items)
            for start in sorted({min(s, max(0, len(item.words) - 2 * HALF)) for s in range(0, max(1, len(item.words) - HALF), HALF)})
        ]
        self.weights, self.boost = np.ones(len(self.terms)), 1.0
        self.basis = np.zeros((len(self.terms), 0), np.float32)
        self.targets = np.zeros((0, 0), np.float32)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where terms stand in the words, and which."""
        terms = np.fromiter(map(self.terms.get, found, repeat(-1)), np.int32, len(found))
        at = np.flatnonzero(terms >= 0)
        return at, terms[at]

    def rows(self) -> np.ndarray:
        """TF-IDF rows of the benchmark's passages."""
        out = np.zeros((len(self.passages), len(self.terms)))
        for row, (_, found) in enumerate(self.passages):
            _, terms = self.hits(found)
            np.add.at(out[row], terms, self.weights[terms])
        return out

    def weigh(self, counts: np.ndarray, total: int) -> None:
        share = (counts + 1) / (total + 2)
        self.weights = np.log(1 / share)
        stop = share > STOP_PASSAGES
        for kept in self.kept:  # but every item keeps its rarest terms
            stop[[self.terms[w] for w in kept]] = False
        self.weights[stop] = 0
        #: The benchmark's passages together weigh as much as those of the corpus.
        self.boost = 1 + float((counts * self.weights**2).sum()) / max(1e-9, float((self.rows() ** 2).sum()))

    def decompose(self, sums: np.ndarray, draw: np.ndarray) -> None:
        """Leading right singular vectors from the sums A'(A W)."""
        own = self.rows()
        sums = sums + self.boost * own.T @ (own @ draw)
        shift = 1e-7 * np.linalg.norm(sums)
        sums = sums + shift * draw
        core = draw.T @ sums
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max(initial=0) * 1e-9
        half = sums @ (vectors[:, good] / np.sqrt(values[good]))
        left, singular, _ = np.linalg.svd(half, full_matrices=False)
        left = left[:, singular > singular.max(initial=0) * 1e-6]
        self.basis = (left * self.weights[:, None]).astype(np.float32)
        latent = (own @ left).astype(np.float32)
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        self.targets = latent / np.where(norms > 0, norms, 1)

    def draw(self) -> np.ndarray:
        width = min(len(self.terms), len(self.passages) + 32)
        return np.random.default_rng(10).standard_normal((len(self.terms), width))


def _hits(docs: DataFrame, space: Space) -> DataFrame:
    """Per document: number of words, and half-passages and terms of its hits."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        for batch in batches:
            counts, halves, terms = [], [], []
            for text in batch.column(0):
                found = plain_words(text.as_py())
                at, own = space.hits(found)
                counts.append(len(found))
                halves.append((at // HALF).astype(np.int32))
                terms.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (halves, terms))],
                ["n_words", "halves", "terms"],
            )

    return docs.select("text").mapInArrow(giving_back(run), "n_words long, halves array<int>, terms array<int>")


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Non-overlapping passage number and term of all hits of a batch, and the number of passages."""
    passages = (batch.column(0).to_numpy(zero_copy_only=False) + 2 * HALF - 1) // (2 * HALF)
    first = np.cumsum(passages) - passages
    halves, terms = batch.column(1), batch.column(2)
    lengths = np.diff(halves.offsets.to_numpy())
    return np.repeat(first, lengths) + halves.flatten().to_numpy() // 2, terms.flatten().to_numpy(), int(passages.sum())


def _frequencies(hits: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term stands, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            passage, term, n = _spread(batch)
            found = np.sort(passage * n_terms + term)  # faster than np.unique, which hashes numbers
            counts += np.bincount(found[np.diff(found, prepend=-1) > 0] % n_terms, minlength=n_terms)
            total += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int64)), pa.array(np.r_[counts[some], total])], ["term", "n"])

    # A number per term of the benchmark block reaches the driver.
    rows = hits.mapInArrow(giving_back(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(n_terms, np.int64), 0
    for term, n in zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()):
        if term < 0:
            total = n
        else:
            counts[term] = n
    return counts, total


def _added(rows: np.ndarray, which: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows `which`, from each of `begins` to the next; whole groups of about `HITS` are gathered at a time."""
    out = np.empty((len(begins), rows.shape[1]), rows.dtype)
    ends, at = np.append(begins[1:], len(which)), 0
    while at < len(begins):
        start = begins[at]
        last = int(np.searchsorted(begins, start + HITS))
        out[at:last] = np.add.reduceat(rows[which[start : ends[last - 1]]], begins[at:last] - start, axis=0)
        at = last
    return out


def _sums(hits: DataFrame, space: Space, draw: np.ndarray) -> np.ndarray:
    """A'(A W) of all passages: partial sums per task, added up per group of terms."""
    sent = hits.sparkSession.sparkContext.broadcast((space.weights, draw))
    width = draw.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, draw = sent.value
        weighted = (draw * weights[:, None]).astype(np.float32)
        sums = np.zeros((len(weights), width))
        for batch in batches:
            passage, term, n = _spread(batch)
            some = weights[term] > 0
            passage, term = passage[some], term[some]
            for at in range(0, len(term), 100_000):
                # A cut within a passage would split its row: cuts are moved to the next passage.
                start = np.searchsorted(passage, passage[at], "left") if at else 0
                end = np.searchsorted(passage, passage[at + 100_000], "left") if at + 100_000 < len(term) else len(term)
                if end <= start:
                    continue
                p, t = passage[start:end], term[start:end]
                begins = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                rows = _added(weighted, t, begins)
                row = np.cumsum(np.r_[False, p[1:] != p[:-1]])
                order = np.argsort(t, kind="stable")
                begins = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
                sums[t[order][begins]] += _added(rows, row[order], begins)
        sums *= weights[:, None]
        some = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(list(sums[some].astype(np.float32)), pa.list_(pa.float32()))], ["term", "sums"]
        )

    def add(group: pa.Table) -> pa.Table:
        terms, owner = np.unique(group.column("term").to_numpy(), return_inverse=True)
        total = np.zeros((len(terms), width))
        np.add.at(total, owner, group.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, width))
        return pa.table({"term": terms, "sums": pa.array(list(total), pa.list_(pa.float64()))})

    partial = hits.mapInArrow(giving_back(run), "term long, sums array<float>")
    # A row per term of the benchmark block reaches the driver.
    rows = partial.groupBy(F.expr("term div 64")).applyInArrow(add, "term long, sums array<double>").toArrow()
    out = np.zeros((len(space.weights), width))
    if rows.num_rows:
        out[rows.column("term").to_numpy()] = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


class Finder:
    """Finds the items of a block in texts."""

    def __init__(self, space: Space) -> None:
        self.space = space
        self.places = [masks(i.words) for i in space.items]
        self.answers = [masks(i.answer) for i in space.items]
        self.short = [at for at, i in enumerate(space.items) if 0 < len(i.words) < SHORT]
        self.owner = np.array([at for at, _ in space.passages], int)
        #: All words of the items by number (others are -1, the last place), the term with weight that each is, and those of each item.
        self.numbers = {word: at for at, word in enumerate(sorted({w for i in space.items for w in i.words}))}
        terms = [space.terms.get(word, -1) for word in self.numbers]
        self.term = np.array([t if t >= 0 and space.weights[t] > 0 else -1 for t in terms] + [-1], np.int32)
        self.words = [np.array([self.numbers[w] for w in i.words], np.int32) for i in space.items]
        self.stands = np.zeros(len(self.numbers) + 1, bool)

    def numbered(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, found, repeat(-1)), np.int32, len(found))

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """(text, item) -> (first half of a passage, cosine) of the passages alike; texts are numbered words."""
        space, out = self.space, {}
        halves, terms, first = [], [], [0]
        for numbers in texts:
            own = self.term[numbers]
            at = np.flatnonzero(own >= 0)
            halves.append(first[-1] + at // HALF)
            terms.append(own[at])
            first.append(first[-1] + -(-len(numbers) // HALF) + 1)  # an empty half keeps texts apart
        halves, terms, first = np.concatenate(halves), np.concatenate(terms), np.array(first)
        for at in range(0, len(terms), 50_000):
            start = np.searchsorted(halves, halves[at], "left") if at else 0
            last = halves[min(at + 50_000, len(terms) - 1)]
            # Passages are two halves: the next half is looked at too.
            end = np.searchsorted(halves, last, "right") if at + 50_000 >= len(terms) else np.searchsorted(halves, last + 1, "right")
            h, t = halves[start:end], terms[start:end]
            begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sums = _added(space.basis, t, begins)
            h = h[begins]
            # Passages of two halves, and single halves, which short items need.
            follows = np.flatnonzero(h[1:] == h[:-1] + 1)
            h, sums = np.r_[h, h[follows]], np.vstack([sums, sums[follows] + sums[follows + 1]])
            norms = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
            alike = (sums @ space.targets.T) / norms[:, None]
            rows, columns = np.nonzero(alike >= COSINE)
            text = np.searchsorted(first, h[rows], "right") - 1
            for i, c, k, value in zip(text.tolist(), columns.tolist(), (h[rows] - first[text]).tolist(), alike[rows, columns].tolist()):
                out.setdefault((i, int(self.owner[c])), []).append((k, value))
        return out

    def most(self, region: np.ndarray, item: int) -> int:
        """How many of the item's words stand anywhere in the region: no common subsequence is longer."""
        self.stands[region] = True
        self.stands[-1] = False
        both = np.count_nonzero(self.stands[self.words[item]])
        self.stands[region] = False
        return both

    def confirm(self, found: list[bytes], numbers: np.ndarray, item: int, near: list[tuple[int, float]]) -> tuple[float, float]:
        """The largest share of the item, and of its answer, in the document around the passages alike; shares below `LIKELY` may be 0."""
        n = len(self.space.items[item].words)
        share = answer = 0.0
        for half in sorted({k for k, _ in near}):
            around = slice(max(0, half * HALF - n), (half + 2) * HALF + n)
            most = self.most(numbers[around], item) / n
            if most < LIKELY or most <= share:
                continue
            region = found[around]
            own = common(self.places[item], n, region) / n
            if own > share:
                answers = self.space.items[item].answer
                share, answer = own, common(self.answers[item], len(answers), region) / len(answers)
            if share >= 0.999:
                break
        return share, answer

    def find(self, texts: list[str | None]) -> list[list[tuple[int | None, float, float, float]]]:
        """Per text: item id, cosine, share of its words and of its answer, of the items it holds."""
        found = [plain_words(t) for t in texts]
        numbers = [self.numbered(words) for words in found]
        out: list[list[tuple]] = [[] for _ in texts]
        for (row, item), near in self.candidates(numbers).items():
            own = self.space.items[item]
            if len(own.words) < SHORT:
                continue
            share, answer = self.confirm(found[row], numbers[row], item, near)
            if share >= SURE or share >= LIKELY and answer >= ANSWER:
                out[row].append((own.item_id, max(c for _, c in near), share, answer))
        for item in self.short:
            own = self.space.items[item]
            wanted = b" " + b" ".join(own.words) + b" "
            for row, words in enumerate(found):
                if own.words[0] in words and wanted in b" " + b" ".join(words) + b" ":
                    out[row].append((own.item_id, 1.0, 1.0, 1.0))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items with words, in blocks of a bounded number of passages; the driver holds one block at a time."""
    block: list[Item] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        item = item_of(row.item_id, row.text)
        if not item.words:
            continue
        own = max(1, len(item.words) // HALF)
        if block and size + own > BLOCK_PASSAGES:
            yield block
            block, size = [], 0
        block.append(item)
        size += own
    if block:
        yield block


def fitted_space(texts: DataFrame, items: list[Item]) -> Space:
    """The latent space of a block of items and all passages of the texts (column text)."""
    space = Space(items)
    hits = cut(_hits(texts, space))
    space.weigh(*_frequencies(hits, len(space.terms)))
    draw = space.draw()
    space.decompose(_sums(hits.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism), space, draw), draw)
    return space


_FINDING = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
FINDING = "struct<item_id:long,cosine:double,lcs_share:double,answer_share:double>"


def found_items(docs: DataFrame, space: Space, text: Column) -> Column:
    """A column of the block's items found in `text`: array of item_id, cosine, lcs_share, answer_share."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    @F.arrow_udf(f"array<{FINDING}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(sent.value)
        names = [f.name for f in _FINDING]
        for part in parts:
            out = []
            for at in range(0, len(part), 250):
                for found in finder.find(part.slice(at, 250).to_pylist()):
                    out.append([dict(zip(names, f)) for f in sorted(found, key=lambda f: (f[0] is None, f[0] or 0))])
            yield pa.array(out, pa.list_(_FINDING))
        del finder
        give_back()

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer_share of every item found in a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for items in item_blocks(benchmark):
        space = fitted_space(rows.select("text"), items)
        found = rows.select("doc_id", F.explode(found_items(rows, space, F.col("text"))).alias("found"))
        parts.append(cut(found.select("doc_id", "found.*")))
    none = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
    return reduce(DataFrame.unionByName, parts) if parts else none


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that stand in documents, whole or reworded."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    for at, items in enumerate(item_blocks(table(spark, sf_dir, "benchmark"))):
        docs = cut(docs) if at else docs
        space = fitted_space(docs.select(F.col("text").cast("string").alias("text")), items)
        docs = docs.filter(F.size(found_items(docs, space, F.col("text"))) == 0)
    return docs
