"""Language-model scoring with a log-frequency Bloom filter.

The corpus is counted once: words and pairs of neighbouring words (a text ends with an
end token, and begins after one). Counts are quantised to powers of two, and a gram with
level q is put into a Bloom filter as (gram, 1) ... (gram, q). The filter is built in
segments: every gram goes to the segment of its hash, the task that adds up its counts
also sets its bits, and only finished segments reach the driver, which broadcasts them.
Probing (gram, 1), (gram, 2), ... until one is missing gives the level back; errors
are one-sided and rare. Probabilities interpolate pair and word:
P(w | v) = a * c(v w) / c(v) + (1 - a) * P(w), with a growing with c(v).

Size bound: the filter takes `BITS` bits per entry, however many there are, so that probes
err as seldom on any corpus. At most `max_filter_bytes` of it (one segment at least) are on
the driver and in a task at a time: a larger filter is probed group by group of segments,
and the levels found so far travel with the texts. For the base score, the `HEAD` most frequent words are broadcast with exact
counts; counts of all others are joined by shuffle. The model's score uses the filter alone, for all words alike. Counts grow with the corpus, broadcasts do not.

Defined results: a null or empty text is its end token alone; a null doc_id counts as
the empty text in the choice of held-out rows and is passed on; repeated rows count and
are scored each; without training text every count is 0; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, cut, mix, table, words

HEAD = 1_000_000
BITS = 10
MAX_FILTER_BYTES = 256 << 20
SEGMENT_BYTES = 16 << 20
#: Tokens whose counts are put together in a task before they are sent on.
CHUNK = 3_000_000
#: Weight of pairs: WEIGHT * c(v) / (c(v) + DAMPING).
WEIGHT, DAMPING = 0.7, 1.0
END = np.uint64(0x2545F4914F6CDD1D)
_ODD = np.uint64(0xD1342543DE82EF95)

_hashes = WordHashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, and the end token."""
    return np.append(_hashes.of(words(text)), END)


def pairs(found: np.ndarray) -> np.ndarray:
    """Hashes of each token of a text with the one before it; the first follows an end token."""
    with np.errstate(over="ignore"):
        return mix(np.concatenate([[END], found[:-1]]) * _ODD + found)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, 2 for 2-3, 3 for 4-7, ..."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def count_of(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range; 0 for level 0."""
    return np.where(level > 0, 0.75 * 2.0**level - 0.5, 0.0)


def _place(grams: np.ndarray, level: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word within the segment, and four bits of it, for entries (gram, level)."""
    with np.errstate(over="ignore"):
        drawn = mix(grams + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
    word = ((drawn >> np.uint64(32)) * size.astype(np.uint64)) >> np.uint64(32)
    mask = np.zeros(len(grams), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((drawn >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), mask


def segment_of(grams: np.ndarray, n_segments: int) -> np.ndarray:
    return (((grams >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)).astype(np.int64)


def fill(grams: np.ndarray, counts: np.ndarray, most_words: int) -> np.ndarray:
    """The words of one segment."""
    own = levels(counts)
    n = max(1, min(most_words, -(-int(own.sum()) * BITS // 64)))
    bits = np.zeros(n, np.uint64)
    size = np.array([n])
    for level in range(1, int(own.max(initial=0)) + 1):
        word, mask = _place(grams[own >= level], level, size)
        np.bitwise_or.at(bits, word, mask)
    return bits


class Filter:
    """The whole filter, segments one after another, or a group of them from `first` on."""

    def __init__(self, segments: list[np.ndarray], first: int = 0, n_segments: int | None = None) -> None:
        self.first, self.n_segments = first, len(segments) if n_segments is None else n_segments
        self.sizes = np.array([len(s) for s in segments])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = np.concatenate(segments) if segments else np.zeros(0, np.uint64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: 0 if not even (gram, 1) is there."""
        out = np.zeros(len(grams), np.int64)
        if not len(self.bits):
            return out
        segment = segment_of(grams, self.n_segments) - self.first
        at = np.flatnonzero((segment >= 0) & (segment < len(self.sizes)))
        for level in range(1, 64):
            word, mask = _place(grams[at], level, self.sizes[segment[at]])
            at = at[self.bits[self.starts[segment[at]] + word] & mask == mask]
            if not len(at):
                break
            out[at] = level
        return out


class Head:
    """Exact counts of the most frequent words: an open-addressing table."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        slots, at = keys & self.mask, np.arange(len(keys))
        while len(at):
            slot = slots[at].astype(np.int64)
            free = self.counts[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            placed = at[free][first]
            self.keys[slots[placed].astype(np.int64)], self.counts[slots[placed].astype(np.int64)] = keys[placed], counts[placed]
            at = np.setdiff1d(at, placed, assume_unique=True)
            slots[at] = (slots[at] + np.uint64(1)) & self.mask

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """Counts; 0 for words that are not in the head."""
        out = np.zeros(len(keys), np.int64)
        slots, at = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(at):
            slot = slots[at]
            same = self.keys[slot] == keys[at]
            out[at[same]] = self.counts[slot[same]]
            at = at[~same & (self.counts[slot] > 0)]
            slots[at] = (slots[at] + 1) & int(self.mask)
        return out


def _counted(texts: DataFrame, n_segments: int, most_words: int) -> DataFrame:
    """Filter segments (seg, bits) and exact word counts (gram, n) of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for is_word, make in ((True, lambda t: t), (False, pairs)):
                grams, n = np.unique(np.concatenate([make(t) for t in held]), return_counts=True)
                for at in range(0, len(grams), 200_000):
                    some = grams[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(segment_of(some, n_segments).astype(np.int32)),
                            pa.array(some.view(np.int64)),
                            pa.array(n[at : at + 200_000].astype(np.int32)),
                            pa.array(np.full(len(some), is_word)),
                        ],
                        ["seg", "gram", "n", "is_word"],
                    )

        for batch in batches:
            for text in batch.column(0):
                held.append(tokens(text.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, grams, counts, is_word = -1, [], [], []
        for batch in batches:
            if batch.num_rows:
                seg = batch.column(0)[0].as_py()
                grams.append(batch.column(1).to_numpy().view(np.uint64))
                counts.append(batch.column(2).to_numpy())
                is_word.append(batch.column(3).to_numpy(zero_copy_only=False))
        if seg < 0:
            return
        grams, counts, is_word = map(np.concatenate, (grams, counts, is_word))
        found, owner = np.unique(grams, return_inverse=True)
        total = np.bincount(owner, counts).astype(np.int64)
        of_words = np.zeros(len(found), bool)
        of_words[owner[is_word]] = True
        bits = fill(found, total, most_words)
        own, n = found[of_words].view(np.int64), total[of_words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([seg], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())],
            ["seg", "bits", "gram", "n"],
        )
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary()), pa.array(own), pa.array(n)], ["seg", "bits", "gram", "n"]
            )

    # A partition is one segment.
    grams = texts.mapInArrow(count, "seg int, gram long, n int, is_word boolean").repartitionById(n_segments, "seg")
    return cut(grams.mapInArrow(build, "seg int, bits binary, gram long, n long"))


def score_documents(
    docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """Scores of all rows by a model of those that are not held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word frequencies) and score (the model), both log10.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n_segments = max(16, -(-total // SEGMENT_BYTES))
    counted = _counted(rows.filter("NOT held_out").select("text"), n_segments, 1 << 40)
    by_word = counted.filter("gram IS NOT NULL").select("gram", "n")
    # The level of a count is its number of binary digits; the sum of what levels stand for makes word probabilities sum to 1.
    stands_for = F.pow(F.lit(2.0), F.length(F.bin("n"))) * 0.75 - 0.5
    n_train, n_words, n_model = by_word.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(stands_for), F.lit(0.0))
    ).first()
    # At most max_filter_bytes (or one segment) at a time, and HEAD words with their counts, reach the driver and the tasks.
    built = counted.filter("bits IS NOT NULL")
    lengths = {r.seg: r.n for r in built.select("seg", F.octet_length("bits").alias("n")).toLocalIterator()}
    groups, held = [0], 0
    for seg in range(n_segments):
        if held and held + lengths.get(seg, 8) > max_filter_bytes:
            groups.append(seg)
            held = 0
        held += lengths.get(seg, 8)

    def group(start: int, end: int) -> Filter:
        own = built.filter((F.col("seg") >= start) & (F.col("seg") < end)).select("seg", "bits")
        found = {r.seg: np.frombuffer(r.bits, np.uint64) for r in own.toLocalIterator()}
        return Filter([found.get(s, np.zeros(1, np.uint64)) for s in range(start, end)] if found else [], start, n_segments)

    keyed = rows.withColumn("row_key", F.xxhash64("doc_id", "text")).select("doc_id", "held_out", "row_key", "text", F.lit(None).cast("binary").alias("levels"))
    for start, end in zip(groups, groups[1:]):
        # A group before the last: its levels are added to the rows, and it is let go.
        some = docs.sparkSession.sparkContext.broadcast(group(start, end))

        def probe(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    yield _probed(batch.slice(at, 200), some.value)

        keyed = cut(keyed.mapInArrow(probe, keyed.schema))
        some.destroy()
    bloom = group(groups[-1], n_segments)
    # The least count of the head, from how many words have which count: there are few different counts.
    least, held = 1, 0
    for r in by_word.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += r["words"]
        if held > HEAD:
            least = r["n"] + 1
            break
    frequent = by_word.filter(F.col("n") >= least).toArrow()
    head = Head(frequent.column("gram").to_numpy().view(np.uint64), frequent.column("n").to_numpy())
    whole = n_words <= HEAD
    spread, model_spread = n_train + 0.5 * (n_words + 1), n_model + 0.5 * (n_words + 1)
    sent = docs.sparkSession.sparkContext.broadcast((bloom, head))
    del bloom, head, frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, head = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield _scored(part, bloom, head, spread, model_spread, whole)

    scored = cut(
        keyed.mapInArrow(
            run,
            "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", held_out boolean, row_key long, n_tokens long, n_known long, base double, score double, "
            "rare array<struct<gram:long,n:int>>",
        )
    )
    # Words outside the head: their counts are joined, a row per word and document. Equal rows share a key, and so the sums.
    rare = scored.select("row_key", F.explode("rare").alias("r")).select("row_key", "r.gram", F.col("r.n").alias("times"))
    rare = rare.join(by_word, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = rare.groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(spread))).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    copies = scored.filter(F.size("rare") > 0).groupBy("row_key").agg(F.count("*").alias("copies"))
    done = scored.drop("rare").join(sums.join(copies, "row_key"), "row_key", "left")
    per_copy = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + per_copy("rare_known").cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + per_copy("rare_base")).alias("base_score"),
        "score",
    )


_RARE = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())]))


def _levels(part: pa.RecordBatch, found: list[np.ndarray], bloom: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the words and of the pairs of some texts: those that are kept with the texts, and those of the filter."""
    words_of, pairs_of = bloom.levels(np.concatenate(found)), bloom.levels(np.concatenate([pairs(t) for t in found]))
    if part.column(4).null_count < len(part):
        kept = [np.frombuffer(x.as_buffer(), np.uint8).reshape(2, -1) for x in part.column(4)]
        # A gram is in one segment, so that one of the two is 0.
        words_of, pairs_of = words_of + np.concatenate([k[0] for k in kept]), pairs_of + np.concatenate([k[1] for k in kept])
    return words_of, pairs_of


def _probed(part: pa.RecordBatch, bloom: Filter) -> pa.RecordBatch:
    """The rows with the levels that this part of the filter adds."""
    found = [tokens(t.as_py()) for t in part.column(3)]
    ends = np.cumsum([len(t) for t in found])[:-1]
    words_of, pairs_of = (np.split(x.astype(np.uint8), ends) for x in _levels(part, found, bloom))
    kept = pa.array([a.tobytes() + b.tobytes() for a, b in zip(words_of, pairs_of)], pa.binary())
    return pa.RecordBatch.from_arrays([*part.columns[:4], kept], part.schema.names)


def _scored(part: pa.RecordBatch, bloom: Filter, head: Head, spread: float, model_spread: float, whole: bool) -> pa.RecordBatch:
    """Scores of a few texts at once; `whole`: every known word is in the head."""
    found = [tokens(t.as_py()) for t in part.column(3)]
    lengths = np.array([len(t) for t in found])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat = np.concatenate(found)
    exact = head.counts_of(flat)
    # The model has one kind of count for all words: what the filter gives. Exact counts are for the base score.
    of_words, of_pairs = _levels(part, found, bloom)
    counts = count_of(of_words)
    before = np.empty(len(flat))
    before[1:] = counts[:-1]
    before[starts] = counts[ends - 1]  # texts begin after an end token, which is their last
    joint = count_of(of_pairs)
    word = (counts + 0.5) / model_spread
    weight = np.where(before > 0, WEIGHT * before / (before + DAMPING), 0.0)
    pair = np.minimum(1.0, joint / np.maximum(before, 1.0))
    model = np.log10(weight * pair + (1 - weight) * word)
    sure = np.ones(len(flat), bool) if whole else exact > 0
    base = np.where(sure, np.log10((exact + 0.5) / spread), 0.0)
    rare = []
    for start, end in zip(starts, ends):
        grams, n = np.unique(flat[start:end][~sure[start:end]], return_counts=True)
        rare.append([{"gram": g, "n": k} for g, k in zip(grams.view(np.int64).tolist(), n.tolist())])
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            part.column(1),
            part.column(2),
            pa.array(lengths.astype(np.int64)),
            pa.array(np.add.reduceat((exact > 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(model, starts)),
            pa.array(rare, _RARE),
        ],
        ["doc_id", "held_out", "row_key", "n_tokens", "n_known", "base", "score", "rare"],
    )


def op7_bloom_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document, scored by a model of those whose crc32(doc_id as text) mod 5 is not 1."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(table(spark, sf_dir, "documents"), held_out)
