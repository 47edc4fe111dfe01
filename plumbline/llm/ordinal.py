"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score s is the sum of one shared weight per hashed feature it shows: distinct
words, their first four and first five letters, and coarse shares of kinds of
characters. Ordered thresholds t_0 < t_1 < ... turn the score into grades:
P(grade <= k) = 1 / (1 + exp(s - t_k)). The expected grade ranks texts; the tail
probability P(grade >= top) selects them.

Weights are fitted on at most `max_labelled` rated documents, chosen by the hash of
their id. Features that worse grades do not show more often weigh nothing, so that a
long text is not judged by its many neutral words; the others are fitted with step
sizes of their own and soft thresholding. Every document is scored whole, in one
pass without a shuffle; the weights that are not 0 are all that is sent around.

Defined results: a null text is an empty one, and has the features of one; ratings
that are null, or of a null id, do not count; several ratings of one document count as
the worst; without any rating every expected grade is the top one and everything is
kept; repeated rows get equal results; a null doc_id is passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import MEMO_ENTRIES, cut, give_back, table

MAX_LABELLED = 16_000
#: Least chance of the top grade of what is kept.
KEEP_FROM = 0.7
BITS = 22
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SPACES = b" \t\n\r\x0b\x0c"
#: Marks whose share of the text is a feature.
_MARKS = "!|*#%&$@?<>{}=_~^/\\"


def _share(part: float, whole: float) -> int:
    """A share on a coarse scale: 0, up to 1/64, 1/32, ... 1."""
    return 0 if not part or not whole else max(1, 7 + int(np.floor(np.log2(part / whole))))


def shape(text: str, data: bytes, found: list[bytes], distinct: int) -> list[bytes]:
    """Coarse properties of the whole text, as feature names."""
    n = len(data)
    marks = [f"{m}{_share(text.count(m), n)}" for m in _MARKS if m in text]
    lines = text.split("\n")
    return [
        name.encode()
        for name in (
            *marks,
            f"upper{_share(n - len(data.translate(None, _UPPER)), n)}",
            f"other{_share(len(data.translate(None, _LETTERS + _SPACES)), n)}",
            f"distinct{_share(distinct, len(found))}",
            f"lines{_share(len(lines) - len(set(lines)), len(lines))}",
            f"words{min(12, len(found).bit_length())}",
            f"length{min(20, n // max(1, len(found)))}",
        )
    ]


def kinds(text: str | None) -> tuple:
    """The features of a text: distinct words, their beginnings, and its shape; each kind is hashed apart."""
    text = text or ""
    data = text.encode()
    found = data.lower().split()
    distinct = set(found)
    return distinct, {w[:4] for w in distinct}, {w[:5] for w in distinct}, shape(text, data, found, len(distinct))


def slot(feature: bytes, kind: int, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(feature, kind) >> (64 - bits)


def indices(text: str | None, bits: int) -> np.ndarray:
    return np.unique([slot(f, kind, bits) for kind, some in enumerate(kinds(text)) for f in some]).astype(np.int32)


@dataclass
class Ordinal:
    """Shared weights of the features in `slots` (all others weigh nothing), and ordered thresholds; grades are 0 .. len(thresholds)."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; a row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(scores)[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, *, updates: int = 4000, batch: int = 256,
        step: float = 0.1, shrink: float = 1e-2, seed: int = 7) -> Ordinal:
    """Fit by minibatches with moment estimates and steps that shrink to zero; deterministic for given rows of slots."""
    slots, flat = np.unique(np.concatenate(rows), return_inverse=True)
    ends = np.cumsum([len(r) for r in rows])
    rows = np.split(flat, ends[:-1])
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    n, n_cuts = len(slots), n_grades - 1
    # One vector: the weights, then the thresholds.
    state = np.concatenate([np.zeros(n), np.maximum.accumulate(np.log(shares / (1 - shares)) + 1e-3 * np.arange(n_cuts))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    rng = np.random.default_rng(seed)
    order = np.zeros(0, np.int64)
    for update in range(1, updates + 1):
        if not len(order):
            order = rng.permutation(len(rows))
        some, order = order[:batch], order[batch:]
        flat = np.concatenate([rows[i] for i in some])
        owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
        scores, y = np.bincount(owner, state[flat], len(some)), grades[some]
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - state[None, n:], -60, 60)))  # P(grade <= k)
        bounds = np.hstack([np.zeros((len(some), 1)), below, np.ones((len(some), 1))])
        high, low = bounds[np.arange(len(y)), y + 1], bounds[np.arange(len(y)), y]
        gradient = np.zeros_like(state)
        gradient[:n] = np.bincount(flat, (1 - high - low)[owner], n)  # minus d log P / d score
        slope = below * (1 - below) / np.maximum(1e-12, high - low)[:, None]
        for k in range(n_cuts):
            gradient[n + k] = slope[y == k + 1, k].sum() - slope[y == k, k].sum()
        gradient /= len(some)
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        rate = step * (1 - update / (updates + 1))
        state -= rate * (first / (1 - 0.9**update)) / (np.sqrt(second / (1 - 0.999**update)) + 1e-8)
        state[:n] = np.minimum(0, state[:n] + rate * shrink)  # such features speak against a text only
        state[n:] = np.maximum.accumulate(state[n:])  # thresholds stay in order
    weighty = state[:n] < 0
    return Ordinal(slots[weighty], state[:n][weighty], state[n:], bits)


def rated(docs: DataFrame, ratings: DataFrame, *, max_labelled: int, bits: int) -> DataFrame:
    """doc_id, grade and feature slots of at most `max_labelled` rated documents; ratings has doc_id and grade (0, 1, ...)."""
    chosen = (
        ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indices(t, bits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "slots"]
            )

    # At most max_labelled rows of two numbers: small enough to broadcast whatever the tables hold.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    return rows.mapInArrow(run, "doc_id long, grade int, slots array<int>")


def telling(found: DataFrame, of_grade: list[int], least: float) -> DataFrame:
    """The slots that worse grades show more often than better ones, by `least` standard errors of the share."""
    grades = range(len(of_grade))
    per_slot = (
        found.select(F.explode("slots").alias("slot"), "grade")
        .groupBy("slot")
        .agg(*[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in grades])
    )
    share = (sum(F.col(f"g{g}") for g in grades) + 1) / (sum(of_grade) + 2)
    says = F.lit(False)
    for k in grades[:-1]:
        n_worse, n_better = sum(of_grade[: k + 1]), sum(of_grade[k + 1 :])
        if n_worse and n_better:
            worse, better = (sum(F.col(f"g{g}") for g in some) for some in (grades[: k + 1], grades[k + 1 :]))
            error = F.sqrt(share * (1 - share) * (1 / n_better + 1 / n_worse))
            says = says | (worse / n_worse - better / n_better >= least * error)
    return per_slot.filter(says).select("slot")


def train(
    docs: DataFrame, ratings: DataFrame, n_grades: int, *, max_labelled: int = MAX_LABELLED, bits: int = BITS, least: float = 4.0
) -> Ordinal | None:
    """The model of the ratings; None without any.

    Features are screened by Spark; the driver gets the telling ones and, of the sample, only those.
    """
    found = cut(rated(docs, ratings, max_labelled=max_labelled, bits=bits))
    counts = {r.grade: r["count"] for r in found.groupBy("grade").count().collect()}
    if not counts:
        return None
    slots = telling(found, [counts.get(g, 0) for g in range(n_grades)], least).toArrow().column("slot").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(s.values.to_numpy(), sent.value, assume_unique=True) for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.list_(pa.int32()))], batch.schema.names)

    rows = found.mapInArrow(run, "doc_id long, grade int, slots array<int>").toArrow()
    lists = rows.column("slots").combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    order = np.lexsort((np.diff(ends), rows.column("doc_id").to_numpy()))
    grades = rows.column("grade").to_numpy()[order].astype(int)
    return fit([flat[ends[i] : ends[i + 1]] for i in order], grades, n_grades, bits)


class Scorer:
    """Scores texts, remembering the weights of features up to a bound."""

    def __init__(self, model: Ordinal) -> None:
        self.weights, self.bits = dict(zip(model.slots.tolist(), model.weights.tolist())), model.bits
        self.memos: list[dict[bytes, float]] = [{}, {}, {}, {}]

    def score(self, text: str | None) -> float:
        parts: list[float] = []
        for kind, some in enumerate(kinds(text)):
            memo = self.memos[kind]
            values = list(map(memo.get, some))
            if None in values:
                if len(memo) > MEMO_ENTRIES:
                    memo.clear()
                values = [memo.get(f) if f in memo else self.learn(memo, f, kind) for f in some]
            parts += values
        return math.fsum(parts)  # exact, so the order of the sets does not matter

    def learn(self, memo: dict[bytes, float], feature: bytes, kind: int) -> float:
        value = memo[feature] = self.weights.get(slot(feature, kind, self.bits), 0.0)
        return value


def scored(docs: DataFrame, model: Ordinal | None, n_grades: int, text: Column) -> Column:
    """A column of the expected grade and the tail probabilities of `text`: struct<expected_grade, tails>."""
    if model is None:
        return F.struct(F.lit(float(n_grades - 1)).alias("expected_grade"), F.array(*[F.lit(1.0)] * (n_grades - 1)).alias("tails"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade:double,tails:array<double>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for part in parts:
            tails = sent.value.tails(np.array([scorer.score(t.as_py()) for t in part]))
            yield pa.StructArray.from_arrays(
                [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], ["expected_grade", "tails"]
            )
        del scorer
        give_back()

    return run(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings on one scale: 0 poor, 1 well written but toxic, 2 good."""
    return labels.select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN coalesce(toxic, 0) <> 0 THEN 1 WHEN quality IS NOT NULL THEN 2 END AS grade"))


def op8_graded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, the chance of the top grade, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, grades_of(table(spark, sf_dir, "labels")), 3)
    rows = docs.select("doc_id", scored(docs, model, 3, F.col("text")).alias("_is"))
    return rows.select(
        "doc_id",
        F.col("_is.expected_grade").alias("expected_grade"),
        F.col("_is.tails")[1].alias("p_good"),
        (F.col("_is.tails")[1] >= KEEP_FROM).alias("kept"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose chance of the top grade is at least `KEEP_FROM`."""
    model = train(docs, grades_of(table(spark, sf_dir, "labels")), 3)
    return docs.filter(scored(docs, model, 3, F.col("text"))["tails"][1] >= KEEP_FROM)
