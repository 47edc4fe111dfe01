import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bloom_lm
from plumbline.llm.bloom_lm import Filter, Head, count_of, fill, levels, op7_bloom_model_scores, score_documents, segment_of


def expected(docs):
    def split(text):
        return (text or "").encode().lower().split() + [None]

    train = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in split(t))
    n, spread = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    return [
        (
            i,
            zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1,
            len(split(t)),
            sum(w in c for w in split(t)),
            n,
            sum(math.log10((c[w] + 0.5) / spread) for w in split(t)),
        )
        for i, t in docs
    ]


def check(spark, docs, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    rows, wanted = sorted(map(tuple, rows), key=key), sorted(expected(docs), key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in wanted]
    for r, w in zip(rows, wanted):
        assert r[5] == pytest.approx(w[5], rel=1e-9)
        assert r[6] < 0 or r[2] == 0
    return rows


@pytest.mark.parametrize("head", [1_000_000, 50])
def test_documents_against_plain_counts(spark, monkeypatch, head):
    monkeypatch.setattr(bloom_lm, "HEAD", head)
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = check(spark, docs, op7_bloom_model_scores(spark, folder).collect())
    held = [r for r in rows if r[1]]
    # The model explains text it has not seen better than word frequencies do.
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_a_filter_larger_than_one_pass_scores_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held_out = docs.doc_id % 5 == 1
    one, many = (
        sorted(tuple(r) for r in bloom_lm.score_documents(docs, held_out, max_filter_bytes=size).collect()) for size in (256 << 20, 20_000)
    )
    assert len(one) == docs.count()
    for a, b in zip(one, many):
        assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD", 2)
    rows = [(1, "a b A c"), (1, "a b A c"), (2, None), (None, "z z"), (3, ""), (4, "new words " * 20_000), (None, "z z"), (11, "unseen"), (5, " \n")]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    monkeypatch.setattr(bloom_lm, "table", lambda *_: docs)
    check(spark, rows, op7_bloom_model_scores(spark, "").collect())
    monkeypatch.setattr(bloom_lm, "table", lambda *_: docs.limit(0))
    assert op7_bloom_model_scores(spark, "").count() == 0


def test_filter_and_head():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.geometric(0.3, len(grams))
    segments = []
    for s in range(8):
        own = segment_of(grams, 8) == s
        segments.append(fill(grams[own], counts[own], 1 << 40))
    bloom = Filter(segments)
    found = bloom.levels(grams)
    assert (found >= levels(counts)).all() and (found == levels(counts)).mean() > 0.95
    others = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (bloom.levels(others) > 0).mean() < 0.05
    assert count_of(levels(np.array([1, 2, 3, 4]))).tolist() == [1.0, 2.5, 2.5, 5.5]
    head = Head(grams, counts)
    assert (head.counts_of(grams) == counts).all() and (head.counts_of(others) == 0).all()
    assert sum(len(s) for s in segments) * 64 <= 11 * levels(counts).sum()
    assert len(fill(grams, counts, 10)) == 10  # the bound holds, and every gram is still found
    assert (Filter([fill(grams, counts, 10)]).levels(grams) > 0).all()


@pytest.mark.parametrize("head", [1_000_000, 20, 0])
def test_scores_do_not_depend_on_the_head(spark, sf_dir, monkeypatch, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    held_out = F.col("doc_id") % 5 == 1
    want = {r.doc_id: (r.score, r.base_score) for r in score_documents(docs, held_out).collect()}
    monkeypatch.setattr(bloom_lm, "HEAD", head)
    got = {r.doc_id: (r.score, r.base_score) for r in score_documents(docs, held_out).collect()}
    assert got.keys() == want.keys()
    for doc_id, scores in want.items():
        assert got[doc_id] == pytest.approx(scores, rel=1e-9)


def test_word_probabilities_sum_to_one():
    counts = np.array([1, 1, 2, 3, 4, 7, 8, 1000, 2**40])
    quantised = bloom_lm.count_of(bloom_lm.levels(counts))
    assert [int(bin(c).count("0") + bin(c).count("1") - 1) for c in counts.tolist()] == bloom_lm.levels(counts).tolist()
    spread = sum(0.75 * 2.0 ** len(f"{c:b}") - 0.5 for c in counts.tolist()) + 0.5 * (len(counts) + 1)
    assert ((quantised + 0.5) / spread).sum() + 0.5 / spread == pytest.approx(1)
