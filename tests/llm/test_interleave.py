import collections
import zlib

from plumbline.llm import interleave as module
from plumbline.llm.interleave import interleave, op6_interleaved_shards, write_shards


def check(rows, n_shards):
    """Counts at most one apart, slots without gaps, and every shard close to the mixture."""
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    counts = [len(shards[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for source, n in collections.Counter(r.stratum for r in rows).items():
        for own in shards.values():
            assert abs(sum(r.stratum == source for r in own) - n / n_shards) < 2


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET_ROWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op6_interleaved_shards(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, 24)
    check(interleave(docs, 7, seed=3, bucket_rows=40).collect(), 7)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    again = op6_interleaved_shards(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_odd_rows(spark, tmp_path):
    plain = [(i, "x" * (i % 3), "hot" if i % 3 else None, i) for i in range(100)]
    plain += [(7, "same", "s", 1)] * 5 + [(None, None, "s", 1), (None, "", None, 2)] + [(200, "long " * 100_000, "t", 0)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, source string, slot int")
    rows = interleave(docs, 24, bucket_rows=10).collect()
    check(rows, 24)
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id is None] == [(8, 0), (8, 0)]
    assert len({(r.shard, r.slot) for r in rows}) == len(plain)
    assert interleave(docs.limit(0)).count() == 0
    check(interleave(docs.limit(5), 24).collect(), 24)
    folder = write_shards(docs.drop("slot"), 4, str(tmp_path / "shards"))
    back = spark.read.parquet(folder)
    assert back.count() == len(plain) and set(back.columns) == {"doc_id", "text", "source", "slot", "shard"}
