import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from plumbline.llm.latent import plain_words


def shingle_set(text):
    found = text.encode().lower().split()
    width = min(5, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1)) if found else frozenset()


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "encoding"]
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = spark.createDataFrame(stages["quality"](spark, docs, folder).collect(), docs.schema)
    kept = {r.doc_id for r in good.collect()}
    poor = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{folder}/labels.parquet' WHERE quality = 0 OR toxic = 1").fetchall()}
    fine = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{folder}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()}
    assert good.columns == docs.columns and len(kept & fine) >= 0.97 * len(fine) and len(kept & poor) < 0.4 * len(poor)

    # One document of each group: no two kept ones are alike, and every dropped one is linked to others.
    unique = stages["near_duplicates"](spark, good, folder)
    left = sorted(r.doc_id for r in unique.collect())
    assert unique.columns == docs.columns and len(set(left)) == len(left) and set(left) <= kept
    sets = {i: shingle_set(texts[i]) for i in kept}

    def alike(i, j):
        both = len(sets[i] & sets[j])
        return both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    assert not any(alike(i, j) for n, i in enumerate(left) for j in left[n + 1 :])
    assert all(any(alike(i, j) for j in kept if j != i) for i in kept - set(left))

    # No benchmark item is left whole.
    clean = stages["decontamination"](spark, unique, folder)
    rest = {r.doc_id for r in clean.collect()}
    items = [b" %s " % b" ".join(plain_words(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()]
    holding = {i for i in left if any(t in b" %s " % b" ".join(plain_words(texts[i])) for t in items)}
    assert clean.columns == docs.columns and not rest & holding and len(set(left) - rest - holding) <= 0.02 * len(left) + 2

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == rest
    for r in rows[:200]:
        assert r.ids == library.encode(texts[r.doc_id]) and r.same_text


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = "/root/testdata/sf0.001"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 20_000, None, None, None)], schema)
    for docs, low, high in ((empty, 0, 0), (odd, 0, 4)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            rows = docs.collect()
            assert low <= len(rows) <= high
            if name != "encoding":
                docs = spark.createDataFrame(rows, schema)
    assert np.all([len(r.ids) == r.n_pieces for r in rows])
