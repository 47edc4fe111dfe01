import random

import numpy as np

from plumbline.llm import ordinal
from plumbline.llm.ordinal import Ordinal, Scorer, grades_of, op8_graded_quality, quality_stage, rated, train


def test_thresholds_and_tails():
    model = Ordinal(np.zeros(0, int), np.zeros(0), np.array([-1.0, 2.0]), 2)
    tails = model.tails(np.array([0.0, 5.0]))
    assert (tails[:, 0] > tails[:, 1]).all() and (tails[1] > tails[0]).all()


def test_graded_words_are_learned(spark):
    random.seed(1)
    texts = []
    for n in range(1500):
        grade = random.randrange(3)
        own = random.choices([f"w{i}" for i in range(200)], k=random.randint(5, 300))
        own += [["bad", "awful"], ["meh"], ["fine", "great"]][grade]
        random.shuffle(own)
        texts.append((n, " ".join(own), grade))
    frame = spark.createDataFrame(texts, "doc_id long, text string, grade int")
    model = train(frame.drop("grade"), frame.filter("doc_id < 1200").drop("text"), 3, bits=16)
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights < 0).all()
    scorer = Scorer(model)
    tails = model.tails(np.array([scorer.score(t) for _, t, _ in texts[1200:]]))
    assert ((tails >= 0.5).sum(axis=1) == np.array([g for _, _, g in texts[1200:]])).mean() > 0.9


def test_scorer_agrees_with_features():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1 << 12)
    model = Ordinal(np.arange(1 << 12), weights, np.array([0.0]), 12)
    scorer = Scorer(model)
    for text in ["a few words here", "", None, "SHOUT!! a few words", "| a | b |"]:
        slots = [ordinal.slot(f, k, 12) for k, some in enumerate(ordinal.kinds(text)) for f in some]
        assert abs(scorer.score(text) - float(weights[slots].sum())) < 1e-9


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, grades_of(labels.filter("doc_id % 5 <> 0")), 3)
    rest = docs.join(grades_of(labels.filter("doc_id % 5 = 0")), "doc_id").select("grade", "text").collect()
    scorer = Scorer(model)
    kept = {g: [] for g in range(3)}
    for grade, text in rest:
        kept[grade].append(model.tails(np.array([scorer.score(text)]))[0, 1] >= ordinal.KEEP_FROM)
    assert np.mean(kept[2]) > 0.97 and np.mean(kept[0]) < 0.1 and np.mean(kept[1]) < 0.25


def test_odd_rows(spark, monkeypatch):
    texts = [(1, "good text " * 5), (2, None), (3, ""), (None, "BAD!!"), (1, "good text " * 5), (4, "word " * 50_000), (5, "BAD!! BAD!!")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id long, text string, expected_grade double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (5, 0, 0), (None, 1, 1), (2, None, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    tables = {"documents": docs, "labels": labels}
    monkeypatch.setattr(ordinal, "table", lambda _s, _d, name: tables[name])
    rows = op8_graded_quality(spark, "").collect()
    assert len(rows) == len(texts) and all(0 <= r.expected_grade <= 2 and r.kept == (r.p_good >= ordinal.KEEP_FROM) for r in rows)
    assert rows[0] == rows[4]
    tables["labels"] = labels.limit(0)
    assert all(r.kept and r.p_good == 1.0 for r in op8_graded_quality(spark, "").collect())
    assert quality_stage(spark, docs, "").collect() == docs.collect()
    tables["documents"] = docs.limit(0)
    assert op8_graded_quality(spark, "").count() == 0
    tables["labels"] = labels
    assert op8_graded_quality(spark, "").count() == 0
    assert rated(docs, grades_of(labels), max_labelled=1, bits=10).count() <= 2
