import numpy as np
import pytest

from plumbline.llm import forest
from plumbline.llm.forest import near_vectors


def brute(rows):
    """(n_links, component) of every row, by comparing all vectors of a label."""
    ids = [(i if i is not None else 1 << 62) for i, _, _ in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fine = []
    for at, (_, vector, label) in enumerate(rows):
        if label is not None and vector is not None and None not in vector:
            v = np.array(vector, np.float64)
            if len(v) and np.isfinite(v).all() and (v != 0).any():
                v = v / np.abs(v).max()
                fine.append((at, v / np.linalg.norm(v), label))
    for x, (a, u, label) in enumerate(fine):
        for b, v, other in fine[x + 1 :]:
            if label == other and len(u) == len(v) and u @ v >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                if p != q:
                    parent[q] = p
    least = {}
    for at in range(len(rows)):
        least[root(at)] = min(least.get(root(at), 1 << 63), ids[at])
    return sorted((ids[at], links[at], least[root(at)]) for at in range(len(rows)))


def results(frame):
    big = 1 << 62
    return sorted((r.vec_id if r.vec_id is not None else big, r.n_links, r.component_id if r.component_id is not None else big) for r in frame.collect())


@pytest.mark.parametrize("leaf", [1024, 24])
def test_embeddings_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF", leaf)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(8)
    for n in range(600):  # near vectors at about the threshold
        _, vector, label = rows[n % 200]
        noise = rng.standard_normal(len(vector)) * np.linalg.norm(vector) / len(vector) ** 0.5
        rows.append((1000 + n, (np.array(vector) + noise * rng.uniform(0.1, 0.45)).astype(np.float32).tolist(), label))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, wanted = results(near_vectors(table)), brute(rows)
    links = sum(w[1] for w in wanted)
    assert links > 0 and all(f[1] <= w[1] for f, w in zip(found, wanted))
    # One leaf per label is exact; after several splits nearly all links are still found.
    assert sum(f[1] for f in found) >= (1 if leaf == 1024 else 0.97) * links
    if leaf == 1024:
        assert found == wanted


def test_groups_of_like_vectors(spark, monkeypatch):
    # A third of all rows are one vector, another third scaled copies of one: no projection parts them.
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, base.tolist(), 1) for i in range(100)]
    rows += [(100 + i, (base * (1 + i)).tolist(), 2) for i in range(100)]
    rows += [(200 + i, rng.standard_normal(8).tolist(), int(i % 3)) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert results(near_vectors(frame, trees=10)) == brute(rows)


def test_hot_tight_labels_after_many_splits(spark, monkeypatch):
    # Typical cosines of 0.75 and 0.85 within a label, and pairs at 0.93 or a little above.
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    vectors, labels = [], []
    for label, typical, n in ((1, 0.75, 120), (2, 0.85, 40)):
        center = unit(rng.standard_normal(64))
        for _ in range(n):
            one = typical**0.5 * center + (1 - typical) ** 0.5 * unit(rng.standard_normal(64))
            noise, cosine = rng.standard_normal(64), rng.uniform(0.931, 0.95)
            noise = unit(noise - (noise @ unit(one)) * unit(one))
            vectors += [one, cosine * unit(one) + (1 - cosine**2) ** 0.5 * noise]
            labels += [label] * 2
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(vectors, labels))]
    found, wanted = results(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))), brute(rows)
    links = {of: [sum(x[1] for x in part if labels[x[0]] == of) for part in (found, wanted)] for of in (1, 2)}
    print("recall", {of: f / w for of, (f, w) in links.items()})
    assert all(f[1] <= w[1] for f, w in zip(found, wanted))
    assert all(f >= 0.98 * w > 0 for f, w in links.values())


def test_a_label_of_one_leaf_is_compared_once(spark, monkeypatch):
    compared, plain = [], forest._linked_in_leaves
    monkeypatch.setattr(forest, "_linked_in_leaves", lambda leaves, cosine: compared.append(leaves.count()) or plain(leaves, cosine))
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(3 if i % 3 else 5).tolist(), i % 2) for i in range(120)]  # two lengths in a batch
    assert results(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)
    assert compared == [120]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.1], 1), (None, [1.0, 0.05], 1),
        (12, [1e-30, 0.0], 1), (13, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, node string")
    assert results(near_vectors(frame)) == brute(rows)
    assert near_vectors(frame.limit(0)).count() == 0
