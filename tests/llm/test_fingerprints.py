import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.fingerprints import CHUNKS, common_letters, compared_in_order, edited, fingerprint, likeness, op13_fingerprints


def plain_common(left, right):
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_edit_distance(left, right):
    assert common_letters(left, right) == plain_common(left, right)


def prose(seed, words):
    made = random.Random(seed)
    return " ".join("".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 9))) for _ in range(words))


def test_signatures_are_bounded_and_use_the_whole_text():
    for text in ["", "a", "a" * 100_000, "ab" * 50_000, prose(1, 30_000), "é" * 999, "\x00" * 500]:
        size, *levels = fingerprint(text).split(":")
        assert len(levels) == 4 and len(levels[0]) <= CHUNKS and int(size) >= 3
    text = prose(2, 5000)
    assert fingerprint(text) != fingerprint(text + " z") != fingerprint("z " + text)


def test_likeness_follows_the_share_that_is_kept():
    text = prose(3, 2000)
    words = text.split(" ")
    marks = [likeness(fingerprint(text), fingerprint(" ".join(words[: 2000 - n] + prose(4, n).split()))) for n in (0, 100, 1000, 2000)]
    assert marks[0] == 1 and marks[1] > 0.8 and 0.3 < marks[2] < 0.75 and marks[3] == 0
    moved = " ".join(words[700:] + words[:700])
    assert likeness(fingerprint(text), fingerprint(moved)) > 0.4
    assert likeness(fingerprint(text), fingerprint("New heading. " + text)) > 0.85
    # Twice the text has another block size, and still much in common.
    assert likeness(fingerprint(text), fingerprint(text + prose(5, 2000))) > 0.3
    assert likeness("3::::", "3::::") == 1 and likeness("3::::", fingerprint(text)) == 0


def test_near_and_unrelated_documents_part(spark, sf_dir):
    rows = op13_fingerprints(spark, sf_dir).collect()
    long = [r for r in rows if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert sum(r.near_next == 0 for r in long) >= 0.9 * len(long)


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = []
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        changed = edited(text, following)
        marks = [fingerprint(t) for t in (text, changed, following)]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks[:2], likeness(*marks[:2]), likeness(marks[0], marks[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_against_brute_force(spark, tasks):
    docs = [(k * 3 - 20, prose(k, k * 7)) for k in range(30)]
    docs += [(1000, "é😀" * 50), (1001, None), (1002, ""), (1003, "x"), (1004, "long " * 30_000), (None, "last of all")]
    frame = spark.createDataFrame([(*d, "c", 5, 6) for d in docs], "doc_id long, text string, fingerprint string, task int, place int")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        found = sorted(map(tuple, compared_in_order(frame.repartition(5)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == brute(docs)


def test_repeated_rows_and_ids(spark):
    docs = [(7, "same text")] * 20 + [(7, "other")] + [(None, None)] * 5
    found = compared_in_order(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == 26 and {r.n_chars for r in found} == {9, 5, 0}
    assert len({r.fingerprint for r in found if r.n_chars == 9}) == 1
    # All but the last copy are followed by a copy.
    assert sum(r.near_next == 1 for r in found if r.n_chars == 9) == 19


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = compared_in_order(one).collect()
    assert [r.edited_sha256 for r in row] == [hashlib.sha256(b"abcabc").hexdigest()] and row[0].near_next == 1
    assert compared_in_order(one.where("doc_id = 2")).collect() == []
