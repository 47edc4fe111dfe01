import itertools
import random

from plumbline.llm import latent
from plumbline.llm.latent import common, contaminated, decontamination_stage, masks, plain_words

WORDS = [a + b for a, b in itertools.product("ba ce di fo gu ha je ki lo mu na pe qui ro sa te vi wo xa ye".split(), "ral ston mick len dar pov".split())]
WORDS += [a + b + "s" for a, b in itertools.product(WORDS[:60], WORDS[60:80])]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    random.seed(3)
    for _ in range(300):
        a = [random.choice([b"x", b"y", b"z", b"w"]) for _ in range(random.randint(1, 90))]
        b = [random.choice([b"x", b"y", b"z", b"q"]) for _ in range(random.randint(0, 120))]
        assert common(masks(a), len(a), b) == lcs(a, b)


def corpus(spark):
    random.seed(9)
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(12, 90))) + ".") for i in range(20)]
    items += [(98, "alpha beta gamma"), (99, None), (100, ""), (101, " ... ")]
    docs, planted = [], set()
    for n in range(300):
        text = random.choices(WORDS, k=random.randint(0, 400))
        if n % 10 == 0:
            item, own = items[n // 10 % 20]
            own = own.rstrip(".").split()
            if n % 20 == 0:  # reworded: every eighth word another
                own = [random.choice(WORDS) if k % 8 == 3 else w for k, w in enumerate(own)]
            at = random.randint(0, len(text))
            text = text[:at] + own + text[at:]
            planted.add((n, item))
        docs.append((n, " ".join(text).capitalize()))
    docs += [(300, None), (301, ""), (None, "words alpha, BETA gamma!"), (None, "alpha gamma beta"), (0, docs[0][1])]
    planted.add((None, 98))
    planted_docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    return planted_docs, spark.createDataFrame(items, "item_id long, text string"), planted


def test_planted_items(spark):
    docs, benchmark, planted = corpus(spark)
    rows = contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted
    assert len(rows) == len(planted) + 1  # the repeated row is reported again
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0


def test_documents_against_phrase_search(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    joined = [(r.doc_id, b" %s " % b" ".join(plain_words(r.text))) for r in docs.collect()]
    exact = {
        (doc, r.item_id) for r in items.collect() for doc, text in joined if b" %s " % b" ".join(plain_words(r.text)) in text
    }
    found = {(r.doc_id, r.item_id): r.lcs_share for r in contaminated(docs, items).collect()}
    assert exact and exact <= found.keys()
    assert len(found) - len(exact) <= 0.2 * len(exact)
    kept = decontamination_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in joined} - {d for d, _ in found}


def test_subsequences_are_looked_for_only_where_enough_words_stand(monkeypatch):
    rng = random.Random(8)
    items = [latent.item_of(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(12)]
    space = latent.Space(items)
    draw = space.draw()
    space.weigh(space.weights * 0, 1000)
    space.decompose(draw * 0, draw)
    finder = latent.Finder(space)
    calls = []
    monkeypatch.setattr(latent, "common", lambda *a: calls.append(a) or common(*a))

    def text(item, n):
        """n of an item's words, in order and among others."""
        own = [items[item].words[i].decode() for i in sorted(rng.sample(range(40), n))]
        return " ".join(w for word in own for w in ("other", word))

    few = [text(k % 12, 12) for k in range(60)]
    assert len(finder.candidates([finder.numbered(plain_words(t)) for t in few])) >= 60
    assert finder.find(few) == [[] for _ in few]
    assert not calls
    # Where enough of them stand, the result is that of a search in all regions alike.
    mixed = [text(k % 12, n) for k in range(12) for n in range(18, 41)] + [" ".join(reversed(text(k, 40).split())) for k in range(12)]
    found = finder.find(mixed + [None, ""])
    assert calls and sum(map(len, found)) > 100 and not any(found[-14:])
    for one, own in zip(mixed, found):
        words = plain_words(one)
        for item_id, _, share, answer in own:
            assert share == common(masks(items[item_id].words), 40, words) / 40
            assert answer == common(masks(items[item_id].answer), len(items[item_id].answer), words) / len(items[item_id].answer)
        best = max(range(12), key=lambda k: common(masks(items[k].words), 40, words))
        if common(masks(items[best].words), 40, words) >= 30:
            assert [item_id for item_id, *_ in own] == [best]
