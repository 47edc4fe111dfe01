import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import collocations as module
from plumbline.llm.collocations import collocations


def brute(docs, least, top):
    counts = defaultdict(Counter)
    for text, lang in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        some = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in some.items():
            inside = any(
                len(x) > len(g) and 100 * b >= 80 * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in some.items()
            )
            if not inside:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


PHRASES = [
    "New York city hall. New York", "new york City\tHall, a b a b a b", "x x x x x x", None, "", "...", "é Éa é Éa", "a\x0bb a\x1cb a b", "Zz zz ZZ; 😀 😀 �",
]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 5), (1, 2000)])
def test_against_brute_force(spark, least, top):
    docs = [(text, lang) for k, text in enumerate(PHRASES * 16) for lang in ("en", None, "und", "de")[: 1 + k % 4]]
    docs.append(("long " * 3 + "hot pair " * 5000, "en"))
    frame = spark.createDataFrame([(*d, "z", 1, 2) for d in docs], "text string, lang string, w1 string, n int, key int")
    assert rows(collocations(frame, least=least, top=top)) == brute(docs, least, top)


@pytest.mark.parametrize("bits,size", [(16, 16 << 20), (28, 60)])
def test_bitmap_and_parts_do_not_matter(spark, sf_dir, monkeypatch, bits, size):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in frame.select("text", "lang").limit(60).collect()]
    want = brute(docs, 3, 50)
    monkeypatch.setattr(module, "PART_BYTES", size)
    small = spark.createDataFrame(docs, "text string, lang string")
    texts = module._texts(small, "text", "lang")
    if bits == 16:  # a bitmap that lets everything through
        import numpy as np

        counted = module.windows(texts, np.full((1 << bits) // 8, 255, np.uint8))
        phrases, _ = module.marginals(counted, 3)
        found = {(r.lang, r.phrase): r.f for r in phrases.collect()}
        counted = module.windows(texts, module.prefix_bitmap(texts, 3))
        phrases, _ = module.marginals(counted, 3)
        assert found == {(r.lang, r.phrase): r.f for r in phrases.collect()} and len(found) > 100
    assert rows(collocations(small, least=3, top=50)) == want


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    some = spark.createDataFrame(
        [("en", ["a"], "a", 1, big), ("en", ["b"], "b", 1, big), ("en", ["a", "b"], "a b", 2, big - 7)],
        "lang string, words array<string>, phrase string, size int, f long",
    )
    assert [tuple(r) for r in module.scored_phrases(some).select("a", "l", "r", "score").collect()] == [
        (big - 7, big, big, 2_000_000 * (big - 7) // (2 * big))
    ]


def test_windows_hold_little_memory():
    numbers = np.random.default_rng(5)
    part = module.Part("en", [" ".join(f"w{n}" for n in numbers.integers(0, 500, 200_000))])
    bits = np.full(1 << 13, 255, np.uint8)
    tracemalloc.start()
    lead, order, first, often = part.windows(bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert often.sum() == len(part.at) and peak < 90 * len(part.at)
    sorted_windows = [tuple(lead[:, i]) for i in order[first][:1000]]
    assert sorted_windows == sorted(set(sorted_windows))
