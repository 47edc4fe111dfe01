"""Phrases whose words keep together, by counts of longest windows that ROLLUP marginalises.

Every word position of a piece of text has one window: the word and the three after it
(lead columns), padded at the end of the piece. Only windows are counted. As each phrase
that starts at a position is a prefix of the window there, Spark's ROLLUP over the four
columns sums the counts of all shorter phrases; no order of n-grams is spelled out apart.

Windows are first cut short where no candidate can go on: before the first word at which
the window's prefix has fewer than `least` occurrences. Prefixes are counted beforehand by a
64-bit hash (a collision only keeps more): words and pairs, then the longer ones whose pairs
are all frequent. Those that reach `least` set a bit in a bitmap of at most 2^`MOST_BITS`
bits, which is broadcast. A prefix of a frequent phrase is frequent, so no window loses one:
the counts of frequent phrases are exact, whatever the bitmap lets through. A window of
length 0 still counts its position, so the sum over a language is its number of words.

Defined results: null text has no words; a null language is `und`; repeated rows count
each; no rows give no rows. All sums are 64-bit, products are decimals of 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, giving_back, mix, table

WORDS = 4
#: Log2 of the longest bitmap: 32 MB.
MOST_BITS = 28
#: Bytes of text that a task looks at together; a longer text is taken alone.
PART_BYTES = 16 << 20

#: A-Z in lower case, separators of pieces as line ends, tabs as spaces.
_CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09",
    b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ",
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a bitmap, as bitmap_construct_agg makes them.
_ROW_BITS = 32768


class Part:
    """Words of some texts of one language as numbers; pieces and texts end with -1."""

    def __init__(self, lang: str, texts: list[str]) -> None:
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        number = index.__getitem__
        found = []
        for text in texts:
            of_text: list[int] = []
            for piece in text.encode().translate(_CLEAN).split(b"\n"):
                words = piece.split()
                if words:
                    of_text.extend(map(number, words))
                    of_text.append(-1)
            found.append(np.array(of_text, np.int32))
        self.lang = lang
        self.words = list(index)
        # Three further ends, so that leads of the last word exist.
        self.ids = np.concatenate([*found, np.full(WORDS - 1, -1, np.int32)])
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.word_keys = mix(hashes ^ seed)
        self.at = np.flatnonzero(self.ids >= 0)

    def first_keys(self) -> np.ndarray:
        """Hash of the word at every position."""
        return self.word_keys[self.ids[self.at]]

    def longer(self, places: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (of phrases one word shorter) where a phrase of this size starts, and its hash there."""
        follow = self.ids[places + size - 1]
        inside = follow >= 0
        with np.errstate(over="ignore"):
            return places[inside], mix(keys[inside] * _ODD + self.word_keys[follow[inside]])

    def windows(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest windows: a row per place in them, an order that puts equal ones together, where each begins there, how often it is."""
        lead = np.full((WORDS, len(self.at)), len(self.words), np.int32)  # the number behind the words is ''
        places, keys = self.at, self.first_keys()
        for size in range(1, WORDS + 1):
            if size > 1:
                places, keys = self.longer(places, keys, size)
            some = set_bits(bits, keys)
            places, keys = places[some], keys[some]
            lead[size - 1, np.searchsorted(self.at, places)] = self.ids[places + size - 1]
        del places, keys
        order = np.lexsort(lead[::-1])
        begins = np.zeros(len(order), bool)
        begins[0] = True
        for row in lead:  # a row at a time, to hold one sorted copy
            row = row[order]
            begins[1:] |= row[1:] != row[:-1]
        first = np.flatnonzero(begins)
        return lead, order, first, np.diff(np.append(first, len(order)))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Texts of a task by language, some megabytes at a time."""
    held: dict[str, list[str]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            held[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= PART_BYTES:
                yield Part(lang, held.pop(lang))
                del sizes[lang]
            elif sum(sizes.values()) >= 2 * PART_BYTES:
                fullest = max(sizes, key=sizes.__getitem__)
                yield Part(fullest, held.pop(fullest))
                del sizes[fullest]
    while held:
        yield Part(*held.popitem())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def set_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of the keys are set."""
    place = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _short_keys(part: Part) -> Iterator[np.ndarray]:
    yield part.first_keys()
    yield part.longer(part.at, part.first_keys(), 2)[1]


def _long_keys(part: Part, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the phrases of three and four words whose pairs all have their bits set."""
    places, keys = part.longer(part.at, part.first_keys(), 2)
    goes_on = np.zeros(len(part.ids), bool)
    goes_on[places] = set_bits(bits, keys)
    places, keys = places[goes_on[places]], keys[goes_on[places]]
    for size in range(3, WORDS + 1):
        more = goes_on[places + size - 2]
        places, keys = part.longer(places[more], keys[more], size)
        yield keys


def frequent_keys(texts: DataFrame, least: int, bits: np.ndarray | None = None) -> DataFrame:
    """Hashes of words and pairs, or given the bitmap of those of longer phrases, with so many occurrences."""
    known = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for keys in _short_keys(part) if known is None else _long_keys(part, known.value):
                kinds, often = np.unique(keys, return_counts=True)
                for at in range(0, len(kinds), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[some].view(np.int64)), pa.array(often[some])], ["key", "n"])

    found = texts.mapInArrow(giving_back(run), "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bytes of a bitmap in which the low bits of every key name its bit."""
    bits = min(MOST_BITS, max(16, int(keys.count() * 16).bit_length()))
    # The functions count positions from one.
    place = F.col("key").bitwiseAND((1 << bits) - 1) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(((1 << bits) // _ROW_BITS, _ROW_BITS // 8), np.uint8)
    for row, content in rows.toLocalIterator():  # 2^MOST_BITS bits in all, at most
        out[row - 1] = np.frombuffer(content, np.uint8)
    return out.reshape(-1)


def prefix_bitmap(texts: DataFrame, least: int) -> np.ndarray:
    """The bitmap of all phrases that may have so many occurrences."""
    short = cut(frequent_keys(texts, least))
    long = cut(frequent_keys(texts, least, bitmap(short)))
    return bitmap(short.union(long))


def windows(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """lang, w1 to w4, n: counted longest windows per task; '' behind the end of a window."""
    known = texts.sparkSession.sparkContext.broadcast(bits)
    names = [f"w{k + 1}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            if not len(part.at):
                continue
            lead, order, first, often = part.windows(known.value)
            words = pa.array([*part.words, b""], pa.binary()).cast(pa.string())
            for at in range(0, len(first), 1 << 15):
                some = order[first[at : at + (1 << 15)]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.lang] * len(some), pa.string()),
                        *[words.take(pa.array(lead[k, some])) for k in range(WORDS)],
                        pa.array(often[at : at + (1 << 15)]),
                    ],
                    ["lang", *names, "n"],
                )

    return texts.mapInArrow(giving_back(run), "lang string, " + ", ".join(f"{name} string" for name in names) + ", n long")


def marginals(counted: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of phrases with so many occurrences, and (lang, n): all words of a language."""
    names = [f"w{k + 1}" for k in range(WORDS)]
    size: Column = F.lit(0)
    for name in names:
        size = size + (F.lit(1) - F.grouping(name).cast("int"))
    whole = cut(counted.groupBy("lang", *names).agg(F.sum("n").alias("n")))  # shorter prefixes are made of these alone
    sums = whole.rollup("lang", *names).agg(F.sum("n").alias("f"), size.alias("size"), F.grouping("lang").alias("all_langs"))
    last = F.element_at(F.array(F.lit("-"), *names), F.col("size") + 1)  # '' where the window is shorter
    frequent = (F.col("f") >= least) & (last != "")
    sums = cut(sums.where((F.col("all_langs") == 0) & ((F.col("size") == 0) | frequent)))
    words = F.slice(F.array(*names), F.lit(1), F.col("size"))
    phrases = sums.where("size > 0").select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "size", "f")
    return phrases, sums.where("size = 0").select("lang", F.col("f").alias("n"))


def _exact(column: Column, factor: int) -> Column:
    return column.cast("decimal(19,0)") * F.lit(factor).cast("decimal(10,0)")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """Every phrase of two or more words with the parts of its worst cut: lang, phrase, words, size, a, l, r, score."""
    some = phrases.where("size > 1").withColumnRenamed("f", "a")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("tail", F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " "))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    cuts = cuts.withColumn("top", _exact(F.col("a"), 2_000_000)).withColumn("bottom", _exact(F.col("l"), 1) + F.col("r").cast("decimal(19,0)"))
    worst = F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), worst.alias("worst"))
    return scored.select("lang", "phrase", "words", F.size("words").alias("size"), "a", "worst.l", "worst.r", "worst.score")


def without_parts(scored: DataFrame) -> DataFrame:
    """Without phrases inside a longer one that has 80 % of their occurrences or more."""
    starts = F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)
    inner = (
        scored.where("size > 2")
        .select("lang", "words", "size", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
        .select("lang", "words", "length", "longer", F.explode(starts).alias("start"))
        .select("lang", "longer", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    whole = scored.join(inner, ["lang", "phrase"], "left")
    part = F.col("longer").isNotNull() & (_exact(F.col("longer"), 100) >= _exact(F.col("a"), 80))
    return whole.where(~part).drop("longer")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = _texts(docs, text_col, lang_col)
    counted = windows(texts, prefix_bitmap(texts, least))
    phrases, totals = marginals(counted, least)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(cut(scored_phrases(phrases))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # A row per language; most languages are known by name.
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, UNNEST(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS g
  FROM words, (SELECT UNNEST([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
counts AS (SELECT lang, size, g, COUNT(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, SUM(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, g, array_to_string(g, ' ') AS phrase, f FROM counts WHERE f >= 30),
cuts AS (SELECT *, UNNEST(range(1, size)) AS k FROM often WHERE size > 1),
scores AS (
  SELECT c.lang, c.phrase, c.g, c.size, c.f AS a, x.f AS l, y.f AS r, c.k,
    ((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
  FROM cuts c
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[c.k + 1:c.size], ' ')),
worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a AS longer, g, size, len_, UNNEST(range(1, size - len_ + 2)) AS start
  FROM worst, (SELECT UNNEST([2, 3]) AS len_) WHERE len_ < size),
longest AS (SELECT lang, array_to_string(g[start:start + len_ - 1], ' ') AS phrase, MAX(longer) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longest o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * w.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""
