"""License scan with ordered signature rules.

The text is reduced to words (A-Z lower-cased, runs of letters, digits and everything
beyond ASCII) joined by single spaces, so that rules need not care for punctuation
and line breaks. Rules are regular expressions over that text. A rule runs only if one of
its keywords is among the words; every text of its name holds one of them. Detections are ordered by rule priority, then length, then
place; one that lies within an accepted detection is suppressed. The three
base phrases are always reported, wherever they stand.

Each document is scanned alone and whole: nothing is shuffled.

Defined results: a null or empty text has no words and no detections; repeated rows
are scanned like others; a null doc_id is passed on; no rows give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table


@dataclass(frozen=True)
class Rule:
    label: str
    name: str
    pattern: re.Pattern
    keywords: frozenset[bytes]
    priority: int
    score: float


#: Phrases that are reported wherever they stand, and their labels.
BASE_PHRASES = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

#: Label, name as a pattern over normalised words, a keyword that most texts of the name hold.
FAMILIES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit (?:0|no attribution)", "mit"),
    ("apache-1.1", "apache (?:software )?(?:license )?(?:version |v)?1 1", "apache"),
    ("apache-2", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("0bsd", "(?:0bsd|bsd zero clause|zero clause bsd)", "clause"),
    ("gpl-1", "(?:gnu )?(?:gpl|general public license) ?(?:version |v)?1(?: 0)?", "gpl"),
    ("gpl-2", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", "gpl"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-2", "gnu general public license (?:version |v)2(?: 0)?", "general"),
    ("gpl-3", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", "gpl"),
    ("gpl-3", "gplv3", "gplv3"),
    ("gpl-3", "gnu general public license (?:version |v)3(?: 0)?", "general"),
    ("lgpl-2.1", "(?:gnu )?lgpl ?(?:version |v)?2 1", "lgpl"),
    ("lgpl-2.1", "gnu lesser general public license (?:version |v)2 1", "lesser"),
    ("lgpl-3", "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?", "lgpl"),
    ("lgpl-3", "gnu lesser general public license (?:version |v)3(?: 0)?", "lesser"),
    ("agpl-3", "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?", "agpl"),
    ("agpl-3", "gnu affero general public license(?: (?:version |v)3(?: 0)?)?", "affero"),
    ("gfdl-1.3", "(?:gnu free documentation license|gfdl)(?: (?:version |v)?1 3)?", "free"),
    ("mpl-1.1", "(?:mozilla public license (?:version |v)?|mpl ?(?:version |v)?)1 1", "mozilla"),
    ("mpl-2", "mozilla public license (?:version |v)?2(?: 0)?", "mozilla"),
    ("mpl-2", "mpl ?(?:version |v)?2(?: 0)?", "mpl"),
    ("epl-1", "eclipse public license (?:version |v)?1(?: 0)?", "eclipse"),
    ("epl-2", "eclipse public license (?:version |v)?2(?: 0)?", "eclipse"),
    ("cddl-1", "(?:common development and distribution license|cddl)(?: (?:version |v)?1(?: 0)?)?", "development"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost-1", "boost software license(?: (?:version |v)?1(?: 0)?)?", "boost"),
    ("artistic-2", "artistic license (?:version |v)?2(?: 0)?", "artistic"),
    ("artistic-1", "artistic license(?: (?:version |v)?1(?: 0)?)?", "artistic"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "(?:psf|python software foundation)", "python"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1.1", "(?:sil )?open font license(?: (?:version |v)?1 1)?", "font"),
    ("odbl-1", "(?:open database license|odbl)(?: (?:version |v)?1(?: 0)?)?", "database"),
    ("odc-by-1", "open data commons attribution(?: license)?", "commons"),
    ("pddl-1", "public domain dedication and license", "dedication"),
    ("cc0-1", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "cc0"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: (?:[1-4] 0|2 5))?(?: international| unported)?", "by"),
    ("cc-by-sa", "cc by sa(?: (?:[1-4] 0|2 5))?", "sa"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: (?:[1-4] 0|2 5))?", "commons"),
    ("cc-by-nd", "cc by nd(?: (?:[1-4] 0|2 5))?", "nd"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: (?:[1-4] 0|2 5))?", "commons"),
    ("cc-by-nc", "cc by nc(?: (?:[1-4] 0|2 5))?", "nc"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: (?:[1-4] 0|2 5))?", "commons"),
    ("cc-by-nc-sa", "cc by nc sa(?: (?:[1-4] 0|2 5))?", "nc"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: (?:[1-4] 0|2 5))?", "commons"),
    ("cc-by-nc-nd", "cc by nc nd(?: (?:[1-4] 0|2 5))?", "nc"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:[1-4] 0|2 5))?", "commons"),
    ("eupl-1.2", "(?:european union public licen[cs]e|eupl)(?: (?:version |v)?1 2)?", "public"),
    ("cecill-2", "cecill(?: (?:version |v)?2(?: [01])?)?", "cecill"),
    ("ms-pl", "(?:microsoft public license|ms pl)", "public"),
    ("bsl-1.1", "business source license(?: (?:version |v)?1 1)?", "business"),
    ("sspl-1", "(?:server side public license|sspl)", "side"),
    ("elastic-2", "elastic license(?: (?:version |v)?2(?: 0)?)?", "elastic"),
    ("openrail", "(?:bigscience )?open ?rail(?: m)?", "rail"),
]

#: How a name is put to use: name of the form, pattern around the name, own keyword, priority, score.
FORMS = [
    ("identifier", "spdx license identifier {}", "spdx", 90, 1.0),
    (
        "grant",
        "(?:licensed|released|distributed|available|provided|published|offered|covered|shared|used|redistributed) under "
        "(?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[cs]e)?",
        "under",
        70,
        0.95,
    ),
    ("subject", "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[cs]e)?", "subject", 60, 0.9),
    ("field", "licen[cs]e {}", "", 50, 0.85),
    ("name", "{} licen[cs]e", "", 40, 0.75),
]

#: Sentences of license texts and notices: label, pattern, keyword, priority, score.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby", 80, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 80, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 80, 0.9),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used", "neither", 81, 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance", 79, 0.9),
    ("gpl", "this (?:program|software|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 80, 0.95),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute", 81, 0.95),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute", 82, 0.95),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla", 82, 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 80, 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 80, 0.9),
    ("boost-1", "distributed under the boost software license", "boost", 83, 1.0),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "domain", 30, 0.7),
    ("creative-commons", "this work is licensed under a creative commons", "commons", 35, 0.7),
    ("creative-commons", "creative commons", "commons", 10, 0.4),
    ("gpl", "gnu general public license", "general", 20, 0.6),
    ("lgpl", "gnu lesser general public license", "lesser", 21, 0.6),
    ("apache", "apache (?:software )?licen[cs]e", "apache", 20, 0.5),
    ("bsd", "bsd (?:style )?licen[cs]e", "bsd", 20, 0.5),
    ("all-rights-reserved", "all rights reserved", "rights", 25, 0.6),
    ("copyright-notice", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", "copyright", 15, 0.4),
    ("proprietary", "proprietary and confidential", "proprietary", 45, 0.8),
    ("proprietary", "(?:may not be|do not) (?:copied|copy|reproduced|reproduce|redistributed|redistribute) (?:or \\w+ )?without (?:prior |express |written )*permission", "permission", 45, 0.8),
    ("non-commercial", "(?:for )?non ?commercial use only", "use", 30, 0.7),
    ("non-commercial", "for (?:personal|private|academic|research) (?:and \\w+ )?use only", "use", 29, 0.6),
]


def _texts(pattern: str) -> list[str]:
    """All texts of a name: its pattern has letters, `(?:a|b)`, `[ab]`, `[1-4]` and `?` only."""

    def either(at: int) -> tuple[list[str], int]:
        found, row = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                found, row, at = found + row, [""], at + 1
                continue
            if pattern.startswith("(?:", at):
                some, at = either(at + 3)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                inner = pattern[at + 1 : end]
                some, at = [chr(c) for c in range(ord(inner[0]), ord(inner[2]) + 1)] if inner[1:2] == "-" else list(inner), end
            else:
                some = [pattern[at]]
            at += 1
            if pattern[at : at + 1] == "?":
                some, at = [*some, ""], at + 1
            row = [a + b for a in row for b in some]
        return found + row, at

    return either(0)[0]


def _keywords(name: str, own: str) -> frozenset[bytes]:
    """Words of which every text of the name holds one: its own keyword, else the longest word of the text."""
    words = [t.split() for t in _texts(name)]
    return frozenset((own if own in w else max(w, key=len)).encode() for w in words)


def _rules() -> list[Rule]:
    def compiled(pattern: str) -> re.Pattern:
        return re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])".encode())

    rules = [
        Rule(label, f"{label}/{form}", compiled(around.format(name)), frozenset([keyword.encode()]) if keyword else _keywords(name, own), priority, score)
        for label, name, own in FAMILIES
        for form, around, keyword, priority, score in FORMS
    ]
    rules += [
        Rule(label, f"{label}/sentence", compiled(pattern), frozenset([keyword.encode()]), priority, score)
        for label, pattern, keyword, priority, score in SENTENCES
    ]
    return sorted(rules, key=lambda r: (-r.priority, r.name))


RULES = _rules()
KEYWORDS = frozenset().union(*(r.keywords for r in RULES))
#: Keywords too common to gate by themselves: such a rule also needs a word on licensing.
_ABOUT = frozenset(
    [b"license", b"licence", b"licensed", b"licenses", b"licences", b"copyright", b"permission", b"spdx", b"domain",
     b"commons", b"rights", b"proprietary", b"redistribution", b"redistribute", b"unencumbered", b"warranty", b"neither",
     b"hereby", b"compliance", b"under", b"subject", b"commercial", b"noncommercial", b"only"]
)
_BASE_WORDS = frozenset([b"mit", b"apache", b"cc"])
_GATE = KEYWORDS | _ABOUT | _BASE_WORDS

#: Bytes of words stay, A-Z lower-cased; all others become spaces.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def license_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


def _places(phrase: bytes, joined: bytes) -> Iterator[int]:
    """Starts of the phrase as whole words; `joined` begins and ends with a space."""
    wanted, at = b" " + phrase + b" ", -1
    while (at := joined.find(wanted, at + 1)) >= 0:
        yield at + 1


class Intervals:
    """Intervals taken so far; asks whether one of them holds another."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int]] = []
        self.longest = 0

    def add(self, start: int, end: int) -> None:
        insort(self.taken, (start, end))
        self.longest = max(self.longest, end - start)

    def contains(self, start: int, end: int) -> bool:
        at = bisect_right(self.taken, (start, 1 << 62)) - 1
        while at >= 0 and self.taken[at][0] >= end - self.longest:
            if self.taken[at][1] >= end:
                return True
            at -= 1
        return False


def scan(found: list[bytes]) -> list[tuple[str, str, int, int, float, bool]]:
    """Detections of one document: label, rule, first word, words, score, whether a base phrase; in order of place."""
    present = _GATE.intersection(found)
    if not present:
        return []
    joined = b" " + b" ".join(found) + b" "
    accepted, base = [], []
    if not _BASE_WORDS.isdisjoint(present):
        for phrase, label in BASE_PHRASES.items():
            base += [(start, start + len(phrase), label, "base/" + label, 1.0) for start in _places(phrase, joined)]
    if not _ABOUT.isdisjoint(present):
        hits = [
            (-rule.priority, m.start() - m.end(), m.start(), m.end(), rule)
            for rule in RULES
            if not rule.keywords.isdisjoint(present)
            for m in rule.pattern.finditer(joined)
        ]
        taken = Intervals()
        for start, end, *_ in base:
            taken.add(start, end)
        for _, _, start, end, rule in sorted(hits, key=lambda h: (h[:4], h[4].name)):
            if not taken.contains(start, end):
                taken.add(start, end)
                accepted.append((start, end, rule.label, rule.name, rule.score))
    out, word, at = [], -1, 0
    for start, end, label, name, score, of_base in sorted([*((*b, True) for b in base), *((*a, False) for a in accepted)]):
        word, at = word + joined.count(b" ", at, start), start
        out.append((label, name, word, joined.count(b" ", start, end) + 1, score, of_base))
    return out


DETECTION = "struct<label:string,rule:string,first_word:long,words:long,score:double,base:boolean>"
_DETECTION = pa.struct(
    [("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]
)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and detections (array of label, rule, first_word, words, score, base) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "rule", "first_word", "words", "score", "base"]
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                own = license_words(text.as_py())
                counts.append(len(own))
                found.append([dict(zip(names, d)) for d in scan(own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_DETECTION))],
                ["doc_id", "n_words", "detections"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, detections array<{DETECTION}>")


def op9_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and all license labels of every whole document."""
    base = F.filter("detections", lambda d: d["base"])
    return (
        scan_licenses(table(spark, sf_dir, "documents"))
        .withColumn("_base", base)
        .select(
            "doc_id",
            "n_words",
            F.size("_base").cast("long").alias("n_base"),
            F.array_min("_base.first_word").alias("first_word"),
            F.array_max("_base.first_word").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct("_base.label")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct("detections.label")), ",").alias("labels"),
            F.coalesce(F.array_max("detections.score"), F.lit(0.0)).alias("score"),
        )
    )
