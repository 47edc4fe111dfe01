import re

from plumbline.llm import licenses
from plumbline.llm.licenses import RULES, license_words, scan, scan_licenses

TEXTS = [
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "cc by nc cc by nc\nCC-BY-NC",
    "All rights reserved. Nothing else",
    "We submit licenses",
    "SPDX-License-Identifier: MPL-2.0",
    "",
    None,
    "no such thing " * 30_000 + "under the mit license",
]


def base(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    places = [
        (i, label)
        for phrase, label in phrases
        for i in range(len(found))
        if found[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(found), sorted(places)


def test_base_phrases_agree_with_word_by_word_search():
    for text in TEXTS:
        n, places = base(text)
        found = license_words(text)
        assert len(found) == n
        assert [(w, label) for label, _, w, _, _, of_base in scan(found) if of_base] == places


def test_labels_and_suppression():
    labels = [sorted({d[0] for d in scan(license_words(t))}) for t in TEXTS]
    assert labels[0] == ["apache-2", "mit"]
    assert labels[1] == ["gpl-3"]
    assert labels[2] == ["cc-by-nc"]
    assert labels[4] == ["all-rights-reserved"]
    assert labels[5] == []
    assert labels[6] == ["mpl-2"]
    assert len(RULES) > 250


def test_every_alternative_runs_with_and_without_the_gate():
    rules = {(r.name, r.pattern.pattern): r for r in RULES}
    uses = {"identifier": "spdx license identifier {}", "grant": "licensed under {}", "subject": "subject to {}", "field": "license {}", "name": "{} license"}
    for label, name, _ in licenses.FAMILIES:
        texts = licenses._texts(name)
        assert len(set(texts)) == len(texts) and all(re.fullmatch(name, t) for t in texts)
        for form, around, *_ in licenses.FORMS:
            rule = rules[f"{label}/{form}", f"(?<![^ ])(?:{around.format(name)})(?![^ ])".encode()]
            for text in texts:
                words = license_words(uses[form].format(text))
                assert rule.pattern.search(b" " + b" ".join(words) + b" ")  # without the gate
                assert not rule.keywords.isdisjoint(words) and rule.keywords <= licenses._GATE, (rule.name, text)
                assert scan(words), (rule.name, text)
    short = {
        "License: CDDL 1.0": "cddl-1", "ODbL license": "odbl-1", "SSPL License": "sspl-1", "EUPL 1.2 license": "eupl-1.2", "MS-PL license": "ms-pl",
        "GFDL license": "gfdl-1.3", "License: PSF": "python-2", "OpenRAIL license": "openrail", "0BSD license": "0bsd", "FreeBSD license": "bsd-2-clause",
        "CC Zero license": "cc0-1", "License: MPL 1.1": "mpl-1.1", "creative commons attribution license": "cc-by",
    }
    assert {text: label in {d[0] for d in scan(license_words(text))} for text, label in short.items()} == dict.fromkeys(short, True)


def test_many_detections_in_one_text():
    found = license_words("licensed under the isc license and " * 5_000)
    assert len(scan(found)) == 5_000


def test_query_shape(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(1, TEXTS[0], "x"), (1, TEXTS[0], "x"), (None, None, None)], "doc_id long, text string, detections string")
    monkeypatch.setattr(licenses, "table", lambda *_: docs)
    rows = licenses.op9_license_labels(spark, sf_dir).collect()
    assert [r.n_base for r in rows] == [2, 2, 0] and rows[0] == rows[1]
    assert rows[2].first_word is None and rows[2].labels == "" and rows[2].score == 0.0 and rows[2].n_words == 0
    assert scan_licenses(docs.limit(0)).count() == 0
