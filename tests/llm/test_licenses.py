"""License scans: against all rules tried everywhere, and phrases found word by word."""

import random
import re

import pytest

from pricelake.llm import licenses as L

DOCS = "doc_id long, text string, id string, n_words int, labels string, score string"

LINES = [
    "Released under the MIT License.", "Licensed under the Apache License,\n# Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)", "http://www.apache.org/licenses/LICENSE-2.0", "under the mit license under the mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "Apache License, Version 1.1",
    "GNU Lesser General Public License v2.1", "the zlib license", "Mozilla Public License, v. 2.0", "MPL 2.0", "beerware license", "Beer-Ware License",
    "Creative Commons Attribution-ShareAlike 3.0", "CC-BY-SA 3.0", "cc0", "All rights reserved.", "Copyright (c) 2014 Nobody", "open rail m license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/", "see the LICENSE file for details", "mit", "the license", "licence", "Apache", "version 2",
    "GPLv3", "Llama 2 Community License Agreement", "eupl 1.2", "licensed under the terms of the BSD license", "Python Software Foundation License 2",
]


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_scan(text, rules):
    """Every rule at every place, intervals compared in pairs; phrases by their words."""
    words = words_of(text)
    places = [(i, label) for phrase, label in L.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    joined = " " + "".join(w + " " for w in words)
    found = [(m.start(), m.end(), r.rank, k) for k, r in enumerate(rules) for m in r.pattern.finditer(joined)]
    covers = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and (a[2] < b[2] or a[2] == b[2] and ((a[0], a[1]) != (b[0], b[1]) or a[3] < b[3]))
    kept = [m for m in found if not any(covers(o, m) for o in found)]
    starts = [i for i, _ in places]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(rules[k].label for *_, k in kept)})
    score = max([L.KINDS[rules[k].kind] for *_, k in kept] + [0.95] * bool(base), default=0.0)
    spans = sorted((rules[k].label, rules[k].kind, joined[:s].count(" ") - 1, joined[s:e].count(" ") + 1) for s, e, _, k in kept)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


@pytest.fixture(scope="module")
def rules():
    return L.build_rules()


def check(spark, rules, texts):
    df = L.scan(spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in enumerate(texts)], DOCS))
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    got = {r.doc_id: (*r[1:8], sorted(map(tuple, r.spans))) for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_scan(t, rules), t


def test_scan_of_mixed_texts(spark, rules):
    rnd = random.Random(3)
    filler = "the of and Ères été für und 日本 x1 2 0 3 mit license version".split()
    texts = []
    for _ in range(150):
        parts = [rnd.choice(LINES) if rnd.random() < 0.4 else " ".join(rnd.choices(filler, k=rnd.randrange(12))) for _ in range(rnd.randrange(6))]
        texts.append(rnd.choice([" ", "\n", "\n// ", " * "]).join(parts))
    check(spark, rules, texts + LINES)


def test_scan_of_odd_texts(spark, rules):
    long = "word " * 400_000 + "under the MIT license" + " tail" * 10
    check(spark, rules, [None, "", " .,;\n", "É", "under the mit licenseé", "\x00mit\x7f", long, "under the mit license", "under the mit license"])
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_longer_and_higher_matches_stay(rules):
    scanner = L.Scanner()
    labels = lambda text: L.scan_text(scanner, " " + " ".join(words_of(text)) + " ")[4]
    assert labels("GNU General Public License version 3") == "gpl-3.0"
    assert labels("GNU Lesser General Public License") == "lgpl"
    assert labels("CC BY-NC-SA 4.0") == "cc-by-nc,cc-by-nc-sa-4.0"
    assert labels("The Apache License, Version 2.0") == "apache-2,apache-2.0"
    assert labels("MIT license; BSD license") == "bsd,mit"


def test_hundreds_of_rules_with_keywords(rules):
    assert len(rules) > 300 and [r.rank for r in rules] == sorted(r.rank for r in rules)
    assert sum(bool(r.keywords) for r in rules) > 250
