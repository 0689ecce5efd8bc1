"""License scans against a plain reading of the rules."""

import re

import numpy as np

from tessera.llm import licenses
from tests.llm.test_llm import table


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    padded = " " + " ".join(words) + " "
    places = sorted(k for phrase, _ in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    base = sorted({label for phrase, label in licenses.BASE if f" {phrase} " in padded})
    found = sorted((m.start(), -m.end(), p, label, w) for p, label, k, r, w in licenses.rules() if k in padded for m in re.finditer(rf"(?<= ){r}(?= )", padded))
    kept = []
    for s, e, p, label, w in ((s, -e, p, label, w) for s, e, p, label, w in found):
        if not kept or s >= kept[-1][1]:
            kept.append((s, e, p, label, w))
        elif e > kept[-1][1] and p < kept[-1][2]:
            kept[-1] = (s, e, p, label, w)
    labels = sorted({*base, *(x[3] for x in kept)})
    score = max([0.0, *(x[4] for x in kept), *([0.9] if base else [])])
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(labels), score


PIECES = [
    "under the MIT license", "Apache License, Version 2", "cc-by-nc", "cc by nc sa 4 0", "licensed under the", "GNU General Public License, version 3", "or at your option any later version",
    "this is free and unencumbered software released into the public domain", "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved.", "the artistic license of painters", "a commercial license fee",
    "Permission is hereby granted, free of charge, to any person", "obtaining a copy", "or organization obtaining a copy", "Permission to use, copy, modify, and/or distribute this software for any purpose", "with or without fee",
    "creativecommons.org/licenses/by-nc/4.0", "distributed under the terms of the BSD 3-clause license", "subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is", "ünder", "x", "\n", "covered by the zlib license", "published by the Free Software Foundation",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as", "see the GNU General Public License for more details", "under the", "mit", "license",
]


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [None, "", "...", *(" ".join(rng.choice(PIECES, rng.integers(1, 9))) for _ in range(400)), "filler " * 5000 + PIECES[0] + " filler" * 5000]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(table(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    for k, text in enumerate(texts):
        assert got[k] == brute(text), text


def test_gates_and_keywords():
    assert all(any(g in keyword for g in licenses.GATES) for _, keyword, _, _ in licenses.TEXTS)
    assert len(licenses.rules()) > 400 and len(licenses.TEXTS) > 100


def test_suppression(spark):
    wanted = {
        "Licensed under the GNU General Public License, version 3.": "gpl-3",
        "SPDX-License-Identifier: MIT. All rights reserved": "mit,proprietary",
        "apache license version 2": "apache-2",
        "the artistic license of painters": "",
        "a commercial license fee": "",
        # The text's sentence comes before the name that overlaps its end.
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy": "boost-1",
        "licensed under the Artistic License 2.0": "artistic-2",
    }
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(table(spark, [(k, t, "s") for k, t in enumerate(wanted)])).collect()}
    assert got == dict(enumerate(wanted.values()))
