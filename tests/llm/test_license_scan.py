"""License signatures: base phrases and suppression beside brute force, one statement of each form."""

import random
import re

import pytest

from ledgerlife.llm import license_scan as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    held = words(text)
    out = []
    for phrase, label in L.BASE.items():
        parts = phrase.split()
        out += [(i, i + len(parts), label) for i in range(len(held)) if held[i : i + len(parts)] == parts]
    return len(held), sorted(out)


def texts(n=300):
    rnd = random.Random(3)
    pieces = [p for phrase in L.BASE for p in phrase.split()] + ["CC", "License,", "MIT", "é", "2.0", "v2", "GNU", "general", "public", "x_y", "ß", " ", "by-nc", "cc-by-nc"]
    pieces += list(L.BASE)
    for _ in range(n):
        yield rnd.choice(["", " ", "\n"]) + "".join(rnd.choice(pieces) + rnd.choice([" ", "-", ", ", "\n// ", "  ", ":"]) for _ in range(rnd.randint(0, 30)))


def test_words_and_base_phrases_equal_brute_force():
    scanner = L.Scanner()
    rows = [None, "", " \n", "a", "MIT", "cc by nc" * 3, "CC BY NC cc by nc", "Under  the\nMIT--License " * 20_000, "\x00\x7fcc\x00by\x01nc", "Éa ÉB"]
    for text in [*rows, *texts()]:
        n, spans = scanner(text)
        assert (n, sorted((s["start"], s["end"], s["label"]) for s in spans if s["base"])) == plain_base(text)
        held = words(text)
        for s in spans:  # every span is whole words that its rule matches
            part = " ".join(held[s["start"] : s["end"]]).encode()
            assert any(r.label == s["label"] and r.kind == s["kind"] and r.pattern.fullmatch(part) for r in scanner.rules)


def test_gate_drops_no_detection():
    """Rules found without topics and keywords are the same."""
    scanner = L.Scanner()
    for text in [*STATEMENTS, *texts(60)]:
        held = L.normalised(text)
        every = {i for i, r in enumerate(scanner.rules) if r.pattern.search(held)}
        assert every <= set(scanner.gated(held)), text


def test_suppression_equals_brute_force():
    rnd = random.Random(5)
    made = [L._rule(f"l{i}", "k", rnd.choice([10, 20, 20, 30]), 0.5, "a", "a", "a", base=i == 3) for i in range(12)]
    for _ in range(400):
        found = []
        for _ in range(rnd.randint(0, 25)):
            start = rnd.randint(0, 20)
            found.append((rnd.randrange(12), start, start + rnd.randint(1, 10)))
        kept = []
        for d in sorted(found, key=lambda d: (-made[d[0]].priority, d[1] - d[2], d[1], d[0])):
            if made[d[0]].base or not any(k[1] <= d[1] and d[2] <= k[2] and not made[k[0]].base for k in kept):
                kept.append(d)
        assert sorted(L.suppressed(found, made)) == sorted(kept)


STATEMENTS = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2",
    "licensed under the GNU General Public License, version 3": "gpl-3",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl-2.1-or-later",
    "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    '"license": "ISC",': "isc",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
    "distributed under CC BY-NC-ND 4.0": "cc-by-nc,cc-by-nc-nd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Proprietary and confidential. All rights reserved.": "proprietary",
    "he went with the dog mit dem Hund under the bridge of general public interest": "",
    "the mit licenses": "",
}


def test_statements():
    scanner = L.Scanner()
    assert len(scanner.rules) > 200
    for text, want in STATEMENTS.items():
        _, spans = scanner(text)
        assert ",".join(sorted({s["label"] for s in spans})) == want, text
        assert (L.score(spans) > 0) == bool(want) and 0 <= L.score(spans) <= 1


def test_scan_handles_odd_rows(spark):
    schema = "doc_id bigint, text string, n_words int, Detections string, extra int"
    rows = [(1, None, 1, "a", 1), (2, "", 1, "a", 1), (None, "under the mit license " * 50_000, 1, "a", 1), (4, "x", 1, "a", 1), (4, "x", 1, "a", 1)]
    found = L.scan(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "text", "extra", "n_words", "detections", "score"]
    got = [(r["doc_id"], r["n_words"], sum(d["base"] for d in r["detections"]), r["score"] > 0) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 200_000, 50_000, True), (4, 1, 0, False), (4, 1, 0, False)], key=str)
    assert L.scan(spark.createDataFrame([], schema)).count() == 0
    assert found.select(L.labels().alias("l")).filter("l = 'mit'").count() == 1


@pytest.mark.parametrize("text", ["cc by " * 30_000, "gnu general public license " * 5_000, "licensed " * 50_000 + "under"])
def test_repeats_stay_cheap(text):
    L.Scanner()(text)
