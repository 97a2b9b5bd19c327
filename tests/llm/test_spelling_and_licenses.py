"""Spelling variants and the license scan against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from domquarry.llm import licenses, spelling

TEXTS = "doc_id long, text string"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _word_counts(rows):
    out = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def _edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def _variants(rows):
    n = _word_counts(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and _edits(w, x) == 1] for w in n}

    def form(w):
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        return best if best and n[best] >= 10 * n[w] else None

    out = set()
    for w in n:
        root = w
        while form(root):
            root = form(root)
        out.add((w, n[w], len(near[w]), form(w), n[form(w)] if form(w) else None, root))
    return out


def _run(frame):
    return {tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def _corpus():
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("aeint\u00e9\u00d7"), rng.integers(6, 11))) for _ in range(40)]
    words = list(stems)
    for w in stems:  # variants by one and two edits, and anagrams
        k = int(rng.integers(len(w)))
        words += [w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "o" + w[k + 1:], w[::-1], w[1:] + w[0]]
    rows = [(d, " ".join(rng.choice(words, 60)) + ".") for d in range(40)]
    return rows + [(100 + d, f"{stems[0]} " * 30 + f"{stems[0]}s " * 2 + f"{stems[0].upper()}sx") for d in range(12)]


def test_variants_equal_brute_force(spark, monkeypatch):
    rows = _corpus() + [(None, "wonderful wonderful"), (7, None), (8, ""), (9, "a " * 5000 + "wonderfull " * 3), (9, "wonderfull")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS + ", word string, n long")
    assert _run(spelling.variants(docs)) == _variants(rows)
    # small tiles: many letters in the keys, many parts to a key
    monkeypatch.setattr(spelling, "TILE", 3)
    assert len(spelling.key_letters(spelling.word_counts(docs))) >= 2
    assert _run(spelling.variants(docs)) == _variants(rows)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    rows = [(d, f"{long} {long[:-1]} ") for d in range(3)]
    rows += [(50 + d, "straightt " * 2 + "straighttt " * 40 + "straightttt " * 900) for d in range(2)]
    docs = spark.createDataFrame(rows, TEXTS)
    got = _run(spelling.variants(docs))
    assert got == _variants(rows)
    assert ("straightt", "straightttt") in {(g[0], g[5]) for g in got}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "short one")]):
        assert _run(spelling.variants(spark.createDataFrame(rows, TEXTS))) == set()


def test_every_edit_is_a_step():
    rng = np.random.default_rng(3)
    listed = {tuple(s) for s in spelling.steps(3)}
    both = listed | {tuple(-x for x in s) for s in listed}
    for _ in range(2000):
        w = list(rng.choice(list("abcd"), 7))
        v, k = list(w), int(rng.integers(7))
        kind = rng.integers(3)
        if kind == 0:
            v[k] = str(rng.choice(list("abcd")))
        elif kind == 1:
            del v[k]
        else:
            v.insert(k, str(rng.choice(list("abcd"))))
        key = [len(v) - len(w), *(v.count(c) - w.count(c) for c in "abc")]
        assert tuple(key) in both
    assert all(tuple(-x for x in s) not in listed for s in listed if any(s))


# Licenses

def _naive(text):
    """All rules on the whole text without prefilter, suppression by looking at every pair."""
    low = _lower(text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = (" " + " ".join(words) + " ").encode()
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    found = []
    for k, (label, _, priority, confidence, pattern) in enumerate(licenses.rules()):
        for m in pattern.finditer(joined):
            start = joined[:m.start()].count(b" ") - 1
            found.append((priority, -len(m.group().split()), start, k, label, confidence))
    kept = []
    for _, less, start, _, label, confidence in sorted(found):
        if not any(s <= start and start - less <= s + n for s, n, _, _ in kept):
            kept.append((start, -less, label, confidence))
    labels = {x for _, x in base} | {x[2] for x in kept}
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), max([x[3] for x in kept] + [0.5] * bool(base), default=0.0))


SAYINGS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All Rights Reserved", "CC BY cc by",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "http://creativecommons.org/licenses/by-sa/4.0/", "Creative Commons Attribution 4.0 International", "CC-BY-NC-SA 4.0",
    "GNU Lesser General Public License v2.1", "BSD 3-Clause License", "Copyright (c) 2021 Somebody", "\u00a9 2020", "mit", "license",
    "the general public", "rights reserved", "redistribution and use in source and binary forms, with or without modification, are permitted",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "released into the public domain",
    "Tous droits r\u00e9serv\u00e9s", "or any later version", "word", "\u4e2d\u6587", "MPL 2.0", "see the license file for", "under the terms of the",
]


def test_scan_equals_all_rules_without_prefilter(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(SAYINGS, rng.integers(1, 9))) for _ in range(400)]
    texts += SAYINGS + [None, "", " \n", "x " * 30000 + "all rights reserved " * 3000]
    rows = [(i if i % 9 else None, t, "extra") for i, t in enumerate(texts)]
    frame = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string"))
    got = Counter(tuple(r) for r in frame.drop("spans").collect())
    want = Counter((d, *_naive(t)) for d, t, _ in rows)
    assert got == want
    assert licenses.scanned(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
    ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"),
    ("is licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("the licensed driver met a general in public", ""),
])
def test_labels(text, labels):
    assert licenses.Scanner().scan(text.encode())[5] == labels


def test_rules_match_only_where_a_keyword_stands():
    rules = licenses.rules()
    assert len(rules) > 200 and len({(r[0], r[4].pattern) for r in rules}) == len(rules)
    assert all(r[1] and all(r[1]) for r in rules)
