"""Phrase mining, vector codes and licence scan against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelops.llm import license_rules, license_scan, phrase_trees, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        explained = {q for p, a in frequent.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        rated = []
        for p, a in frequent.items():
            if p not in explained:
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rated)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(found)


def phrase_rows():
    pick = random.Random(3)
    words = [f"w{min(i, 9)}é" for i in range(14)] + ["The", "the", "a\x01b", "ñ"]
    rows = []
    for n in range(120):
        text = "".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(pick.choice([0, 1, 3, 40])))
        rows.append((pick.choice(["en", "fr", None, "und"]), text))
    rows += [("en", None), ("en", ""), ("en", "x y z " * 4000), *[("xx", "one two")] * 30]
    return rows


@pytest.mark.parametrize("budget, bits", [(1 << 16, 1 << 24), (20, 1 << 24), (20, 1 << 15)])
def test_phrases(spark, budget, bits):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string")
    got = phrase_trees.mine_phrases(docs, least=3, top=25, budget=budget, filter_bits=bits)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == plain_phrases(rows, 3, 25)


def test_phrase_counts_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus far larger than any test."""
    big = 3 * 10**12
    words = spark.createDataFrame([("en", "a", 2 * big), ("en", "b", 3 * big)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(phrase_trees, "word_counts", lambda docs: words)
    monkeypatch.setattr(phrase_trees, "phrase_counts", lambda *a: phrases)
    (row,) = phrase_trees.mine_phrases(spark.createDataFrame([("en", "")], "lang string, text string")).collect()
    assert (row.a, row.l, row.r, row.n, row.score) == (big, 2 * big, 3 * big, 5 * big, 166666)


def test_phrases_of_nothing(spark):
    for rows in ([], [("en", None)], [("en", "one two")]):
        assert phrase_trees.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(4096 * v) for v in vector] for _, vector, _ in rows])
    w = x.shape[1] // parts
    least = {}
    for i, vector, _ in rows:
        key = (i is None, i or 0)
        least[key] = min(least.get(key, vector), vector)
    seeds = [[math.floor(4096 * v) for v in least[key]] for key in sorted(least)[:entries]]
    books = [np.array([s[p * w : (p + 1) * w] for s in seeds]) for p in range(parts)]

    def nearest(p):
        return ((x[:, None, p * w : (p + 1) * w] - books[p][None]) ** 2).sum(2).argmin(1)

    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p)
            for e in range(len(seeds)):
                if (own == e).any():
                    books[p][e] = x[own == e, p * w : (p + 1) * w].sum(0) // (own == e).sum()
    own = [nearest(p) for p in range(parts)]
    error = sum(((x[:, p * w : (p + 1) * w] - books[p][own[p]]) ** 2).sum(1) for p in range(parts))
    by_label = Counter()
    for row, e in zip(rows, error.tolist()):
        by_label[row[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    codes = ["".join(f"{own[p][n]:02x}" for p in range(parts)) for n in range(len(rows))]
    return sorted(((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, error.tolist())), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n, spread", [(400, 1.0), (400, 0.002), (5, 1.0), (60, 100.0)])
def test_codes(spark, n, spread):
    """Ties are many where components are few integers."""
    numbers = np.random.default_rng(5)
    vectors = (numbers.normal(size=(n, 16)) * spread + numbers.integers(0, 4, size=(n, 1))).astype(np.float32).tolist()
    rows = [(i if i % 50 else None, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [rows[1], rows[1], (7, vectors[0], 1), (2, None, 0), (3, [None] * 16, 0), (4, [math.nan] * 16, 0), (5, [math.inf] * 16, 0)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS + ", code string, error int").repartition(5)
    got = vector_codes.compress(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)


def test_bounds_spare_distances():
    """Most assignments are decided by the bounds, none wrongly, and lists shrink to what is needed."""
    numbers = np.random.default_rng(9)
    x = (numbers.normal(size=(3000, 8)) * 300 + numbers.integers(0, 8, size=(3000, 1)) * 2000).astype(np.int64)
    entries = x[:16].copy()
    state, depths, spared = vector_codes.PartState.unknown(len(x), 4), None, []
    for _ in range(8):
        depths = state.assign(x, entries)
        assert (state.own == ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
        spared.append(depths[0])
        totals = np.array([[*x[state.own == e].sum(0), (state.own == e).sum()] for e in range(16)])
        was, entries = entries, vector_codes.averaged(entries[None], totals[None])[0]
        state.moved(np.sqrt(((entries - was) ** 2).sum(1)))
        state.resized(vector_codes.next_width(depths, 16))
    assert spared[0] == 0 and spared[-1] > 0.8 * len(x)
    assert vector_codes.next_width(np.array([90, 5, 0, 0, 0, 0]), 16) == 2
    assert vector_codes.next_width(np.array([10, 5, 0, 0, 0, 60]), 16) == 8


def test_codes_of_nothing_and_of_bad_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(empty).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], VECTORS))
    with pytest.raises(Exception, match="components"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1e9] * 8, 1)], VECTORS)).collect()


def plain_licenses(rows):
    rules = [(r, re.compile(f"(?:{r.pattern}) ")) for r in license_rules.RULES]
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        base = []
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            want = phrase.split()
            base += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
        found = []
        for place, (rule, pattern) in enumerate(rules):
            for i, word in enumerate(words):
                match = word == rule.anchor and pattern.match(" ".join(words[i:]) + " ")
                if match:
                    found.append((i, i + match.group().count(" "), rule.rank, place, rule.label))
        kept = [
            d
            for d in found
            if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:3] != d[:3] or e[3] < d[3]) for e in found if e != d)
        ]
        starts = [i for i, _ in base]
        ranks = [d[2] for d in kept] + [license_rules.NAME] * bool(base)
        own = {label for _, label in base}
        labels = own | {d[4] for d in kept}
        score = license_rules.WEIGHTS[min(ranks)] if ranks else 0.0
        out.append(
            (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score)
        )
    return sorted(out, key=repr)


LICENSE_TEXTS = [
    "SPDX-License-Identifier: GPL-2.0-or-later",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "GNU Lesser General Public License v2.1 or later, or the GNU General Public License, version 3 of the License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT-License; mit  license",
    "CC BY-SA 4.0 and https://creativecommons.org/licenses/by-nc/4.0/ under a Creative Commons Attribution 4.0 International License",
    "Neither the name of Example Corp nor the names of its contributors may be used to endorse",
    "commit license, apacheé license, mit license, all rights reserved",
    None,
    "",
    "under " * 700 + "mit license " * 700,
]


def test_licenses(spark, table):
    rows = [(i, t) for i, t in enumerate(LICENSE_TEXTS)] + [(1, LICENSE_TEXTS[1]), (None, LICENSE_TEXTS[0])]
    got = license_scan.license_digest(table(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_licenses(rows)
    assert license_scan.license_digest(table([])).collect() == []


def test_license_spans_and_rules(spark, table):
    (row,) = license_scan.find_licenses(table([(1, "x released under the MIT License y")])).collect()
    assert [(d.start, d.until, d.label) for d in row.detections] == [(2, 6, "mit")]
    assert [(d.start, d.until, d.label) for d in row.base] == [(4, 6, "mit")]
    assert len(license_rules.RULES) > 200 and len({r.pattern for r in license_rules.RULES}) == len(license_rules.RULES)
    for rule in license_rules.RULES:
        widest = len(rule.pattern.split(" ")) + sum(int(n) for n in re.findall(r"\{\d+,(\d+)\}", rule.pattern))
        assert widest <= license_rules.WIDTH
        # Neither the keyword nor the anchor may be optional.
        sure = rule.pattern
        while re.search(r"\([^()]*\)", sure):
            sure = re.sub(r"\([^()]*\)(\?|\{[^}]*\})?", "", sure)
        assert {"licen[cs]e" if rule.keyword == "licen" else rule.keyword, rule.anchor} <= set(sure.split(" "))
