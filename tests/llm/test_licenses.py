"""License scans: base phrases against a plain search, rules against their own gates, suppression pair by pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chronoview.llm import licenses
from chronoview.llm.license_rules import BASE, KINDS, rules
from chronoview.llm.licenses import Detection, Scanner, resolve

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def base_places(text):
    words = words_of(text)
    found = []
    for phrase, label in BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), found


def invented(seed, n):
    rng = random.Random(seed)
    parts = ["GNU General Public License", "gnu general", "public license", "Apache License", "Apache License, Version 2.0", "MIT-License", "mit", "CC BY", "CC-BY-SA 4.0", "licensed under", "released under the", "SPDX-License-Identifier:", "Apache-2.0", "all rights reserved", "été", "wörd", "x", "version 3", "license"]
    seps = [" ", ", ", "\n", " - ", "\x00", " ", ""]
    return ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_phrases_equal_a_plain_search(spark):
    texts = [*invented(1, 300), "", None, "cc by cc by", "İ MIT LICENSE é", "mit license" + " mit license" * 5000, "no break" + " mit license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "MIT License"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Score", F.lit("own")).withColumn("labels", F.lit(1)).repartition(3)
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, found = base_places(r.text)
        base = {label for _, label in found}
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == (min((i for i, _ in found), default=None), max((i for i, _ in found), default=None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | {""} - {""}
        assert r.labels == ",".join(sorted(base | {d.label for d in r.detections})) and 0 <= r.score <= 1
    assert licenses.scan(docs.where("false")).count() == 0


def test_detections_equal_every_rule_tried_alone():
    scanner = Scanner()
    for text in invented(2, 150):
        joined = " ".join(words_of(text))
        expected = set()
        for i, r in enumerate(scanner.rules):
            if all(f" {k}" in f" {joined} " for k in r.keywords):
                for m in r.compiled().finditer(joined):
                    end = m.end() if r.kind != "base" else m.start() + len(r.pattern)
                    expected.add((joined.count(" ", 0, m.start()), joined.count(" ", 0, end) + 1, i))
        assert {d[:3] for d in scanner.matches(licenses.words_of(text))} == expected


def test_suppression_equals_a_comparison_of_all_pairs():
    rng = random.Random(4)
    priority = [i % len(KINDS) for i in range(21)]
    for _ in range(200):
        found = list({Detection(a := rng.randint(0, 12), a + rng.randint(1, 6), rng.randrange(21), "x") for _ in range(rng.randint(0, 12))})

        def beats(k, d):
            inside = k.first <= d.first and k.end >= d.end
            same = (k.first, k.end) == (d.first, d.end)
            return k is not d and inside and (priority[k.rule] < priority[d.rule] or priority[k.rule] == priority[d.rule] and (not same or k.rule < d.rule))

        assert set(resolve(found, priority)) == {d for d in found if not any(beats(k, d) for k in found)}


@pytest.mark.parametrize(
    "text, label, kind",
    [
        ("Released under the MIT License.", "mit", "grant"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", "grant"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", "grant"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", "grant"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0", "tag"),
        ("https://www.gnu.org/licenses/lgpl-3.0.html", "lgpl-3.0", "link"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit", "sentence"),
        ("the GNU Lesser General Public License v2.1", "lgpl-2.1", "title"),
        ("a BSD-style license", "bsd", "mention"),
    ],
)
def test_known_texts(text, label, kind):
    scanner = Scanner()
    kept = scanner.scan(text)[2]
    assert (label, kind) in {(d.label, scanner.rules[d.rule].kind) for d in kept}
    assert len(kept) == 1  # what it contains says nothing more


def test_rules_are_ordered_unlike_and_can_be_gated():
    every = rules()
    assert len(every) > 500 and [r.priority for r in every] == sorted(r.priority for r in every)
    assert all(r.keywords and all(len(k) > 1 for k in r.keywords) for r in every)
    assert len({(r.label, r.kind, r.pattern) for r in every}) == len(every)


def test_plain_prose_has_no_license():
    assert Scanner().scan("Wir gehen mit dem Hund unter der Brücke. The committee is covered by an agreement.")[2] == []
