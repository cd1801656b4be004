"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoview.llm import phrases


def brute(rows, least=30, top=2000):
    counts, words_of = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    found = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, p), a in found.items():
        if len(p) == 1:
            continue
        longer = [n for (other, q), n in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        score, _, left, right = min((2000000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, words_of[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "é", "A", "a", "river", "bank", "x y", "1", "very", "long", "name", "\x00", "日本"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([t, t + "New York Stock Exchange is open", "", None])))
    return out


def test_phrases_equal_brute_force(spark):
    rows = texts(1, 400)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit("own")).repartition(5)
    for least, top in ((30, 2000), (3, 7)):
        got = sorted(tuple(r) for r in phrases.mine(docs, least, top).collect())
        assert got == brute(rows, least, top) and got


def test_repeats_overlap_and_long_pieces(spark, monkeypatch):
    """Copies count each; ``a a a`` holds two ``a a``; texts are cut only where a piece ends."""
    monkeypatch.setattr(phrases, "BLOCK", 50)
    rows = [("en", "a a a a b")] * 40 + [("en", "one two " * 60 + ". three four"), ("en", "x" * 500 + " y. " + "one two. " * 40)]
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "lang string, text string")).collect())
    assert got == brute(rows)


def test_small_buffers_and_a_full_sieve(spark, monkeypatch):
    """A bitmap that lets everything pass costs time and changes nothing."""
    rows = texts(2, 200)
    monkeypatch.setattr(phrases, "WORDS", 64)
    docs = spark.createDataFrame(rows, "lang string, text string")
    expected = brute(rows, 5)
    assert sorted(tuple(r) for r in phrases.mine(docs, 5).collect()) == expected
    monkeypatch.setattr(phrases, "_bitmap", lambda slots: spark.sparkContext.broadcast(phrases.np.full(phrases.BITS // 8, 255, phrases.np.uint8)))
    assert sorted(tuple(r) for r in phrases.mine(docs, 5).collect()) == expected


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, " \t. ")]])
def test_no_words_no_phrases(spark, rows):
    assert phrases.mine(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_past_64_bits(spark):
    big = 1 << 62
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)], "lang string, m int, phrase string, f bigint")
    assert phrases.scored(found).first().score == 2000000 * (big - 1) // (2 * big + 1)
