"""Top-1 similarity links against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from chronoview.operators import linking


def brute(left, right):
    out = {}
    for block, i, x in left:
        x = {w for w in x or [] if w is not None}
        scores = []
        for other, j, y in right:
            y = {w for w in y or [] if w is not None}
            if block is not None and block == other and x & y:
                scores.append((len(x & y) / len(x | y), j))
        best = max(scores, default=(0, None))
        if best[0] and sum(s == best[0] for s, _ in scores) == 1:
            out[i] = (best[1], best[0])
    return out


def texts(rng, n, start, words, copies=()):
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 20, 60])
        own = [words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(size)]
        if copies and rng.random() < 0.5:
            own = rng.choice(copies)[2] or []
            own = [w for w in own if rng.random() < rng.choice([0.5, 0.9, 1.0])] + own[:1]
        out.append((rng.choice(["s1", "s1", "s2", None]), start + i, rng.choice([own, own, own, [*own, None], None])))
    return out


@pytest.mark.parametrize("seed, seeds, tried", [(1, 6, 4), (2, 1, 1), (3, 0, 1)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, seeds, tried):
    """Whatever bounds the first candidates give, also none at all."""
    monkeypatch.setattr(linking, "SEEDS", seeds)
    monkeypatch.setattr(linking, "TRIED", tried)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    right = texts(rng, 150, 1000, words)
    left = texts(rng, 120, 0, words, right)
    of = lambda rows, name: spark.createDataFrame(rows, f"subject string, {name} int, tokens array<string>").withColumn("n", F.lit("own")).repartition(3)
    got = {r["l_id"]: (r["r_id"], r["score"]) for r in linking.link_reports(of(left, "l_id"), of(right, "r_id"), "l_id", "r_id", ["subject"]).collect()}
    assert got == brute(left, right) and len(got) > 40


def test_frequent_words_are_left_out_of_the_join(spark):
    """Texts with a good match send no word that most texts have into the join."""
    common = [f"c{i}" for i in range(10)]
    right = spark.createDataFrame([(i, common + [f"r{i}_{k}" for k in range(10)]) for i in range(200)], "id int, tokens array<string>")
    sets = linking._sets(right, "id", ())
    frequency = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    ordered = linking._ordered(sets, frequency, ()).cache()
    bounds = ordered.select(F.col("id").alias("l"), F.lit(0.6).alias("bound"))
    assert linking.candidates(ordered, ordered, bounds, ()).where("l <> r").count() == 0
    assert linking.candidates(ordered, ordered, bounds, ()).count() == 200
    ordered.unpersist()


def test_reports_begin_after_their_marker(spark):
    texts = ["head one FINAL  report", "Wet read: x. Final Report\r\nLungs Clear, clear. FINAL REPORT twice", "Größe 12 mm", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.w for r in df.select(linking.report_tokens(F.col("text")).alias("w")).collect()]
    assert got == [["head", "one", "final", "report"], ["lungs", "clear", "final", "report", "twice"], ["größe", "12", "mm"], [], []]


def test_no_texts_no_links(spark):
    none = spark.createDataFrame([], "id int, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    for left, right in ((none, some), (some, none)):
        assert linking.link_reports(left.withColumnRenamed("id", "a"), right.withColumnRenamed("id", "b"), "a", "b").count() == 0


def test_words_that_no_left_text_has_are_not_written(spark, monkeypatch):
    kept, write = {}, linking.written

    def written(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(linking, "written", written)
    left = spark.createDataFrame([(1, ["a", "b", "z"])], "l int, tokens array<string>")
    right = spark.createDataFrame([(7, ["a", "b", "x1", "x2", "x3"]), (8, ["a", "b", "x4"]), (9, ["x5"])], "r int, tokens array<string>")
    assert [tuple(r) for r in linking.link_reports(left, right, "l", "r").collect()] == [(1, 8, 0.5)]
    assert {w for r in kept["link-right"].collect() for w in r.words} == {"a", "b"}
