"""Linking of buckets against a comparison of all pairs, and how many turns it takes."""

import random

import pytest
from pyspark.sql import functions as F

from chronoview.llm import common, minhash, near

THRESHOLD = 0.8


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute(members, sets):
    """Roots of all ids that pairs of one bucket join."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for bucket, i in members:
        by.setdefault(bucket, []).append(i)
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and jaccard(sets[a], sets[b]) >= THRESHOLD:
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    found = {i: top(i) for i in root}
    return {i: r for i, r in found.items() if sum(v == r for v in found.values()) > 1}


def linked(spark, monkeypatch, members, sets):
    """(id -> root) by ``link``, pairs compared and turns."""
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, h array<bigint>").cache()
    counts = {"pairs": 0, "turns": 0}

    def compare(pairs):
        counts["pairs"] += pairs.count()
        both = pairs.join(table.select(F.col("id").alias("a"), F.col("h").alias("x")), "a").join(table.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")
        n = F.size(F.array_intersect("x", "y"))
        return both.where(n >= THRESHOLD * (F.size("x") + F.size("y") - n)).select("a", "b")

    leaders = near._leaders

    def counted(rest, more):
        counts["turns"] += 1
        return leaders(rest, more)

    monkeypatch.setattr(near, "_leaders", counted)
    out = near.link(spark.createDataFrame(members, "bucket bigint, id bigint"), compare, lambda ids: table.join(ids, "id", "left_semi"), THRESHOLD)
    got = {r["id"]: r["root"] for r in out.collect()}
    table.unpersist()
    return got, counts


def varied(rng, base, drop, add, universe=10**6):
    kept = {x for x in base if rng.random() >= drop}
    return kept | {rng.randrange(universe) for _ in range(int(add * len(base)))}


def families(rng):
    """Trees of near copies at all distances from their first, templates with unlike ends, and strangers."""
    sets = []
    for _ in range(3):
        first = {rng.randrange(10**6) for _ in range(rng.choice([20, 60, 120]))}
        own = [first]
        for _ in range(40):
            own.append(varied(rng, rng.choice(own), rng.choice([0.0, 0.03, 0.08]), rng.choice([0.0, 0.05, 0.1])))
        sets += own
    shared = set(range(40))
    sets += [shared | {rng.randrange(10**6) for _ in range(rng.choice([5, 12, 40]))} for _ in range(40)]
    variants = [{10**7 + 100 * v + i for i in range(12)} for v in range(3)]
    sets += [shared | rng.choice(variants) | {rng.randrange(10**6) for _ in range(6)} for _ in range(60)]
    return sets + [{rng.randrange(300) for _ in range(20)} for _ in range(60)]


@pytest.mark.parametrize("seed, small, turns, more", [(1, 32, 0, 0), (2, 3, 1, 3)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, small, turns, more):
    """Whether buckets are cut at once or after a turn."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "TURNS", turns)
    monkeypatch.setattr(near, "LEADERS", more)
    rng = random.Random(seed)
    sets = {3 * i: s for i, s in enumerate(families(rng))}
    members = [(7, i) for i in sets] + [(8, i) for i in sets if rng.random() < 0.3] + [(100 + i, i) for i in sets]
    got, _ = linked(spark, monkeypatch, members, sets)
    assert got == brute(members, sets)


def test_turns_do_not_grow_with_unlike_rows(spark, monkeypatch):
    """Rows of one bucket, all about 0.1 alike: ten times the rows take a turn or two more, and few pairs."""
    monkeypatch.setattr(near, "TURNS", 2)
    turns = {}
    for n in (200, 2000):
        rng = random.Random(n)
        sets = {i: set(rng.sample(range(220), 40)) for i in range(n)}
        got, counts = linked(spark, monkeypatch, [(1, i) for i in sets], sets)
        assert got == {}, counts
        assert n < 1000 or counts["pairs"] < n * (n - 1) / 2, counts
        turns[n] = counts["turns"]
    assert turns[2000] <= near.TURNS + 4


def test_no_rows_and_lone_rows(spark, monkeypatch):
    assert linked(spark, monkeypatch, [], {1: {1}})[0] == {}
    assert linked(spark, monkeypatch, [(1, 1), (2, 2)], {1: {1}, 2: {1}})[0] == {}


def shuffled(spark):
    """Bytes that this session has written for shuffles."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_few_pairs_do_not_move_all_sets(spark, tmp_path):
    """Comparing three pairs of 40,000 sets shuffles the sets of these, not the table."""
    spark.range(40_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.xxhash64("id", i)).alias("h")).write.parquet(f"{tmp_path}/sets")
    spark.createDataFrame([(1, 2), (5, 9), (7, 7)], "a bigint, b bigint").write.parquet(f"{tmp_path}/pairs")
    sets, pairs = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("sets", "pairs"))
    before = shuffled(spark)
    assert [tuple(r) for r in minhash.similar(pairs, sets, THRESHOLD).collect()] == [(7, 7)]
    assert shuffled(spark) - before < 1_000_000


def test_pairs_of_one_class_are_not_made(spark):
    """Rows that share scarce elements are pairs only if they are in different classes."""
    rows = [(1, 5, i, i % 2) for i in range(6)]
    got = near._pairs(spark.createDataFrame(rows, "g bigint, h bigint, id bigint, root bigint")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(6) for b in range(a + 1, 6) if (b - a) % 2]


def test_unlike_rows_of_a_bucket_are_no_pairs(spark, monkeypatch):
    """400 rows about 0.6 alike and 100 near copies: beside leaders, comparisons are those of rows that may be similar, once each,
    though every row is in three buckets, and no turn but the second is needed."""
    rng = random.Random(5)
    shared, first = set(range(300)), {rng.randrange(10**6) for _ in range(400)}
    sets = {i: shared | {rng.randrange(10**6) for _ in range(100)} for i in range(400)}
    sets |= {i: varied(rng, first, 0.08, 0.08) for i in range(400, 500)}
    members = [(bucket, i) for bucket in (1, 2, 3) for i in sets]
    got, counts = linked(spark, monkeypatch, members, sets)
    assert got == brute(members[: len(sets)], sets)
    alike = sum(jaccard(sets[a], sets[b]) >= 0.75 for a in sets for b in sets if a < b)
    assert counts["pairs"] <= len(sets) + alike and counts["turns"] == 1, counts


def test_parity_bits_differ_in_no_more_places_than_sets(spark):
    rng = random.Random(6)
    first = {rng.randrange(10**6) for _ in range(400)}
    sets = [varied(rng, first, rng.random() * 0.4, rng.random() * 0.4) for _ in range(30)] + [{7}, {rng.randrange(10**6) for _ in range(5000)}]
    rows = near._parities(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, h array<bigint>")).collect()
    bits = {r["id"]: [r[f"p{j}"] & (1 << 64) - 1 for j in range(near.BITS // 64)] for r in rows}
    assert {r["id"]: r["n"] for r in rows} == {i: len(s) for i, s in enumerate(sets)}
    for a, x in bits.items():
        for b, y in bits.items():
            n, most = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)), len(sets[a] ^ sets[b])
            assert n <= most and (n - most) % 2 == 0 and (most > 200 or n >= 0.8 * most)


@pytest.mark.parametrize("wanted", [100, 1_500_000])
def test_filter_lets_few_others_through_however_many_are_wanted(spark, tmp_path, wanted):
    """All wanted rows pass; of others fewer than a tenth, for ids as well, which are dense in their lower bits (before: a bitmap
    of fixed size let 16 % through for 1,500,000 hashed keys)."""
    for name, key in (("hashed", F.xxhash64("id")), ("ids", F.col("id") * 2 + F.shiftleft(F.col("id") % 40, 33))):
        spark.range(wanted).select(key.alias("id")).write.parquet(f"{tmp_path}/{name}")
        keys = spark.read.parquet(f"{tmp_path}/{name}")
        other = spark.range(200_000).select(F.col("id"), F.lit(0).alias("own"), (F.col("id") * 2 + 1 + F.shiftleft(F.col("id") % 50, 33)).alias("key"))
        rows = other.unionByName(keys.sample(0.1, 1).select(F.lit(0).cast("bigint").alias("id"), F.lit(1).alias("own"), F.col("id").alias("key")))
        passed = common.maybe(rows.select("own", "key"), keys.select(F.col("id").alias("key")), "key").groupBy("own").count()
        got, all_own = {r["own"]: r["count"] for r in passed.collect()}, rows.where("own = 1").count()
        assert got.get(1, 0) == all_own and got.get(0, 0) < 20_000, (name, got, all_own)
