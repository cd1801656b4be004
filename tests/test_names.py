"""Names in texts and fuzzy lists against comparisons of all pairs; balanced bins against the deal in turns."""

import heapq
import random
import re
import time

import numpy as np
import pytest

from chronoview.operators import balance, fuzzy, names


def norm(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower()


def vocabulary(rng, n):
    parts = ["acute", "pain", "of", "left", "knee", "é", "x", "heart failure", "CT", "ab"]
    return [(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", " ", ""]), i) for i in range(n)] + [("", n), ("  ", n + 1), ("PAIN", n + 2)]


def aligned(pred, words):
    t = norm(pred)
    by = [(norm(w), p, w) for w, p in words if norm(w)]
    for test in (lambda o: o == t, lambda o: o in t or t in o):
        found = min(((p, w) for o, p, w in by if t and test(o)), default=None)
        if found:
            return found[1]
    return pred


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = vocabulary(rng, 60)
    preds = [rng.choice(["", "the ", "Acute  "]) + rng.choice(words)[0][rng.choice([0, 0, 3]) :] + rng.choice(["", " of knee", "\n"]) for _ in range(150)] + ["", " ", "a", "zzz", "unknown thing"]
    said = spark.createDataFrame([(i // 5, i, p) for i, p in enumerate(preds)] + [(999, 999, None)], "q int, i int, name string").repartition(3)
    vocab = spark.createDataFrame(words, "official string, p int")
    got = {r["i"]: r["aligned"] for r in names.align_to_official(said, "name", vocab, "official", "p").collect()}
    assert got.pop(999) is None and got == {i: aligned(p, words) for i, p in enumerate(preds)}
    lists = {r["q"]: r["aligned"] for r in names.align_lists(said, ["q"], "name", "i", vocab, "official", "p").collect()}
    for q in range(len(preds) // 5):
        want, seen = [], set()
        for p in preds[5 * q : 5 * q + 5]:
            if norm(p) and norm(aligned(p, words)) not in seen:
                seen.add(norm(aligned(p, words)))
                want.append(aligned(p, words))
        assert lists.get(q, []) == want


def test_mentions_equal_all_pairs(spark):
    rng = random.Random(3)
    words = vocabulary(rng, 40)
    texts = [(i, " ".join(rng.choice(words)[0] + rng.choice(["", ",", "\n"]) for _ in range(rng.randint(0, 8)))) for i in range(60)] + [(100, None), (101, "")]
    got = names.mentions(spark.createDataFrame(texts, "k int, text string"), "k", "text", spark.createDataFrame(words, "official string, p int"), "official", "p").collect()
    first = {}
    for w, p in words:
        if norm(w):
            first.setdefault(norm(w), (p, w))
    want = set()
    for k, text in texts:
        found = sorted((norm(text or "").index(o), p, w) for o, (p, w) in first.items() if o in norm(text or ""))
        want |= {(k, w, at + 1, i) for i, (at, _, w) in enumerate(found, 1)}
    assert {tuple(r) for r in got} == want and want


def test_long_texts_take_linear_time(spark):
    """Random letters have as many groups as places; rows of groups that carried their text would be gigabytes."""
    rng = random.Random(6)
    texts = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäö ", k=150_000)) + "|needle  in hay|") for k in (1, 1, 2)]
    vocab = spark.createDataFrame([("Needle in Hay", 1), ("ne", 2), ("absent needle", 3)], "official string, p int")
    began = time.time()
    got = sorted(tuple(r) for r in names.mentions(spark.createDataFrame(texts, "k int, text string"), "k", "text", vocab, "official", "p").collect() if r.name != "ne")
    assert time.time() - began < 60
    assert {r[:3] for r in got} == {(k, "Needle in Hay", norm(t).index("needle in hay") + 1) for k, t in texts}


def test_a_hundred_thousand_names(spark):
    vocab = spark.range(100_000).selectExpr("concat('disorder ', id, ' of organ ', id % 97) AS name", "id AS p")
    said = spark.range(0, 100_000, 50).selectExpr("id", "concat('a disorder ', id, ' of organ ', id % 97, ' seen') AS said")
    out = names.align_to_official(said, "said", vocab, "name", "p")
    assert out.where("aligned <> concat('disorder ', id, ' of organ ', id % 97)").count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(row[j - 1], before[j])
    return row[-1]


def test_fuzzy_lists_of_more_than_a_thousand_keywords(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "ENTRIES", 50)
    monkeypatch.setattr(fuzzy, "SIDE", 100)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 9)))
    vocab = sorted({word() for _ in range(120)} | {"Red Widget", "red widget"})
    asked = sorted({word() for _ in range(2600)} | {"RED WIDGES"})
    got = fuzzy.fuzzy_top_k(spark.createDataFrame([(v,) for v in [*vocab, vocab[0], None]], "candidate string"), spark.createDataFrame([(a,) for a in asked], "keyword string"), 3).collect()
    found = {(r["keyword"], r["rank"]): (r["candidate"], r["score"]) for r in got}
    assert len(asked) > 1000 and len(found) == 3 * len(asked)
    for a in rng.sample(asked, 60):
        scores = sorted((-fuzzy.ratio(lcs(a.lower(), v.lower()), len(a) + len(v)), v.encode(), v) for v in vocab)[:3]
        assert [found[a, n] for n in (1, 2, 3)] == [(v, -s) for s, _, v in scores]


def plain_difference(costs, k):
    """Sums of one differencing of all tuples."""
    costs = sorted(costs, reverse=True) + [0.0] * (-len(costs) % k)
    heap = [(min(t) - max(t), i, sorted(t, reverse=True)) for i, t in enumerate(costs[j : j + k] for j in range(0, len(costs), k))]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        z = sorted((a + b for a, b in zip(x, y[::-1], strict=True)), reverse=True)
        heapq.heappush(heap, (z[-1] - z[0], n, z))
        n += 1
    return heap[0][2]


@pytest.mark.parametrize("n, k, block", [(203, 8, 2048), (203, 8, 4), (5, 8, 2048), (64, 1, 7), (0, 3, 2048)])
def test_bins_are_even_and_groups_whole(spark, monkeypatch, n, k, block):
    monkeypatch.setattr(balance, "BLOCK", block)
    rng = random.Random(n)
    items = [(g, rng.choice([None, 1, 50, int(rng.paretovariate(1) * 100)])) for g in range(n) for _ in range(rng.randint(1, 3))]
    out = balance.balance_by_length(spark.createDataFrame(items, "g int, len int"), "len", k, "g")
    rows = out.collect()
    cost = {}
    for g, length in items:
        cost[g] = cost.get(g, 0.0) + (24576 * length + length**2 if length else 0)
    assert {r["g"]: r["cost"] for r in rows} == cost and all(0 <= r["bin"] < k for r in rows)
    sums, counts = np.zeros(k), np.zeros(k, int)
    for r in rows:
        sums[r["bin"]] += r["cost"]
        counts[r["bin"]] += 1
    assert counts.max() - counts.min() <= 1
    ranked = sorted(cost.values(), reverse=True)
    deal = np.zeros(k)
    for i, c in enumerate(ranked):
        deal[i % k if i // k % 2 == 0 else k - 1 - i % k] += c
    assert np.ptp(sums) <= np.ptp(deal) + 1e-6
    if n and block > n:
        assert np.ptp(sums) == pytest.approx(min(np.ptp(deal), np.ptp(plain_difference(ranked, k))))
    if n:
        report = balance.imbalance(out).first()
        assert report["spread"] == pytest.approx(sums[counts > 0].max() - sums[counts > 0].min()) and report["most"] == counts.max()
