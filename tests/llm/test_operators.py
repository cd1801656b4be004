"""Each operator against a plain computation, and on nulls, empty and long texts, ties, repeated rows, empty
tables and columns whose names clash."""

import base64
import gzip
import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from chronoview.llm import bpe, lines, media, minhash, mixing, near, quality, sharding, topk, toxicity, urls
from chronoview.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "é" * 40, "日本語のテキスト。", "x " * 3000, "z" * 5000, "tab\tand\r\nlines\n", "'s 12,000 “quotes” \x00\x1f 　 \U0001f600", "don't don'T we're"]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    """Odd texts, two of them again under the same id, and a row without any value."""
    df = table(spark, ODD)
    return df.unionByName(df.where("doc_id in (1, 8)")).unionByName(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def encoding():
    with open(q.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_and_round_trips(spark, encoding):
    docs = odd(spark).withColumn("Token_IDs", F.lit("taken"))
    out = bpe.decode(bpe.encode(docs, q.RANKS, public_tokenizers.PATTERN, offsets=True), q.RANKS).collect()
    assert len(out) == docs.count()
    for r in out:
        text = r["text"] or ""
        want = encoding.encode_ordinary(text)
        assert list(r["token_ids"]) == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded_bytes"]) == text.encode() and r["decoded_text"] == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        for i, s in zip(want, r["token_spans"], strict=True):
            assert encoding.decode_single_token_bytes(i) in text[s["start"] : s["end"]].encode()
    assert bpe.encode(table(spark, []), q.RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_documents(spark, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in q.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (len(encoding.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest())


def test_words_and_grams():
    from chronoview.llm.words import Words

    texts = ["The cat, the CAT", "the cat", None, "w" * 3_000_000, "a b c d"]
    w = Words(texts, (2,))
    h = [w.hash[w.doc == d].tolist() for d in range(5)]
    assert h[0] == h[1] * 2 and h[2] == [] and len(h[4]) == 4
    d, g = w.grams(1)
    assert Counter(d.tolist())[0] == 3 and g[d == 0][0] == g[d == 0][2] == g[d == 1][0]
    assert Words(["cattle"], (2,)).stem[2][0] == Words(["cat"], (2,)).stem[2][0]


def test_toxicity_learns_and_defines_odd_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + (" stupid clown" if i % 5 == 0 else "") for i in range(600)]
    docs = table(spark, texts)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, *model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["toxic"] == 1) for r in scored]) > 0.97
    out = toxicity.score(odd(spark).withColumn("SCORE", F.lit("x")), *model).collect()
    assert len(out) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in out)
    assert out[0]["score"] == out[1]["score"]
    assert toxicity.score(table(spark, []), *model).count() == 0
    blank = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, *blank).select("score").distinct().collect()[0][0] == 0.5


def test_held_out_is_the_stated_third(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([3, 1, 4])
    start = np.array([0, 3, 4])
    s, t, first = rng.normal(size=8), rng.normal(size=(2, 2)), 0.3
    got, _, _ = quality.marginals(s, t, first, start, count)
    for a, n in zip(start, count, strict=True):
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(first * y[0] + sum(s[a + i] * v for i, v in enumerate(y)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[a : a + n], good / total)


def test_quality_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op9_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, labels, 200)
    out = quality.score(odd(spark), model).collect()
    assert len(out) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(table(spark, []), model).count() == 0
    assert set(quality.quality(["a\nb", None], quality.train(docs, labels.where("false")))) == {0.5}


def test_mixing_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 5, None: 1000, "c": 0, "d": 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    names = sorted([k for k in sizes if k]) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[k] for k in full)
        want = {k: 3 * sizes[k] if k in full else rest * weight[k] / sum(weight[j] for j in names if j not in full) for k in names}
        more = {k for k in names if k not in full and want[k] > 3 * sizes[k]}
        if not more:
            break
        full |= more
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix_repeats_whole_rows(spark):
    docs = table(spark, ["one two three"] * 300).withColumn("source", F.when(F.col("doc_id") < 30, "a").otherwise("b")).withColumn("SIZE", F.lit(9))
    plan = mixing.plan(docs).collect()
    taken = Counter()
    for r in plan:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    targets = {r["source"]: r["target"] for r in plan}
    assert targets["a"] == 270 and abs(taken["b"] - targets["b"]) < 0.15 * targets["b"] and taken["a"] == 270
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.plan(odd(spark)).count() == len(ODD) + 3 and mixing.mix(table(spark, [])).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantized(df)
    got = {}
    for r in topk.search(v.where("vec_id % 50 = 0"), v, 5).collect():
        got[r["query_id"], r["rank"]] = (r["vec_id"], r["score"])
    whole = {i: np.floor(256 * np.array(e)).astype(int) for i, e in rows[:300]} | {304: np.zeros(0, int)}
    for i in range(0, 300, 50):
        scored = sorted((-int(whole[i][: len(w)] @ w[:6]), j) for j, w in whole.items() if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in scored]
    assert topk.search(v.where("false"), v, 5).count() == 0
    assert topk.search(v, v.where("false"), 5).count() == 0
    wide = np.array([[2.0**60, 1.0]])
    assert topk.scores(wide, np.array([[1.0, 3.0]]))[0, 0] == 2**60 + 3


def png(data=b"\x00\x01\x02"):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + data)) + chunk(b"IEND", b"")


def test_media_types_are_confirmed_and_carved(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    broken = png()[:-6] + b"\x00" * 6
    values = [(0, png(), "image/jpeg"), (1, media.wav(b"abc" * 30), "audio/wav"), (2, b"head" + png() + b"mid" + gif + b"end", "text/plain"), (3, broken, "image/png"), (4, gzip.compress(b"hello"), None), (5, None, "image/png"), (6, b"", "x/y"), (7, b"BMRIFFGIF89aPK\x03\x04%PDF-", "text/plain")]
    df = spark.createDataFrame(values, "i int, media binary, declared_type string").withColumn("MEDIA_TYPE", F.lit(1))
    got = {r["i"]: r for r in media.sniff(df).collect()}
    assert [got[i]["media_type"] for i in range(8)] == ["image/png", "audio/wav", "text/plain", None, "application/gzip", None, "x/y", "text/plain"]
    assert got[0]["type_corrected"] and not got[1]["type_corrected"] and got[0]["valid_bytes"] == len(png())
    assert [(e["type"], e["offset"]) for e in got[2]["embedded"]] == [("image/png", 4), ("image/gif", 4 + len(png()) + 3)]
    assert got[2]["embedded"][0]["sha256"] == hashlib.sha256(png()).hexdigest() and got[7]["embedded"] == []


def test_media_payload_round_trip(spark):
    docs = odd(spark)
    out = media.describe(media.sniff(media.store_text(docs.select("doc_id", "text").withColumn("t", F.col("text")))))
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        data = (r["t"] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(payload) + 44


def test_urls_equal_plain_rules(spark):
    hosts = ["a.example.net", "example.net", "notexample.net", "x.y.example.com", "foo.org", "net", "NET", "", "b.c"]
    paths = ["/en/1?q", "/de/2#x", "", "/", "/fr/", "/en", "?x=/en/", "/en/é"]
    given = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://a.net://b/en/"]
    rules = q.RULES + [("a.example.net", "/", "block"), ("example.net", "/en/1", "block")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given * 2)], "page_id long, url string, Verdict string")
    got = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), rows_per_range=9).collect()
    assert len(got) == len(given) * 2
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[2], want[3])
    empty = df.where("false")
    assert urls.judge(empty, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_sharding_balances_and_numbers(spark):
    texts = [f"text {i % 700} " * (i % 37 + 1) for i in range(900)] + ["same"] * 50
    docs = table(spark, texts).unionByName(odd(spark).where("n_chars < 1000 or n_chars is null"))
    rows = sharding.shard(docs, run_rows=7, block=64).collect()
    assert len(rows) == docs.count()
    sums, slots, where = Counter(), {}, {}
    own = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    for r in rows:
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["doc_id"], r["text_crc32"]) in own
        assert where.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert set(sums) == set(range(24)) and max(sums.values()) - min(sums.values()) < 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(table(spark, [])).count() == 0


def test_differencing_on_a_known_case():
    sums = np.array([[0, x] for x in (8, 7, 6, 5, 4)])
    place = sharding.difference(sums)
    total = [0, 0]
    for i, x in enumerate((8, 7, 6, 5, 4)):
        total[place[i, 1]] += x
    assert sorted(total) == [14, 16]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)] + [(1, 1), (5, 3), (3, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x not in (1,) and Counter(find(y) for y in parent)[find(x)] > 1}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def classes_of(sets, threshold=0.8):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= threshold:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def family(rng, base, edits):
    words = base.split()
    for k in rng.integers(0, len(words), edits):
        words[k] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 150)) for _ in range(3)]
    texts = [family(rng, b, e) for b in base for e in (0, 0, 1, 1, 2, 2, 3, 3, 4, 6, 8)] + ["one two three four", "One, two THREE four!", "one two", "", None, "...", "one two three four"]
    docs = table(spark, texts).unionByName(table(spark, texts[:2])).withColumn("KEY", F.lit(1))
    rows = minhash.classes(docs).collect()
    assert len(rows) == docs.count()
    tokens = {i: re.findall(r"\w+", (t or "").lower()) for i, t in enumerate(texts)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in tokens.items()}
    want = classes_of(sets)
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or ""):
            a, b = want[i], want[j]
            want = {k: min(a, b) if v in (a, b) else v for k, v in want.items()}
    assert {r["doc_id"]: r["class_id"] for r in rows} == want
    kept = minhash.dedup(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and kept[0].asDict().keys() == set(docs.columns)
    assert minhash.dedup(table(spark, [])).count() == 0
    assert minhash.dedup(odd(spark)).count() > 0


def test_large_family_costs_one_comparison_each(spark):
    """Copies that are all near one text, most of them too far from each other."""
    rng = np.random.default_rng(5)
    base = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
    texts = [base] + [family(rng, base, e) for e in (3, 5) for _ in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(table(spark, texts)).collect()}
    assert got == classes_of(sets)


def test_registers_estimate_probability_jaccard():
    a, b = np.arange(1, 101, dtype=np.uint64) * 7919, np.arange(26, 126, dtype=np.uint64) * 7919
    one = np.ones(100)
    agree = []
    for shift in range(40):
        s = np.uint64(shift * 104729 + 13)
        agree.append((minhash.signatures(np.zeros(100, int), a + s, one, 1) == minhash.signatures(np.zeros(100, int), b + s, one, 1)).mean())
    assert abs(np.mean(agree) - 75 / 125) < 0.03


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(200)]
    line = lambda n: " ".join(rng.choice(words, n))
    shared = [line(40) for _ in range(6)]
    edit = lambda s: s.replace(" word", " werd", 1)
    texts = ["\n".join([line(20), shared[i % 6] if i % 2 else edit(shared[i % 6]), "", "short", line(15)]) for i in range(40)] + ODD[1:] + ["only " + shared[0]]
    docs = table(spark, texts).withColumn("Lines_Removed", F.lit("x"))
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(None, None, None, None, None, "y")], docs.schema))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    want = line_classes(texts)
    assert all(got[i] == want[i] for i in range(len(texts)))
    assert got[None] is None
    assert lines.dedup(table(spark, [])).count() == 0


def line_classes(texts, width=5):
    """Root of each line that is not empty, by its own shingling; and what the documents become."""
    found = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(t.split("\n")):
            if x:
                found.setdefault(x, []).append((i, k))
    root = classes_of({x: {x[j : j + width] for j in range(len(x) - width + 1)} or {x} for x in found})
    first = {}
    for x, where in found.items():
        first[root[x]] = min([first.get(root[x], (10**9, 0)), *where])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x or first[root[x]] == (i, k)) for i, t in enumerate(texts)}


def deduped(spark, texts):
    return {r["doc_id"]: r["text"] for r in lines.dedup(table(spark, texts)).collect()}


def test_line_recall_on_documents(spark):
    """All pairs of lines of sf0.01 at 0.8 or more, by an index of their shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known, roots = lines.classes(docs)
    root = {(r["k1"], r["k2"]): r["root"] for r in known.join(roots, "id").collect()}
    keyed = {(r["k1"], r["k2"]): r["line"] for r in lines.occurrences(docs).collect()}
    keys, texts = list(keyed), list(keyed.values())
    sets = [{x[j : j + 5] for j in range(len(x) - 4)} or {x} for x in texts]
    index: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    index = {x: np.array(v) for x, v in index.items()}
    size, found, near_pairs = np.array([len(s) for s in sets]), 0, 0
    for i, s in enumerate(sets):
        common = np.zeros(len(sets), np.int32)
        for x in s:
            common[index[x]] += 1
        for j in np.flatnonzero(common >= 0.8 * (size[i] + size - common)):
            if j > i:
                near_pairs += 1
                found += keys[i] in root and root[keys[i]] == root.get(keys[j])
    assert near_pairs > 100 and found >= 0.97 * near_pairs


def test_lines_with_a_changed_word_are_near(spark):
    """More lines in one bucket than SMALL, and pairs in small ones."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(400)]
    made = []
    for n in (12, 20, 40):
        for copies in (1, 2, 30):
            base = list(rng.choice(words, n))
            for c in range(copies + 1):
                at = int(rng.integers(0, n)) if c else None
                made.append(" ".join("changed" if j == at else w for j, w in enumerate(base)))
    texts = [made[i] for i in rng.permutation(len(made))]
    assert deduped(spark, texts) == line_classes(texts)


def test_short_lines_repeat_too(spark):
    texts = ["Menu\n\nab\n日本語の見出し", "ab\nMenu\n", "日本語の見出し\n\nabc\n \n ", "x\nabc\ny"]
    want = line_classes(texts)
    assert want[1] == "" and want[3] == "x\ny" and deduped(spark, texts) == want


def test_lines_that_differ_at_the_end_stay(spark):
    texts = ["Department organization electricity", "Department organization electronics", "Die Bundesregierung unterstützt Landwirtschaft", "Die Bundesregierung unterstützt Landesbehörden"]
    want = line_classes(texts)
    assert list(want.values()) == texts and deduped(spark, texts) == want
