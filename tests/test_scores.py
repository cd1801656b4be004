"""Small numeric cases of grouped scores, answers and streams."""

import json
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from chronoview.functions import text as tx
from chronoview.operators import groups as gr, scoring as sc
from chronoview.streaming import streams as st


def test_group_norm_singleton_and_pair(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "uid string, score double")
    got = {(r["uid"], r["score"]): round(r["advantage"], 4) for r in gr.group_norm(df).collect()}
    assert got == {("a", 1.0): -0.7071, ("a", 3.0): 0.7071, ("b", 5.0): 5.0}
    assert [round(r["advantage"], 4) for r in gr.group_rloo(df).orderBy("score").collect()] == [-2.0, 2.0, 5.0]


def test_passk_needs_two(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2)], "uid string, score double, i int")
    assert [r["advantage"] for r in gr.group_passk(df, "i", use_std=False).orderBy("i").collect()] == [0.0, 2.0]
    with pytest.raises(Exception, match="fewer than two"):
        gr.group_passk(df.where("i = 1"), "i").collect()


def test_set_scores(spark):
    df = spark.createDataFrame([(1, ["A", "b"], ["a", "B"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["a", "c"], ["a"])], "i int, pred array<string>, gold array<string>")
    assert [round(r["f1"], 4) for r in sc.score_sets(df).orderBy("i").collect()] == [1.0, 0.0, 0.0, 0.6667]


def test_expected_best_is_exact(spark):
    df = spark.createDataFrame([("q", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k string, i int, score double")
    assert gr.expected_best_at_k(df, 2, ["k"], "i").collect()[0]["best_at_k"] == pytest.approx(20 / 6)
    assert gr.order_statistics(df, 1, ["k"]).collect()[0]["best"] == pytest.approx(2.5)


def test_expected_best_of_few_runs_is_their_maximum(spark):
    scores = {"one": [7.0], "two": [5.0, 2.0], "four": [1.0, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame([(k, i, v) for k, x in scores.items() for i, v in enumerate(x)], "k string, i int, score double")
    for k in (1, 2, 3, 5):
        want = {q: sum(max(c) for c in combinations(x, min(k, len(x)))) / comb(len(x), min(k, len(x))) for q, x in scores.items()}
        assert {r["k"]: r["best_at_k"] for r in gr.expected_best_at_k(df, k, ["k"], "i").collect()} == pytest.approx(want)


def test_answers_and_lists(spark):
    df = spark.createDataFrame([("<answer>x</answer><answer>The  Cat.</answer>", ["cat"]), ("no tags", ["cat"])], "t string, g array<string>")
    assert [r[0] for r in df.select(tx.score_exact_match(F.col("t"), F.col("g"))).collect()] == [1.0, 0.0]
    lists = spark.createDataFrame([('say ["a", "b"]',), ("['a', 'b",), ("none",), (None,)], "t string")
    assert [r[0] for r in lists.select(tx.parse_list("t")).collect()] == [["a", "b"], ["a", "b"], None, None]


def test_embedded_responses_cut_off_anywhere(spark):
    """Whatever is left of a list is read; of an item cut off, its beginning."""
    whole = 'so {"response": ["a, b", "c\\"d]", "é"]}'
    ends = [whole[:n] for n in range(len(whole) + 1)]
    rows = [(i, x) for i, x in enumerate(ends)] + [(900, None), (901, "{'response': 'x'} tail"), (902, '{"response": ["a"], "more": {"k": [1'), (903, '{"response": {"a" 1}}'), (904, '{"response": [}')]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.embedded_response("t")).collect()}
    assert got[len(whole)] == ["a, b", 'c"d]', "é"] and got[901] == ["x"] and got[902] == ["a"] and got[900] is got[903] is got[904] is None
    start = whole.index("[") + 1
    for n in range(start, len(whole)):
        assert got[n] is not None and all(full.startswith(part) for full, part in zip(["a, b", 'c"d]', "é"], got[n], strict=False)), (ends[n], got[n])


def test_tool_calls_by_hand(spark):
    """Names, argument names and values; a gold call takes the best unused call of its name."""
    call = lambda n, **a: {"name": n, "arguments": a}
    cases = [
        ([call("f", x=1)], [call("f", x=1)], 3.0),
        ([], [], 3.0),
        ([], [call("f", x=1)], -3.0),
        ([call("f", x=1)], [call("f", x=2)], 6 * (1 + 1) / 3 - 3),
        ([call("f", x=1, y=2), call("g")], [call("f", x=1)], 6 * (0.5 + 0.5 + 1) / 3 - 3),
        ([call("f", x=1), call("f", x=2)], [call("f", x=2), call("f", x=1)], 6 * (1 + 2 + 2) / 5 - 3),
        ([call("f", x=2)], [call("f", x=2), call("f", x=2)], 6 * (0.5 + 2) / 5 - 3),
        ([call("h", x=2)], [call("f", x=2)], -3.0),
    ]
    rows = [(i, json.dumps(p), json.dumps(g)) for i, (p, g, _) in enumerate(cases)] + [(99, None, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, p string, g string").select("i", tx.tool_call_score(F.col("p"), F.col("g"))).collect()}
    assert got == pytest.approx({i: c[2] for i, c in enumerate(cases)} | {99: 3.0})


def test_streak_over_batches(spark, tmp_path):
    schema = "session long, seq long, signature string"
    out = []
    for n, rows in enumerate([[(1, 1, "a"), (1, 2, "a")], [(1, 3, "a"), (2, 1, "b")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = st.streak_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, e: out.extend((r["session"], r["streak"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(out) == [(1, 2), (1, 3), (2, 1)]


def test_lists_that_nothing_closes_are_read_without_vain_attempts(monkeypatch):
    tried = []
    read = tx.ast.literal_eval
    monkeypatch.setattr(tx.ast, "literal_eval", lambda x: tried.append(x) or read(x))
    assert tx._loads("it is ['a', 'b'") == ["a", "b"] and tried == ["['a', 'b'", "['a', 'b']"]
    assert tx._loads("it is ['a', 'b") == ["a", "b"] and tx._loads("[x]") is None and tried.count("[x]") == 1
