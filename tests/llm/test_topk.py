"""Blocks that are copied to many cells are no side that Spark may broadcast."""

from pyspark.sql import functions as F

from chronoview.llm import topk


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[F.floor(F.cos(F.col("id") * (i + 1)) * 100).cast("double") for i in range(4)]).alias("v")).repartition(3)
    found = topk.search(rows.where("vec_id % 20 = 0"), rows, 3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins
    v = {r.vec_id: r.v for r in rows.collect()}
    for q in range(0, 200, 20):
        want = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q)[:3]
        assert [got[q, n] for n in (1, 2, 3)] == [(i, -s) for s, i in want]
