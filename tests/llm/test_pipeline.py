"""The pipeline's stages against what their operators say, on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from chronoview.llm import bpe, mixing, quality
from chronoview.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{len(out)}"
        stage(spark, out[-1], SF).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_rejected_documents_go(spark, stages):
    scores = quality.score(stages[0], quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))).where(F.col("score") >= pipeline.GOOD)
    assert sorted(r[0] for r in scores.select("doc_id").collect()) == sorted(r[0] for r in stages[1].select("doc_id").collect())


def test_lines_and_copies_go(stages):
    assert stages[2].count() == stages[1].count()
    assert stages[2].agg(F.sum("n_chars")).collect()[0][0] < stages[1].agg(F.sum("n_chars")).collect()[0][0]
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0
    texts = [r[0] for r in stages[3].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_mix_and_tokens(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(stages[3]).collect()}
    got = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in copies.items() if v}
    back = bpe.decode(stages[5].select("doc_id", "token_ids"), q.RANKS).select("doc_id", "decoded_text").distinct()
    assert back.join(stages[4].select("doc_id", "text").distinct(), "doc_id").where("text <> decoded_text").count() == 0


def test_stages_take_odd_rows_and_none(spark):
    """Nulls in every column, empty and long texts, repeated rows, a further column; and an empty table."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = [(None, None, None, None, None), (7001, None, "en", "s", 0), (7002, "", "en", None, 0), (7003, "\n\n", None, "s", 2), (7004, "word " * 20000, "en", "s", 100000), (7005, "same text here", "en", "s", 14), (7005, "same text here", "en", "s", 14)]
    odd = real.unionByName(spark.createDataFrame(rows, real.schema)).withColumn("SCORE", F.lit("x"))
    for docs in (odd, odd.where("false")):
        start = docs
        for k, (_, stage) in enumerate(pipeline.STAGES):
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/odd-{k}-{docs is odd}"
            stage(spark, start, SF).write.mode("overwrite").parquet(path)
            following = spark.read.parquet(path)
            assert k == 4 or following.columns == docs.columns
            assert docs is odd or following.count() == 0
            start = following
        if docs is odd:
            assert start.count() > 0


def test_run_is_the_stages(spark, stages):
    assert pipeline.run(spark, SF).count() == stages[-1].count()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.queries()[name](spark, SF).toPandas(), con.execute(q.oracle_sql()[name]).df()
    show = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(got.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and show(got) == show(want)
