"""Streams: scored results with last-wins upsert, running streaks, late arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_sets


def read_results_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def score_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores (qid, run_index, status, pred, gold) as they come; each batch is a folder of its own, written
    again if the batch is run again, so restarts do not repeat rows. ``latest_scores`` reads the state."""

    def write(batch: DataFrame, epoch: int) -> None:
        score_sets(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each (qid, run_index); errors never replace another status."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    rank = F.struct((F.col("status") != "error").cast("int").alias("fine"), "epoch")
    best = stored.groupBy("qid", "run_index").agg(F.max(rank).alias("_best"))
    return stored.join(best, ["qid", "run_index"]).where(rank == F.col("_best")).drop("_best")


def streak_stream(turns: DataFrame, key: str = "session", signature: str = "signature") -> DataFrame:
    """(session, signature, streak): the running streak of equal signatures after each batch of a session.
    State per session is one signature and one count. Rows of a batch are taken by their column seq."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        longest = 0
        rows = pd.concat(list(frames)).sort_values("seq")
        for s in rows[signature]:
            last, n = s, n + 1 if s == last else 1
            longest = max(longest, n)
        state.update((last, n))
        yield pd.DataFrame({key: [name[0]], "signature": [last], "streak": [n], "longest_in_batch": [longest]})

    kind = turns.schema[key].dataType.simpleString()
    return turns.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, signature string, streak long, longest_in_batch long", "last string, n long", "update", "NoTimeout")


def late_arrivals(records: DataFrame, bound: str = "1 hour", window: str = "1 day", event: str = "event_time", available: str = "available_time") -> DataFrame:
    """Rows per window of event time, and how many became known more than ``bound`` after they happened.
    Works on streams (with a watermark) and on tables."""
    late = F.col(available) > F.col(event) + F.expr(f"INTERVAL {bound}")
    marked = records.withWatermark(event, "2 days") if records.isStreaming else records
    return marked.groupBy(F.window(event, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))
