"""Queries of the package by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables in one folder, and the record table and cutoff manifest that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def records(self) -> DataFrame:
        """events as records with two clocks: when it happened, and when it could be known."""
        known = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("value") * 60))
        return self.events.select("event_id", F.col("user_id").alias("subject_id"), F.col("ts").alias("event_time"), known.alias("available_time"), "event_type", "value", "props")

    @property
    def manifest(self) -> DataFrame:
        """Two questions for each subject, a week apart."""
        users = self.events.select(F.col("user_id").alias("subject_id")).distinct()
        pairs = users.select("subject_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        return pairs.select(
            F.concat(F.lit("u"), F.col("subject_id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("qid"),
            "subject_id",
            (F.lit("2024-01-08").cast("timestamp_ntz") + F.make_dt_interval((F.col("subject_id") % 7 + 7 * F.col("k")).cast("int"))).alias("cutoff"),
            F.when(F.col("k") == 0, "first").otherwise("second").alias("task"),
        )


#: The same two tables for SQL.
RECORDS = """r AS (SELECT event_id, user_id AS subject_id, ts AS event_time, ts + to_seconds(round(value * 60)) AS available_time,
  event_type, value, props FROM events)"""
MANIFEST = """m AS (SELECT 'u' || user_id || '_' || k AS qid, user_id AS subject_id,
  TIMESTAMP '2024-01-08' + to_days((user_id % 7 + 7 * k)::INTEGER) AS cutoff, CASE WHEN k = 0 THEN 'first' ELSE 'second' END AS task
  FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES (0), (1)) v(k))"""
BOTH = f"WITH {RECORDS}, {MANIFEST}"


def query(sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def stamp(c: Column | str) -> Column:
    """A time as text to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
