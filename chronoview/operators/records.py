"""Record queries on a view, and audits of what a view still shows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import attach


def event_counts(tables: Mapping[str, tuple[DataFrame, str | None]], manifest: DataFrame) -> DataFrame:
    """Rows per question and table before the cutoff; -1 for a table without a clock."""
    parts = []
    for name, (df, clock) in tables.items():
        if clock is None:
            parts.append(manifest.select("qid", F.lit(name).alias("table_name"), F.lit(-1).cast("bigint").alias("n")))
        else:
            seen = attach(df, manifest, clock).where(F.col(clock) < F.col("cutoff"))
            parts.append(seen.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit(name).alias("table_name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_values(df: DataFrame, column: str, limit: int = 50, shown: int = 10) -> DataFrame:
    """Distinct values in order: all of them up to ``limit``, else the first ``shown``; and their number."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    n = values.agg(F.count("*").alias("n_values"))
    first = values.orderBy("value").limit(limit)
    from pyspark.sql import Window

    ranked = first.withColumn("position", F.row_number().over(Window.orderBy("value")))
    return ranked.crossJoin(n).where((F.col("n_values") <= limit) | (F.col("position") <= shown))


def latest_visible(views: Sequence[tuple[DataFrame, Sequence[str]]], manifest: DataFrame) -> DataFrame:
    """The last time of any clock of any view, restated one second on; the cutoff where there is none."""
    parts = None
    for df, clocks in views:
        own = df.select("qid", F.greatest(*clocks).alias("_t") if len(clocks) > 1 else F.col(clocks[0]).alias("_t"))
        parts = own if parts is None else parts.unionByName(own)
    last = parts.groupBy("qid").agg(F.max("_t").alias("_t"))
    return manifest.select("qid", "cutoff").join(last, "qid", "left").select("qid", F.coalesce(F.col("_t") + F.expr("INTERVAL 1 SECOND"), "cutoff").alias("restated"))


def residual_future(view: DataFrame, clocks: Sequence[str], table: str) -> DataFrame:
    """Values after the cutoff per question and column of a view: one pass, then one row per column."""
    counts = view.groupBy("qid").agg(*[F.count_if(F.col(c) >= F.col("cutoff")).alias(c) for c in clocks])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in clocks])
    return counts.select("qid", F.lit(table).alias("table_name"), F.explode(pairs).alias("p")).select("qid", "table_name", "p.*").where("n > 0")


def violations(view: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows of each question that break a rule (a condition that must never hold), all rules in one pass."""
    counts = view.groupBy("qid").agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])
    return counts.select("qid", F.explode(pairs).alias("p")).select("qid", "p.*").where("n > 0")


def require_none(found: DataFrame) -> None:
    """Fails if an audit has found anything."""
    first = found.limit(5).collect()
    if first:
        raise ValueError(f"violations: {first}")


def keyword_match(df: DataFrame, keyword: str, columns: Sequence[str] | None = None, literal: bool = False) -> DataFrame:
    """Rows with the keyword, a pattern in lower case, in any text column."""
    names = columns or [c for c, kind in df.dtypes if kind == "string"]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())) if literal else F.lower(c).rlike(keyword.lower()), F.lit(False))
    return df.where(hit)


def value_match(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.trim(F.col(column).cast("string")) == value.strip())


def candidate_keyword(vocab: DataFrame, keyword: str, position: str) -> DataFrame:
    """Matching vocabulary entries, the first of each candidate text."""
    hits = keyword_match(vocab, keyword, ["candidate"])
    return hits.groupBy("candidate").agg(F.min(position).alias(position))


def sql_on_view(views: Mapping[str, DataFrame], statement: str) -> DataFrame:
    """One read-only statement over named views, in Spark SQL."""
    words = statement.strip().split(None, 1)
    if not words or words[0].lower() not in ("select", "with") or ";" in statement.rstrip().rstrip(";"):
        raise ValueError("only one SELECT or WITH statement")
    spark = next(iter(views.values())).sparkSession
    return spark.sql(statement, **views)


def length_report(df: DataFrame, length: str, caps: Sequence[int]) -> DataFrame:
    q = lambda p: F.percentile(length, F.lit(p))
    stats = [F.min(length).alias("min_len"), F.avg(length).alias("mean_len"), q(0.5).alias("median_len"), q(0.9).alias("p90_len"), F.max(length).alias("max_len")]
    return df.agg(F.count("*").alias("n"), *stats, *[F.count_if(F.col(length) <= c).alias(f"within_{c}") for c in caps])


def release_counts(df: DataFrame, by: Sequence[str], distinct: Mapping[str, str], expected: DataFrame | None = None) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()])
    return out if expected is None else out.join(expected, list(by), "full").withColumn("as_expected", F.col("n").eqNullSafe(F.col("expected")))


def reduce_named(metrics: DataFrame) -> DataFrame:
    """(name, value): the greatest of names with "max", the least of those with "min", else the mean."""
    name = F.col("name")
    return metrics.groupBy("name").agg(F.when(F.contains(name, F.lit("max")), F.max("value")).when(F.contains(name, F.lit("min")), F.min("value")).otherwise(F.avg("value")).alias("value"))


def anchor_time(kind: Column, rules: Mapping[str, tuple[str, int] | None]) -> Column:
    """The clock a row is placed and queried on, by its kind: a column and seconds added; null for static
    kinds; "*" holds for all others."""
    timed = lambda r: F.col(r[0]) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(r[1])) if r else F.lit(None).cast("timestamp_ntz")
    out = timed(rules.get("*"))
    for k, r in rules.items():
        if k != "*":
            out = F.when(kind == k, timed(r)).otherwise(out)
    return out
