"""Snapshots: one safe record per subject on disk, committed by a manifest of checksums and audited before it is trusted.

A build writes the tables of the subjects it was asked for into a folder of its own, and then one row for each subject and table
into the manifest. A subject's snapshot is what its latest build says, so one subject can be built anew without touching the
others, and a build that was cut off before its manifest has not happened.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cutoff_conflicts
from . import record_policies as rp
from .policies import ChildPolicy, TablePolicy, audit_views, point_in_time_view

MANIFEST = "subject_id string, cutoff timestamp_ntz, version string, build string, built_at timestamp, table_name string, n_rows bigint, checksum bigint"


def strict_view(tables: Mapping[str, DataFrame], manifest: DataFrame, allowed: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """``point_in_time_view`` under the strict policies; tables that these do not keep are left out."""
    kept = {n: df for n, df in tables.items() if n not in rp.STRICT_DROPPED}
    return point_in_time_view(kept, manifest, rp.STRICT_TABLES, allowed)


def _checksum(columns: Sequence[str]) -> Column:
    """A number that no order of rows changes, and the loss or repetition of one does."""
    return F.sum(F.shiftright(F.xxhash64(*[F.col(c) for c in sorted(columns)]), 20)).alias("checksum")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows so far; none where there is no manifest yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of each subject's latest build."""
    rows = _manifest(spark, path)
    last = rows.groupBy("subject_id").agg(F.max(F.struct("built_at", "build")).alias("_b")).select("subject_id", F.col("_b.build").alias("build"))
    return rows.join(last, ["subject_id", "build"], "left_semi")


def read_snapshot(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of all current snapshots: the rows that each subject's latest build wrote. schema: DDL of the table."""
    builds = current(spark, path).where(F.col("table_name") == table).select("subject_id", "build").distinct()
    paths = [f"{path}/build={r['build']}/{table}" for r in builds.select("build").distinct().collect()]  # one a build
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    rows = rows.withColumn("_subject", F.col("subject_id").cast("string")).withColumn("_build", F.regexp_extract("_metadata.file_path", "build=([0-9a-f]+)/", 1))
    mine = builds.select(F.col("subject_id").alias("_subject"), F.col("build").alias("_build"))
    return rows.join(mine, ["_subject", "_build"], "left_semi").drop("_subject", "_build")


def audit_snapshots(spark: SparkSession, path: str, schemas: Mapping[str, str], policies: Mapping[str, TablePolicy | ChildPolicy] = rp.STRICT_TABLES) -> DataFrame:
    """(subject_id, problem): subjects whose current files are not what the manifest says, or hold a time at or
    after their cutoff."""
    now = current(spark, path)
    cutoffs = now.select("subject_id", "cutoff").distinct()
    out = None
    for table, schema in schemas.items():
        rows = read_snapshot(spark, path, table, schema)
        own = rows.withColumn("_subject", F.col("subject_id").cast("string"))
        found = own.groupBy("_subject").agg(F.count("*").alias("_n"), _checksum(rows.columns).alias("_c"))
        said = now.where(F.col("table_name") == table).select(F.col("subject_id").alias("_subject"), "n_rows", "checksum")
        wrong = said.join(found, "_subject", "left").where((F.coalesce("_n", F.lit(0)) != F.col("n_rows")) | ~F.col("_c").eqNullSafe(F.col("checksum")))
        parts = [wrong.select(F.col("_subject").alias("subject_id"), F.lit(f"{table}: files").alias("problem"))]
        seen = own.join(cutoffs.withColumnRenamed("subject_id", "_subject"), "_subject").withColumn("qid", F.col("_subject"))
        late = _late(seen.drop("_subject"), table, policies)
        if late is not None:
            parts.append(late.select(F.col("qid").alias("subject_id"), F.lit(f"{table}: late").alias("problem")).distinct())
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def _late(view: DataFrame, table: str, policies: Mapping[str, TablePolicy | ChildPolicy]) -> DataFrame | None:
    """Rows with a time of a column named like one at or after the cutoff."""
    from ..functions.cleanse import parse_time
    from .policies import clock_like

    clocks = [c for c in view.columns if clock_like(c) and c != "cutoff"]
    if table not in policies or not clocks:
        return None
    late = F.lit(False)
    for c in clocks:
        late = late | F.coalesce(parse_time(F.col(c), c) >= F.col("cutoff"), F.lit(False))
    return view.where(late)


def _gathered(rows: DataFrame, subjects: int) -> DataFrame:
    """Manifest rows in a few files. They are shuffled, for coalesce would have the joins of all tables run in as few tasks."""
    return rows.repartition(max(1, subjects // 100_000), "subject_id")


def build_snapshots(tables: Mapping[str, DataFrame], subjects: DataFrame, allowed: Mapping[str, Sequence[str]], path: str, anew: DataFrame | None = None, version: str = rp.STRICT_VERSION) -> int:
    """Builds the snapshots of ``subjects`` (subject_id, cutoff) that are not there yet and returns how many it built.

    A subject that is asked for at several cutoffs is an error. What is there is kept if it has the same cutoff and
    version and passes ``audit_snapshots``; else, and for the subjects of ``anew``, it is built again. Views are audited
    before they are written. An interrupted call is called again.
    """
    spark = subjects.sparkSession
    if conflicts := cutoff_conflicts(subjects).limit(5).collect():
        raise ValueError(f"subjects with several cutoffs: {[r['subject_id'] for r in conflicts]}")
    asked = subjects.select(F.col("subject_id"), F.col("cutoff").cast("timestamp_ntz").alias("cutoff")).distinct().withColumn("qid", F.col("subject_id").cast("string"))
    empty = strict_view(tables, asked.where("false"), allowed)
    schemas = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.drop("qid", "cutoff").schema.fields) for n, v in empty.items()}
    now = current(spark, path)
    good = now.where(F.col("version") == version).select(F.col("subject_id").alias("qid"), "cutoff").distinct()
    bad = audit_snapshots(spark, path, schemas).select(F.col("subject_id").alias("qid"))
    todo = asked.join(good.join(bad, "qid", "left_anti"), ["qid", "cutoff"], "left_anti")
    if anew is not None:
        todo = todo.unionByName(asked.join(anew.select(F.col("subject_id").cast("string").alias("qid")), "qid", "left_semi")).distinct()
    build = uuid.uuid4().hex
    todo.write.parquet(f"{path}/build={build}/_asked")
    todo = spark.read.parquet(f"{path}/build={build}/_asked")
    count = todo.count()
    if not count:
        return 0
    views = strict_view(tables, todo, allowed)
    problems = audit_views({n: v for n, v in views.items()}, rp.STRICT_TABLES)
    if problems is not None and (found := problems.limit(5).collect()):
        raise ValueError(f"unsafe views: {found}")
    rows = None
    for name, view in views.items():
        view.drop("qid", "cutoff").write.parquet(f"{path}/build={build}/{name}")
        stored = spark.read.schema(schemas[name]).parquet(f"{path}/build={build}/{name}")
        own = stored.groupBy(F.col("subject_id").cast("string").alias("qid")).agg(F.count("*").alias("n_rows"), _checksum(stored.columns))
        each = todo.join(own, "qid", "left").select(F.col("qid").alias("subject_id"), "cutoff", F.lit(version).alias("version"), F.lit(build).alias("build"), F.current_timestamp().alias("built_at"), F.lit(name).alias("table_name"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "checksum")
        rows = each if rows is None else rows.unionByName(each)
    _gathered(rows, count).write.mode("append").parquet(f"{path}/manifest")
    return count
