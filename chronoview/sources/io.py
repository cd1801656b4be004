"""Sources and sinks: table folders, manifests, results, subject stores, views, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_csv
from .shared import work_path  # noqa: F401


def list_tables(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and paths of the .csv and .csv.gz entries of a folder; .csv wins where both exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(e.getPath().getName() for e in entries)
    found = {n.removesuffix(".csv.gz"): n for n in names if n.endswith(".csv.gz")} | {n.removesuffix(".csv"): n for n in names if n.endswith(".csv")}
    return {t: f"{path}/{n}" for t, n in sorted(found.items())}


def scan_table_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of the folder, all columns as text. Quoted cells may hold line breaks and doubled quotes, and a
    large file is read by many tasks all the same (``delimited``)."""
    return {name: read_csv(spark, where) for name, where in list_tables(spark, path).items()}


def subset_by_subject(tables: Mapping[str, DataFrame], ids: DataFrame, key: str = "subject_id", copy_others: bool = False) -> dict[str, DataFrame]:
    """Rows of the given subjects; tables without the key are left out, or copied whole. No subjects at all
    means no filter."""
    wanted = ids.select(key).distinct()
    anyone = ids.limit(1).count() == 0
    out = {n: df if anyone else df.join(wanted, key, "left_semi") for n, df in tables.items() if key in df.columns}
    return out | {n: df for n, df in tables.items() if copy_others and key not in df.columns}


def incremental_subjects(manifest: DataFrame, existing: DataFrame, key: str = "subject_id") -> DataFrame:
    return manifest.select(key).distinct().join(existing.select(key), key, "left_anti")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_subject_store(tables: Mapping[str, DataFrame], path: str, key: str = "subject_id", buckets: int = 16, files: int = 4, mode: str = "errorifexists") -> None:
    """A folder per table and bucket of subjects, with ``files`` files each; reading one subject prunes to its
    bucket. Subjects are told apart by their text, whatever their type. buckets times files is the number of
    tasks, for the caller to choose by the tables' size; the reader needs the same ``buckets``."""
    for name, df in tables.items():
        bucketed = df.withColumn("subject_bucket", _bucket(F.col(key), buckets))
        bucketed.repartition(buckets * files, "subject_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(files))).write.mode(mode).partitionBy("subject_bucket").parquet(f"{path}/{name}")


def read_subject_tables(spark: SparkSession, path: str, names: Sequence[str], subject: object, key: str = "subject_id", buckets: int = 16) -> dict[str, DataFrame]:
    """All rows of one subject, tables by name."""
    bucket = _bucket(F.lit(subject), buckets)
    read = {n: spark.read.parquet(f"{path}/{n}") for n in sorted(names)}
    return {n: df.where((F.col("subject_bucket") == bucket) & (F.col(key).cast("string") == F.lit(subject).cast("string"))).drop("subject_bucket") for n, df in read.items()}


def read_manifest(spark: SparkSession, path: str, schema: str, keyed: bool = False) -> DataFrame:
    """Questions from JSON lines, a JSON list or one object; or, ``keyed``, an object with qids for keys."""
    if keyed:
        whole = spark.read.text(path, wholetext=True)
        parsed = whole.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("qid", "q"))
        return parsed.select("qid", "q.*")
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").first()
    lines = first is not None and first[0].startswith("{") and first[0].rstrip().endswith("}")
    return spark.read.schema(schema.replace(":", " ")).option("multiLine", not lines).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the number of lines that are no JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _bad string", options).alias("r")).select("r.*")
    return lines.where("_bad is null").drop("_bad"), lines.agg(F.count("_bad").alias("malformed"))


def seeded(seed: object, *keys: Column) -> Column:
    """An integer below 2**32 that depends on the seed and the keys; SQL engines with md5 compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")


def subset_manifest(manifest: DataFrame, where: Column, n: int, seed: int, key: str = "qid") -> DataFrame:
    return manifest.where(where).orderBy(seeded(seed, F.col(key)), key).limit(n)


def concat_sources(frames: Sequence[DataFrame], max_rows: int | None = None, seed: int = 0, key: str = "qid") -> DataFrame:
    """Rows of all frames, columns aligned by name; optionally a seeded sample."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(seeded(seed, F.col(key)), key).limit(max_rows) if max_rows else out


def write_views(views: Mapping[tuple[str, str], DataFrame], path: str) -> DataFrame:
    """Writes each (view, table) and returns an index: rows, columns and an order-free checksum per
    question; empty tables are in the index of tables but have no files."""
    index = None
    for (view, table), df in views.items():
        df.write.parquet(f"{path}/view={view}/table={table}")
        stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/view={view}/table={table}")
        own = stored.groupBy("qid").agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*stored.columns)).alias("checksum"))
        own = own.select(F.lit(view).alias("view"), F.lit(table).alias("table_name"), "qid", "n_rows", F.lit(",".join(df.columns)).alias("columns"), "checksum")
        index = own if index is None else index.unionByName(own)
    return index


def shard(manifest: DataFrame, i: int, n: int, position: str = "pos") -> DataFrame:
    """Rows of shard i of n, for builds that restart by parts."""
    return manifest.where(F.pmod(F.col(position), F.lit(n)) == i)


def merge_shards(parts: Sequence[DataFrame], n: int) -> DataFrame:
    """All shards together; their number must be complete. Order is that of the column pos, for who sorts."""
    if len(parts) != n:
        raise ValueError(f"{len(parts)} of {n} shards")
    return concat_sources(parts)


def cutoff_conflicts(manifest: DataFrame) -> DataFrame:
    """Subjects for which one physical snapshot is asked at several cutoffs."""
    return manifest.groupBy("subject_id").agg(F.count_distinct("cutoff").alias("cutoffs")).where("cutoffs > 1")


def resume(manifest: DataFrame, results: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """What is left to run: all but rows with a result that is no error."""
    return manifest.join(results.where("status <> 'error'").select(*keys).distinct(), list(keys), "left_anti")


def last_wins(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest result of each key."""
    latest = results.groupBy(*keys).agg(F.max(order).alias(order))
    return results.join(latest, [*keys, order])


def describe(columns: DataFrame, links: DataFrame) -> DataFrame:
    """columns (table_name, column_name, description), links (table_name, link_table): a table's column
    docs and those of the tables linked to it; its own win."""
    linked = links.join(columns.withColumnRenamed("table_name", "link_table"), "link_table").select("table_name", "column_name", "description")
    extra = linked.join(columns, ["table_name", "column_name"], "left_anti").groupBy("table_name", "column_name").agg(F.min("description").alias("description"))
    return columns.select("table_name", "column_name", "description").unionByName(extra)


CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGES = f"array<struct<role:string,content:string,reasoning_content:string,tool_call_id:string,tool_calls:array<{CALL}>>>"


def write_train_val(rows: DataFrame, path: str, split: str = "split") -> None:
    """Message rows by split under one explicit nested schema; tool arguments stay JSON texts."""
    rows.withColumn("messages", F.col("messages").cast(MESSAGES)).write.partitionBy(split).parquet(path)
