"""The folder that all executors share, and tables written to it and read back."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share: spark.checkpoint.dir, or in a local run the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if not spark.sparkContext.master.startswith("local") and urlparse(base).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, and sizes that the planner knows."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def freed(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later plan reads."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
