"""Helpers shared by the operators: tables, cut lineage, batches of bounded size, seeded draws."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Bits of the filter for rows that may be wanted: for each wanted key, at least (1 MB), and the power of two that they
#: end at (64 MB, for 33 million keys, 6 % of the other rows; by its formula twice as many keys let 12 % through, ten times 46 %).
PER_KEY, FILTER_BITS, MOST_BITS = 16, 1 << 23, 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset (tests).
    On a cluster a warehouse on a machine's own disk is no such folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and urlparse(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_shared"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, sizes known to the planner,
    and nothing to compute again when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(df: DataFrame | None) -> None:
    """Delete the files of a ``cut`` table that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone; null counts as an empty key."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _filter_bits(keys: int) -> int:
    """Bits of the filter for so many wanted keys: a power of two, PER_KEY to twice as many a key within its limits."""
    return 1 << min(max(PER_KEY * keys - 1, 1).bit_length(), MOST_BITS) if PER_KEY * keys > FILTER_BITS else FILTER_BITS


def maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose 64-bit key may be wanted, by a bitmap, so that few others are shuffled. The join that follows decides.
    The bitmap grows with the wanted keys up to its limit, so the share of others that it lets through does not. ``wanted``
    is counted first, which is cheap for a ``cut`` table."""
    bits = _filter_bits(wanted.count())
    slot = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))  # ids are dense in their lower bits, so keys are hashed
    word, bit = F.shiftrightunsigned(slot, 15), slot.bitwiseAND(F.lit(32767))
    # Keys are dealt by their part of the bitmap before its bits are set: each part is made once, not once a task.
    slots = wanted.select(word.alias("_word"), bit.alias("_bit")).repartition("_word")
    maps = slots.groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    number = lambda i: F.conv(F.hex(F.substring("_map", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    maps = maps.select("_word", F.transform(F.sequence(F.lit(0), F.lit(511)), number).alias("_map"))
    marked = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(maps), "_word")
    own = F.get("_map", F.shiftright("_bit", 6).cast("int"))
    place = F.col("_bit").bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")  # the first of eight bytes has the highest bits
    return marked.where(F.getbit(own, place) == 1).drop("_word", "_bit", "_map")


def sided(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows (id, ...) that may be on one side of the pairs, with id under the name of that side: what a join with the
    pairs shuffles of a large table."""
    return maybe(rows, pairs.select(F.col(side).alias("id")), "id").withColumnRenamed("id", side)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes in ``column`` each, so that what a task
    holds in Python does not depend on the rows that happened to share an Arrow batch."""
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, drop: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The batch less ``drop`` and with ``columns`` at its end."""
    kept = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values()), names=kept + list(columns)
    )


def schema_of(df: DataFrame, added: str) -> str:
    """DDL of the columns of ``df`` followed by ``added``."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {added}" if own else added
