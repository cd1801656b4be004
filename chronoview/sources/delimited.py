"""Quoted CSV read in splits: line breaks inside quotes do not make a file one task.

A file is read as lines, whichever splits Spark cuts it into. Whether a line begins inside quotes depends on all lines
before it, yet each line only maps one state to another: most leave it as it is, some swap it, some
settle it. Tasks compose the maps of their split; the composed maps of the splits (one small row each) are
applied in order of the file; then each split knows how it begins, and with it all its lines. Records of one line are parsed
where they are; only lines of longer records are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import written

QUOTE, COMMA = '"', ","


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) quotes ends inside them. A quote opens a cell only as its
    first character; a doubled one stands for itself; after any other the cell goes on to the next comma unquoted."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == QUOTE:
            inside, at = True, at + 1
        while inside:
            at = line.find(QUOTE, at) + 1
            if not at:
                return True
            if line[at : at + 1] == QUOTE:
                at += 1
            else:
                inside = False
        at = line.find(COMMA, at) + 1
        if not at:
            return False


class _Split:
    """The lines of one split so far, under both states it may begin with (0: outside, 1: inside quotes)."""

    def __init__(self) -> None:
        self.lines, self.state, self.opener = 0, np.array([0, 1]), np.array([-1, -1])

    def read(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each line its number, and for both beginnings (rows) the state before and after it and the number of
        the line that opened the record it belongs to; -1 where that lies in an earlier split."""
        n = len(lines)
        after_out, after_in = np.zeros(n, np.int64), np.ones(n, np.int64)
        for i in np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)):
            line = lines[int(i)].as_py().removesuffix("\r")
            after_out[i], after_in[i] = ends_inside(line, False), ends_inside(line, True)
        settles, swaps = after_out == after_in, (after_out == 1) & (after_in == 0)
        last = np.maximum.accumulate(np.where(settles, np.arange(n), -1))
        turns = np.cumsum(swaps)
        since = turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)
        after = np.where(last >= 0, after_out[np.maximum(last, 0)], self.state[:, None]) ^ (since & 1)
        before = np.concatenate([self.state[:, None], after[:, :-1]], axis=1)
        number = np.arange(self.lines, self.lines + n)
        opener = np.maximum.accumulate(np.where(before == 0, number, -1), axis=1)
        opener = np.where(opener < 0, self.opener[:, None], opener)
        self.lines, self.state, self.opener = self.lines + n, after[:, -1], opener[:, -1]
        return number, before, after, opener


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Runs of lines of one split; a task reads its splits one after another."""
    for batch in batches:
        splits = batch.column(1).to_numpy(zero_copy_only=False)
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((splits[1:] != splits[:-1]) | (codes[1:] != codes[:-1])) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if z > a:
                yield files.dictionary[int(codes[a])].as_py(), int(splits[a]), batch.column(2).slice(a, z - a)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: the state after it and its last record's first line, for both beginnings."""
    seen: dict[tuple[str, int], _Split] = {}
    for file, split, lines in _parts(batches):
        seen.setdefault((file, split), _Split()).read(lines)
    rows = [{"file": f, "split": s, "after_out": int(x.state[0]), "after_in": int(x.state[1]), "opener_out": int(x.opener[0]), "opener_in": int(x.opener[1])} for (f, s), x in seen.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string())] + [(c, pa.int64()) for c in list(rows[0])[1:]]))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number and, for both beginnings, whether they are a record of their own and their opener."""
    file, split, seen = None, None, _Split()
    for f, s, lines in _parts(batches):
        if (f, s) != (file, split):
            file, split, seen = f, s, _Split()
        number, before, after, opener = seen.read(lines)
        whole = (before == 0) & (after == 0)
        columns = [pa.array([f] * len(lines)), pa.array(np.full(len(lines), s)), lines, pa.array(number), *[pa.array(w) for w in whole], *[pa.array(o) for o in opener]]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "value", "number", "whole_out", "whole_in", "opener_out", "opener_in"])


def begins(splits: DataFrame) -> DataFrame:
    """(file, split, inside, from_split, from_number): whether each split begins inside quotes, and where the record
    opened that goes on into it. splits: one row for each. The maps of a file's splits are composed in order."""
    by = Window.partitionBy("file").orderBy("split")
    settles, swaps = F.col("after_out") == F.col("after_in"), (F.col("after_out") == 1) & (F.col("after_in") == 0)
    turned = splits.withColumn("_turns", F.sum(swaps.cast("int")).over(by))
    marked = turned.withColumn("_last", F.last(F.when(settles, F.struct(F.col("after_out").alias("s"), "_turns")), True).over(by))
    after = (F.coalesce("_last.s", F.lit(0)) + F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2
    known = marked.withColumn("inside", F.coalesce(F.lag(after).over(by), F.lit(0)) == 1)
    own = F.when(F.col("inside"), F.col("opener_in")).otherwise(F.col("opener_out"))
    opened = known.withColumn("_own", F.when(own >= 0, F.struct("split", own.alias("number"))))
    from_ = F.last("_own", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return opened.withColumn("_from", from_).select("file", "split", "inside", F.col("_from.split").alias("from_split"), F.col("_from.number").alias("from_number"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, number, record): the text of each record with the split and line that it begins at."""
    lines = _lines(spark, path)
    told = lines.mapInArrow(_told, "file string, split bigint, after_out bigint, after_in bigint, opener_out bigint, opener_in bigint")
    starts = written(begins(told), "csv-splits")
    own = "file string, split bigint, value string, number bigint, whole_out boolean, whole_in boolean, opener_out bigint, opener_in bigint"
    placed = lines.mapInArrow(_placed, own).join(starts, ["file", "split"])
    of = lambda c: F.when(F.col("inside"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out"))
    text = F.regexp_replace("value", "\r$", "").alias("value")
    known = placed.select("file", "split", "number", text, of("whole").alias("whole"), of("opener").alias("opener"), "from_split", "from_number")
    whole = known.where("whole").select("file", "split", "number", F.col("value").alias("record"))
    earlier = F.col("opener") < 0
    begun = F.when(earlier, F.col("from_split")).otherwise(F.col("split")).alias("at"), F.when(earlier, F.col("from_number")).otherwise(F.col("opener")).alias("line")
    longer = known.where("not whole").select("file", *begun, F.struct("split", "number", "value").alias("part"))
    joined = longer.groupBy("file", "at", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p.value), "\n").alias("record"))
    return whole.unionByName(joined.select("file", F.col("at").alias("split"), F.col("line").alias("number"), "record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header (or a folder of such), all columns as text: quoted cells may hold line breaks,
    commas and doubled quotes. Files are read in splits of any size; compressed ones are one split. An empty unquoted cell is
    null; short records end in nulls; empty lines are no records; of line ends within quotes ``\\r\\n`` becomes ``\\n``."""
    options = {"quote": QUOTE, "escape": QUOTE, "sep": COMMA}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = records(spark, path).where((F.col("record") != "") & ~((F.col("split") == 0) & (F.col("number") == 0)))
    cells = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
