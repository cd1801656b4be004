"""Records as text: a timeline of blocks, one for each run of rows of one table, as lists of fields or markdown tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import runs

#: Texts that count as missing.
BLANK = ["", "nan", "NaN", "NaT", "None", "<NA>"]


@dataclass(frozen=True)
class Shown:
    """How a table is shown: its heading, the clock it is placed by (none: undated), the columns in order with what they
    are called, and the column that settles the order of rows of one time. The clock's own column is not shown."""

    label: str
    columns: Sequence[tuple[str, str]]
    clock: str | None
    position: str


def cell(value: Column) -> Column:
    """A value as text that fits a row of a markdown table; empty where it is missing."""
    text = value.cast("string")
    flat = F.trim(F.replace(F.replace(F.replace(text, F.lit("|"), F.lit("/")), F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")))
    return F.when(text.isNull() | F.trim(text).isin(BLANK), "").otherwise(flat)


def timeline_rows(views: Mapping[str, tuple[DataFrame, Shown]], key: str = "qid") -> DataFrame:
    """(key, table_name, at, pos, cells, run): all rows of the views, each table's cells in its order; run numbers the
    dated rows of one table that follow each other, and is 0 for rows without a time."""
    parts = None
    for name, (view, shown) in views.items():
        at = F.lit(None).cast("timestamp_ntz") if shown.clock is None else F.col(shown.clock).cast("timestamp_ntz")
        cells = F.array(*[cell(F.col(c)) for c, _ in shown.columns if c != shown.clock]).cast("array<string>")
        own = view.select(key, F.lit(name).alias("table_name"), at.alias("at"), F.col(shown.position).cast("bigint").alias("pos"), cells.alias("cells"))
        parts = own if parts is None else parts.unionByName(own)
    dated = runs(parts.where("at is not null"), "table_name", ["at", "table_name", "pos"], key)
    return dated.withColumn("run", F.col("run").cast("bigint")).unionByName(parts.where("at is null").withColumn("run", F.lit(0).cast("bigint")))


def timeline_blocks(views: Mapping[str, tuple[DataFrame, Shown]], key: str = "qid") -> DataFrame:
    """(key, run, table_name, rows, text): a block for each table's undated rows (run 0) and for each run. Columns
    that are empty in all rows of a block are left out; one row is a list of its fields, more are a table."""
    rows = timeline_rows(views, key)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "cells"))), lambda r: r.cells)
    blocks = rows.groupBy(key, "run", "table_name").agg(F.count("*").alias("rows"), F.min("at").alias("start"), listed.alias("r"))
    names, labels = F.lit(""), F.array().cast("array<string>")
    for name, (_, shown) in views.items():
        here = F.col("table_name") == name
        names = F.when(here, F.lit(shown.label)).otherwise(names)
        labels = F.when(here, F.array(*[F.lit(label) for c, label in shown.columns if c != shown.clock]).cast("array<string>")).otherwise(labels)
    wide = blocks.withColumn("names", names).withColumn("labels", labels)
    places = F.filter(F.sequence(F.lit(0), F.size("labels")), lambda i: (i < F.size("labels")) & F.exists("r", lambda c: F.get(c, i) != ""))
    kept = wide.withColumn("keep", places)
    pick = lambda cells: F.transform("keep", lambda i: F.get(cells, i))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fields = F.transform(F.arrays_zip(pick(F.col("labels")).alias("k"), pick(F.get("r", F.lit(0))).alias("v")), lambda z: F.concat(F.lit("- "), z.k, F.lit(": "), z.v))
    table = F.concat(F.array(line(pick(F.col("labels"))), line(F.transform("keep", lambda _: F.lit("---")))), F.transform("r", lambda c: line(pick(c))))
    head = F.concat(F.lit("## "), F.col("names"), F.lit(" ["), F.coalesce(F.date_format("start", "yyyy-MM-dd HH:mm:ss"), F.lit("None")), F.lit("]"))
    body = F.when(F.size("keep") == 0, F.array().cast("array<string>")).when(F.col("rows") == 1, fields).otherwise(table)
    return kept.select(key, "run", "table_name", "rows", F.array_join(F.concat(F.array(head), body), "\n").alias("text"))


def render_timeline(views: Mapping[str, tuple[DataFrame, Shown]], key: str = "qid") -> DataFrame:
    """(key, text): the blocks of each question, undated tables by name first, then runs in order of time, with an empty line
    between. The text of a question is one value, as long as what it may see: cut views to a budget first."""
    ordered = F.array_sort(F.collect_list(F.struct("run", "table_name", "text")))
    return timeline_blocks(views, key).groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b.text), "\n\n").alias("text"))


def render_context(views: Mapping[str, tuple[DataFrame, Shown]], shown_rows: int, key: str = "qid") -> DataFrame:
    """(key, table_name, visible, text): of each table a heading, how many rows are visible, which of them follow (the latest
    ``shown_rows``), and these as CSV lines under their column names, oldest first."""
    from .ranking import latest_n

    out = None
    for name, (view, shown) in views.items():
        time = shown.clock or shown.position
        some = latest_n(view, shown_rows, time, shown.position, key)
        value = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c, _ in shown.columns]))
        listed = F.transform(F.array_sort(F.collect_list(F.struct(time, shown.position, value.alias("_csv")))), lambda r: r["_csv"])
        each = some.groupBy(key).agg(F.max("total").alias("visible"), F.max("shown").alias("n"), listed.alias("r"))
        told = F.when(F.col("n") < F.col("visible"), F.format_string("Visible rows: %d (latest %d of %d)", "visible", "n", "visible")).otherwise(F.format_string("Visible rows: %d", "visible"))
        head = F.array(F.lit(f"### {name}"), told, F.lit(",".join(c for c, _ in shown.columns)))
        own = each.select(key, F.lit(name).alias("table_name"), "visible", F.array_join(F.concat(head, F.col("r")), "\n").alias("text"))
        out = own if out is None else out.unionByName(own)
    return out
