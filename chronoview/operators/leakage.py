"""Leakage of saved runs: what a record held too early, which calls touched it, and which of them showed it.

A view is the record of each question as a run could read it (unsafe). Rules say which of its rows or cells could not be
known at the cutoff: without them it is the safe view. Both are columns of one table, so each recorded call is
replayed on both by one join. Results are compared by fingerprints, which add up over rows in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of calls that can be replayed.
KINDS = ("keyword", "value", "range", "latest", "count")
CALL = ("qid", "call_id", "kind", "table_name", "column_name", "argument", "start", "stop", "observed")


@dataclass(frozen=True)
class Leak:
    """Rows for which ``late`` holds were not known at the cutoff: the row goes, or ``column`` alone is emptied.
    Leaks that are not ``confirmed`` (plans, ongoing intervals) are counted and leave the view as it is."""

    category: str
    detail: str
    late: Column
    column: str | None = None
    confirmed: bool = True


def _holds(rule: Leak) -> Column:
    return F.coalesce(rule.late, F.lit(False))


def confirmed_leaks(views: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Leak]]) -> DataFrame:
    """(qid, table_name, category, detail, confirmed, n): rows of each question under each rule, all rules of a
    table in one pass. Level 0."""
    parts = None
    for table, own in rules.items():
        counts = views[table].groupBy("qid").agg(*[F.count_if(_holds(r)).alias(f"_{i}") for i, r in enumerate(own)])
        each = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.detail).alias("detail"), F.lit(r.confirmed).alias("confirmed"), F.col(f"_{i}").alias("n")) for i, r in enumerate(own)])
        found = counts.select("qid", F.lit(table).alias("table_name"), F.explode(each).alias("_l")).select("qid", "table_name", "_l.*").where("n > 0")
        parts = found if parts is None else parts.unionByName(found)
    return parts


def safe_view(view: DataFrame, rules: Sequence[Leak]) -> DataFrame:
    """The view without what the confirmed rules find."""
    sure = [r for r in rules if r.confirmed]
    blank = {}
    for r in sure:
        if r.column is not None:
            blank[r.column] = blank.get(r.column, F.lit(False)) | _holds(r)
    gone = F.lit(False)
    for r in sure:
        if r.column is None:
            gone = gone | _holds(r)
    return view.where(~gone).select(*[F.when(~blank[c], F.col(c)).alias(c) if c in blank else F.col(c) for c in view.columns])


def _both(view: DataFrame, table: str, rules: Sequence[Leak], columns: Sequence[str], clock: str) -> DataFrame:
    """(qid, table_name, kept, and of both views: cells (map of texts), text, at): a row as each view shows it."""
    sure = [r for r in rules if r.confirmed]
    gone = F.lit(False)
    for r in sure:
        if r.column is None:
            gone = gone | _holds(r)

    def shown(c: str, safe: bool) -> Column:
        late = [r for r in sure if safe and r.column == c]
        value = F.col(c)
        for r in late:
            value = F.when(~_holds(r), value)
        return value

    def of(safe: bool) -> list[Column]:
        text = [F.coalesce(shown(c, safe).cast("string"), F.lit("")) for c in columns]
        name = "safe" if safe else "unsafe"
        cells = F.create_map(*[x for c, t in zip(columns, text, strict=True) for x in (F.lit(c), t)])
        return [cells.alias(f"{name}_cells"), F.concat_ws("|", *text).alias(f"{name}_text"), shown(clock, safe).cast("timestamp_ntz").alias(f"{name}_at")]

    return view.select("qid", F.lit(table).alias("table_name"), (~gone).alias("kept"), *of(False), *of(True))


def _fingerprint(text: Column, hit: Column) -> list[Column]:
    """Number of rows and sum of the first 32 bits of their MD5, which no order of rows changes."""
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return [F.count_if(hit), F.coalesce(F.sum(F.when(hit, bits)), F.lit(0))]


def replay(calls: DataFrame, views: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Leak]], columns: Mapping[str, Sequence[str]], clocks: Mapping[str, str]) -> DataFrame:
    """``calls`` with n_unsafe, n_safe, unsafe and safe: how many rows each returns on both views, and their fingerprints.

    calls: qid, call_id, kind, table_name, column_name, argument, start, stop; further columns stay. Kinds:
    ``keyword`` (rows with the argument in any cell, in any case), ``value`` (rows whose cell is the argument, without
    outer spaces), ``range`` (rows from start to stop, both included), ``latest`` (rows of the last time that
    the view has), ``count`` (as range, of which only the number of rows is seen). Calls of other kinds or of
    tables that no view has return null. A call that matches nothing has the fingerprint of no rows.
    """
    parts = None
    for table, view in views.items():
        own = _both(view, table, rules.get(table, ()), columns[table], clocks[table])
        parts = own if parts is None else parts.unionByName(own)
    last = parts.groupBy("qid", "table_name").agg(F.max("unsafe_at").alias("unsafe_last"), F.max(F.when(F.col("kept"), F.col("safe_at"))).alias("safe_last"))
    known = calls.where(F.col("kind").isin(*KINDS)).select(*CALL[:-1]).join(last, ["qid", "table_name"], "left")
    met = known.join(parts, ["qid", "table_name"])

    def hit(name: str) -> Column:
        cells, at = F.col(f"{name}_cells"), F.col(f"{name}_at")
        keyword = F.contains(F.lower(F.col(f"{name}_text")), F.lower("argument"))
        value = F.trim(F.element_at(cells, F.col("column_name"))) == F.trim("argument")
        between = at.between(F.col("start"), F.col("stop"))
        of = F.when(F.col("kind") == "keyword", keyword).when(F.col("kind") == "value", value).when(F.col("kind") == "latest", at == F.col(f"{name}_last")).otherwise(between)
        return F.coalesce(of, F.lit(False))

    named = []
    for name, allowed in (("unsafe", F.lit(True)), ("safe", F.col("kept"))):
        n, bits = _fingerprint(F.col(f"{name}_text"), hit(name) & allowed)
        named += [n.alias(f"n_{name}"), bits.alias(f"_{name}")]
    counted = met.groupBy("qid", "call_id").agg(*named)
    names = F.array(*[F.lit(t) for t in views])
    fits = F.col("kind").isin(*KINDS) & F.array_contains(names, F.col("table_name"))
    out = calls.join(counted, ["qid", "call_id"], "left")
    for name in ("unsafe", "safe"):
        n = F.coalesce(F.col(f"n_{name}"), F.lit(0))
        shown = F.concat_ws(":", n, F.when(F.col("kind") != "count", F.coalesce(F.col(f"_{name}"), F.lit(0))))
        out = out.withColumn(f"n_{name}", F.when(fits, n)).withColumn(name, F.when(fits, shown))
    return out.drop("_unsafe", "_safe")


def call_levels(replayed: DataFrame, leaks: DataFrame) -> DataFrame:
    """``replayed`` with touched (level 1: the call's table holds a confirmed leak of its question) and exposed (level
    2: what was observed is the unsafe result, and the safe one differs)."""
    leaky = leaks.where("confirmed").select("qid", "table_name").distinct().withColumn("touched", F.lit(True))
    seen = replayed.join(leaky, ["qid", "table_name"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    exposed = (F.col("observed") == F.col("unsafe")) & (F.col("unsafe") != F.col("safe"))
    return seen.withColumn("exposed", F.coalesce(exposed, F.lit(False)))


def leakage_levels(manifest: DataFrame, leaks: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a question: rows of confirmed and of other leaks, calls that touched and that exposed them, calls
    replayed otherwise than observed, and its level (null where nothing has leaked, else 0, 1 or 2)."""
    of = leaks.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("confirmed"), F.col("n"))), F.lit(0)).alias("n_confirmed"), F.coalesce(F.sum(F.when(~F.col("confirmed"), F.col("n"))), F.lit(0)).alias("n_other"))
    seen = calls.groupBy("qid").agg(F.count_if("touched").alias("l1_calls"), F.count_if("exposed").alias("l2_calls"), F.count_if(F.col("observed") != F.col("unsafe")).alias("mismatches"))
    out = manifest.select("qid").join(of, "qid", "left").join(seen, "qid", "left")
    out = out.select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_confirmed", "n_other", "l1_calls", "l2_calls", "mismatches")])
    level = F.when(F.col("l2_calls") > 0, 2).when(F.col("l1_calls") > 0, 1).when(F.col("n_confirmed") > 0, 0)
    return out.withColumn("level", level)
