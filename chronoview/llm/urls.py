"""URL filters as a range join between urls and rules.

A host written from its last label on ("net.example.blog.") is a key under which a rule's host covers one
interval: its own key and all that continue it. Urls and rules are dealt into ranges of keys; within each,
one sweep in key order keeps a stack of the rules whose interval holds the current key. Intervals of
different rules are nested or apart, so the stack is all there is to look at.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Keys looked at for each boundary between ranges, and ranges at most.
SAMPLED, RANGES = 20, 8192
#: Ends the interval of a prefix: above every character of a key.
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or the end, with A-Z lowered; "" where absent."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; "" where absent."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def boundaries(keys: DataFrame, rows_per_range: int) -> list[str]:
    """Keys that cut the table into ranges of about ``rows_per_range`` rows, from a sample by hash; the
    driver gets about SAMPLED * RANGES keys at most, whatever the table's size."""
    n = keys.count()
    ranges = max(1, min(RANGES, math.ceil(n / rows_per_range)))
    if ranges == 1:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    some = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).collect())
    return [some[k * len(some) // ranges] for k in range(1, ranges)] if some else []


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", tie: str = "page_id", default: str = "allow", rows_per_range: int = 4000) -> DataFrame:
    """Adds host, path, rule (host and path of the rule that decides, else null) and verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with
    the rule's; of several the longest host and path wins, then the longer host. A url that is null or has
    no "://" has empty host and path and no rule. Rows stay as they are, repeated ones too; input columns
    of the added names are replaced. ``tie`` spreads the rows of one host over ranges.
    """
    base = without(urls, "host", "path", "rule", "verdict")
    parsed = base.select(F.struct(*[f"`{c}`" for c in base.columns]).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.xxhash64(tie, url).alias("spread"))
    keyed = parsed.withColumn("key", F.concat(host_key(F.col("host")), F.lit(" "), F.lpad(F.hex("spread"), 16, "0")))
    cuts = boundaries(keyed.select("key"), rows_per_range)

    def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last range that a row belongs to."""
        for batch in batches:
            first = [bisect.bisect_right(cuts, k) for k in batch.column(batch.schema.get_field_index("low")).to_pylist()]
            last = [bisect.bisect_right(cuts, k) for k in batch.column(batch.schema.get_field_index("high")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*batch.schema.names, "first", "last"])

    row_type = parsed.schema["row"].dataType.simpleString()
    low = host_key(F.lower("host"))
    rule = rules.select(low.alias("low"), F.concat(low, F.lit(LAST)).alias("high"), F.lit(0).alias("kind"), F.col("host"), F.col("path"), F.col("verdict"), F.lit(None).cast(row_type).alias("row"))
    page = keyed.select(F.col("key").alias("low"), F.col("key").alias("high"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), "row")
    ddl = f"low string, high string, kind int, host string, path string, verdict string, row {row_type}, first int, last int"
    dealt = rule.unionByName(page).mapInArrow(ranges_of, ddl).withColumn("range", F.explode(F.sequence("first", "last")))
    parts = len(cuts) + 1
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "low", "kind", "high")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            get = lambda n, b=batch: b.column(b.schema.get_field_index(n)).to_pylist()
            kept, rule_of, verdicts = [], [], []
            for i, (where, key, kind, high, host, path, verdict) in enumerate(zip(get("range"), get("low"), get("kind"), get("high"), get("host"), get("path"), get("verdict"), strict=True)):
                if where != at:
                    at, stack = where, []
                while stack and stack[-1][0] < key:
                    stack.pop()
                if kind == 0:
                    stack.append((high, host, path, verdict))
                    continue
                fits = [(len(h + p), len(h), h + p, v) for _, h, p, v in stack if path.startswith(p)]
                best = max(fits, default=(0, 0, None, default))
                kept.append(i)
                rule_of.append(best[2])
                verdicts.append(best[3])
            part = batch.take(pa.array(kept, pa.int64()))
            columns = [part.column(part.schema.get_field_index(n)) for n in ("row", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule_of, pa.string()), pa.array(verdicts, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    swept = ordered.mapInArrow(sweep, f"row {row_type}, host string, path string, rule string, verdict string")
    return swept.select("row.*", "host", "path", "rule", "verdict")
