"""Joins of point-in-time work: parents and children, allow-lists, multisets, ranges, arg-max, set containment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive_code_time(child: DataFrame, parents: DataFrame, keys: Sequence[str], end: str) -> DataFrame:
    """A code row counts one minute before its parent's end; parents (keys, end), one row per key."""
    return child.join(parents.select(*keys, end), list(keys), "left").withColumn("code_time", F.col(end) - F.expr("INTERVAL 1 MINUTE")).drop(end)


def before_marker(text: Column, marker: str = "Physical Exam") -> Column:
    """The text before the first marker; all of it where there is none."""
    return F.substring_index(text, marker, 1)


def visible_parent(child: DataFrame, parent_view: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows per question whose key is among the visible parents; a missing key column leaves none."""
    if not set(keys) <= set(child.columns) & set(parent_view.columns):
        return child.where(F.lit(False))
    on = ["qid", *keys] if "qid" in child.columns else list(keys)
    return child.join(parent_view.select(*on).distinct(), on, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys), list(keys), "left_anti")


def enrich(table: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left lookup. Repeated reference keys multiply rows; Spark broadcasts a reference it knows to be small."""
    return table.join(reference, list(keys), "left")


def linked_allowlist(df: DataFrame, manifest: DataFrame, key: str, ids: str) -> DataFrame:
    """Rows whose id is in the question's list; an empty or null list allows none."""
    allowed = manifest.select("qid", F.explode(ids).alias(key)).distinct()
    return df.join(allowed, key)


def cascade_children(tables: Mapping[str, DataFrame], parent: str, child: str, keys: Sequence[str]) -> DataFrame:
    """Children follow the rows their parent kept; without the parent table they stay."""
    return tables[child].join(tables[parent].select(*keys).distinct(), list(keys), "left_semi") if parent in tables else tables[child]


def blank_future_ids(df: DataFrame, starts: DataFrame, key: str, start: str) -> DataFrame:
    """An encounter id is blanked if every known start of it comes after the row's cutoff."""
    first = starts.groupBy(key).agg(F.min(start).alias("_start"))
    joined = df.join(first, key, "left")
    return joined.select(*[F.when(F.col("_start") > F.col("cutoff"), None).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in df.columns])


def multiset_provenance(view: DataFrame, raw: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Drops view rows that only late raw rows can stand for.

    Per key, with a raw rows available, l late, u unknown (column state) and n view rows: min(n, l) go if
    there are only late ones, else min(l, n - a - u) of what is above a + u. The first in ``order`` go.
    """
    count = lambda s: F.count_if(F.col("state") == s)
    known = raw.groupBy(*keys).agg(count("before").alias("_a"), count("after").alias("_l"), count("unknown").alias("_u"))
    w = Window.partitionBy(*keys)
    x = view.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order))).join(known, list(keys), "left")
    spare = F.col("_n") - F.col("_a") - F.col("_u")
    gone = F.when((F.col("_a") + F.col("_u") == 0), F.least("_n", "_l")).when(spare > 0, F.least("_l", spare)).otherwise(0)
    return x.where(F.col("_i") > F.coalesce(gone, F.lit(0))).drop("_n", "_i", "_a", "_l", "_u")


def order_anchors(rows: DataFrame, anchors: DataFrame, key: str, created: str) -> DataFrame:
    """Rows go only if some linked creation time is late and none is early; unlinked rows stay."""
    linked = anchors.groupBy(key).agg(F.min(created).alias("_first"))
    return rows.join(linked, key, "left").where(F.col("_first").isNull() | (F.col("_first") <= F.col("cutoff"))).drop("_first")


def restore_outcomes(stays: DataFrame, raw: DataFrame, key: str, end: str, columns: Sequence[str]) -> DataFrame:
    """End-of-stay columns of stays that ended by the cutoff."""
    joined = stays.drop(*columns).join(raw.select(key, F.col(end).alias("_end"), *columns), key, "left")
    kept = [c for c in joined.columns if c not in (*columns, "_end")]
    return joined.select(*kept, *[F.when(F.col("_end") <= F.col("cutoff"), F.col(c)).alias(c) for c in columns])


def patient_offset(raw: DataFrame, shifted: DataFrame, keys: Sequence[str], subject: str, time: str) -> DataFrame:
    """The exact shift of each subject in seconds, where all witnesses agree."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    pairs = raw.select(*keys, subject, F.col(time).alias("_a")).join(shifted.select(*keys, F.col(time).alias("_b")), list(keys))
    delta = seconds(F.col("_b")) - seconds(F.col("_a"))
    agreed = pairs.withColumn("_d", delta).groupBy(subject).agg(F.min("_d").alias("shift_seconds"), F.max("_d").alias("_x"), F.count("*").alias("witnesses"))
    return agreed.where(F.col("shift_seconds") == F.col("_x")).drop("_x")


def filter_reports(df: DataFrame, late: DataFrame, row: str, paths: str, path: str) -> DataFrame:
    """Takes late paths out of each row's list; paths of unknown time stay."""
    gone = df.select(row, F.explode(paths).alias(path)).join(late.select(path).distinct(), path).groupBy(row).agg(F.collect_set(path).alias("_late"))
    return df.join(gone, row, "left").withColumn(paths, F.when(F.col("_late").isNull(), F.col(paths)).otherwise(F.array_except(paths, "_late"))).drop("_late")


def target_by_labels(manifest: DataFrame, codes: DataFrame, encounter: str, code: str) -> DataFrame:
    """The encounter whose codes contain all gold labels: the manifest's own if it does, else the only one."""
    sets = codes.groupBy("subject_id", encounter).agg(F.collect_set(code).alias("_codes"))
    fit = manifest.join(sets, "subject_id").where(F.size(F.array_except("gold", "_codes")) == 0)
    per = fit.groupBy("qid").agg(F.count("*").alias("candidates"), F.min(encounter).alias("_only"), F.max(F.when(F.col(encounter) == F.col("own_id"), F.col(encounter))).alias("_own"))
    return manifest.select("qid").join(per, "qid", "left").select("qid", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("_own", F.when(F.col("candidates") == 1, F.col("_only"))).alias("target_id"))


def target_by_interval(manifest: DataFrame, stays: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The stay that ends a second before the cutoff if it is the only one; else the only one around the cutoff."""
    j = manifest.select("qid", "subject_id", "cutoff").join(stays, "subject_id")
    exact = F.col(end) == F.col("cutoff") - F.expr("INTERVAL 1 SECOND")
    around = (F.col(start) < F.col("cutoff")) & (F.col("cutoff") <= F.col(end))
    per = j.groupBy("qid").agg(*[f(F.when(c, F.col(key))).alias(n) for c, a in ((exact, "e"), (around, "r")) for f, n in ((F.count_distinct, f"_{a}n"), (F.min, f"_{a}"))])
    return per.select("qid", F.coalesce(F.when(F.col("_en") == 1, F.col("_e")), F.when(F.col("_rn") == 1, F.col("_r"))).alias("target_id"))


def restore_fields(manifest: DataFrame, upstream: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """missing, mismatch or ok for each manifest row against its upstream row."""
    up = upstream.select(*keys, F.col(field).alias("_up"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(~F.col(field).eqNullSafe(F.col("_up")), "mismatch").otherwise("ok")
    return manifest.join(up, list(keys), "left").withColumn("status", status).drop("_up", "_there")


def latest_in_window(manifest: DataFrame, studies: DataFrame, study: str, time: str, start: str = "start") -> DataFrame:
    """Studies of the last time in [start, cutoff] of each question, as a set."""
    j = manifest.select("qid", "subject_id", "cutoff", start).join(studies.select("subject_id", study, time), "subject_id")
    inside = j.where(F.col(time).between(F.col(start), F.col("cutoff")))
    last = inside.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy(F.desc(time)))).where("_r = 1")
    found = last.groupBy("qid").agg(F.array_sort(F.collect_set(study)).alias("latest"), F.max(time).alias("latest_time"))
    return manifest.select("qid").join(found, "qid", "left")


def verify_against_list(manifest: DataFrame, listing: DataFrame, keys: Sequence[str], flags: Sequence[str], order: str) -> DataFrame:
    """Compares label sets with a one-hot listing, whose first row per key wins: ok, different or missing."""
    first = listing.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1")
    hot = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags])))
    j = manifest.join(first.select(*keys, hot.alias("_hot")), list(keys), "left")
    return j.withColumn("status", F.when(F.col("_hot").isNull(), "missing").when(F.array_sort("labels") == F.col("_hot"), "ok").otherwise("different")).drop("_hot")


def explode_linked(manifest: DataFrame, lists: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per aligned member of the lists, each once."""
    zipped = manifest.select("qid", F.explode(F.arrays_zip(*lists)).alias("_z"))
    return zipped.select("qid", *[F.col(f"_z.{a}").alias(n) for a, n in zip(lists, names, strict=True)]).distinct()


def combine_subsets(reference: DataFrame, parts: Sequence[DataFrame], key: str = "qid") -> DataFrame:
    """Keys with the number of parts that have them; a problem where it is not one or the key is unknown."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionByName(p.select(key))
    n = union.groupBy(key).agg(F.count("*").alias("n"))
    j = reference.select(key, F.lit(True).alias("_r")).join(n, key, "full")
    problem = F.when(F.col("_r").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return j.select(key, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem"))


def asset_presence(manifest: DataFrame, paths: str, listing: DataFrame) -> DataFrame:
    """Paths that are absolute or not in the listing (path)."""
    each = manifest.select("qid", F.explode(paths).alias("path"))
    return each.join(listing.select("path").distinct(), "path", "left_anti").select("qid", "path", F.when(F.col("path").startswith("/"), "absolute").otherwise("absent").alias("problem"))


def blocks(headers: DataFrame, keys: Sequence[str], start: str = "start") -> DataFrame:
    """Timed blocks end where the next begins; the last has no end."""
    return headers.withColumn("stop", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def select_blocks(pool: DataFrame, chosen: DataFrame, keys: Sequence[str], anchor: str) -> DataFrame:
    """Pool rows whose anchor lies in a chosen block [start, stop); the last block runs to the cutoff
    inclusive; a block without start takes rows without anchor."""
    a = F.col(anchor)
    inside = (a >= F.col("start")) & F.when(F.col("stop").isNotNull(), a < F.col("stop")).otherwise(a <= F.col("cutoff"))
    j = pool.join(chosen.select(*keys, "start", "stop"), list(keys))
    return j.where(inside | (F.col("start").isNull() & a.isNull())).drop("start", "stop")
