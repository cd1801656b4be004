"""As-of filters: what of a record table was there for each question of a manifest.

The manifest (qid, subject_id, cutoff, ...) is data. Records are first cut down by the last cutoff of
their subject, so the join with several questions per subject multiplies only rows that some question
can see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleanse import before, normalize_id, parse_time, tri_state


def attach(records: DataFrame, manifest: DataFrame, time: str | None = None, subject: str = "subject_id", columns: Sequence[str] = ("qid", "cutoff"), inclusive: bool = False) -> DataFrame:
    """Records with the questions of their subject; with ``time``, only records that one of them can reach."""
    if time:
        last = manifest.groupBy(subject).agg(F.max("cutoff").alias("_last"))
        reach = F.col(time) <= F.col("_last") if inclusive else F.col(time) < F.col("_last")
        records = records.join(last, subject).where(reach).drop("_last")
    return records.join(manifest.select(subject, *columns), subject)


def as_of_event(records: DataFrame, manifest: DataFrame, event: str = "event_time", **options) -> DataFrame:
    return attach(records, manifest, event, **options).where(before(F.col(event), F.col("cutoff")))


def as_of_available(records: DataFrame, manifest: DataFrame, event: str = "event_time", available: str = "available_time", **options) -> DataFrame:
    return as_of_event(records, manifest, event, **options).where(before(F.col(available), F.col("cutoff")))


def as_of_inclusive(records: DataFrame, manifest: DataFrame, time: str, **options) -> DataFrame:
    if time not in records.columns:
        raise ValueError(f"no column {time}")
    return attach(records, manifest, time, inclusive=True, **options).where(F.col(time) <= F.col("cutoff"))


def redact_after(c: Column, time: Column, cutoff: Column) -> Column:
    return F.when(time <= cutoff, c)


def view_report(records: DataFrame, manifest: DataFrame, event: str = "event_time", available: str = "available_time") -> DataFrame:
    """input, output and dropped rows of each question, and why they went."""
    seen = attach(records, manifest)
    happened = before(F.col(event), F.col("cutoff"))
    known = before(F.col(available), F.col("cutoff"))
    return seen.groupBy("qid").agg(
        F.count("*").alias("input_rows"),
        F.count_if(happened & known).alias("output_rows"),
        F.count_if(~happened).alias("not_yet_happened"),
        F.count_if(happened & ~known).alias("not_yet_known"),
    )


def legacy_view(records: DataFrame, manifest: DataFrame, subject: str = "subject_id") -> DataFrame:
    """For comparison only: the first column named like a time filters; without one, all rows pass."""
    named = [c for c in records.columns if "time" in c.lower() or "date" in c.lower()]
    both = records.join(manifest.select(subject, "qid", "cutoff"), subject)
    return both.where(F.col(named[0]) <= F.col("cutoff")) if named else both


def clamp_cutoff(manifest: DataFrame, policy: Column) -> DataFrame:
    return manifest.withColumn("cutoff", F.least("cutoff", policy))


def clamp_range(records: DataFrame, start: Column, end: Column, time: str = "event_time") -> DataFrame:
    """Rows of [start, end] before the cutoff; a range that starts after its end is an error of the question."""
    bad = F.raise_error(F.lit("start is after end"))
    asked = F.when(start > end, bad.cast("boolean")).otherwise(F.col(time).between(start, end))
    return records.where(asked & (F.col(time) < F.col("cutoff")))


def availability_states(rows: DataFrame, clocks: Sequence[str], key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """Rows with state: after if one of the clocks is proven to come after the cutoff, else before if one is known
    to come before it, else unknown; and per question how many rows are in each state."""
    states = F.array(*[tri_state(F.col(c), F.col("cutoff")) for c in clocks])
    state = F.when(F.array_contains(states, "after"), "after").when(F.array_contains(states, "before"), "before").otherwise("unknown")
    stated = rows.withColumn("state", state)
    counts = stated.groupBy(key).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("before", "after", "unknown")])
    return stated, counts


def drop_proven_late(stated: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], key: str = "qid") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows that are not proven late, and of each child table (rows, keys) those whose parent is not."""
    late = stated.where("state = 'after'")
    kept = {n: df.join(late.select(key, *keys).distinct(), [key, *keys], "left_anti") for n, (df, keys) in children.items()}
    return stated.where("state <> 'after'"), kept


def resolve_episode(manifest: DataFrame, episodes: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """manifest (qid, subject_id, cutoff, episode_id), episodes (subject_id, episode_id, end_time): the
    cutoff becomes the episode's end + 1 s where exactly one episode of that id ends on the cutoff's day;
    else problem says why. A missing id is taken from the only one of ``notes`` (subject_id, episode_id,
    charttime) written a second before the cutoff; without notes, from the only episode that ends then."""
    second = F.expr("INTERVAL 1 SECOND")
    ends = episodes.select("subject_id", F.col("episode_id").alias("_id"), "end_time")
    hints = ends if notes is None else notes.select("subject_id", F.col("episode_id").alias("_id"), F.col("charttime").alias("end_time"))
    guess = manifest.join(hints, "subject_id").where(F.col("end_time") == F.col("cutoff") - second)
    guess = guess.groupBy("qid").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("_guess"))
    named = manifest.join(guess, "qid", "left").withColumn("resolved_id", F.coalesce("episode_id", F.when(F.col("_n") == 1, F.col("_guess"))))
    found = named.join(ends.withColumnRenamed("subject_id", "_s"), (F.col("subject_id") == F.col("_s")) & (F.col("resolved_id") == F.col("_id")), "left")
    one = found.groupBy("qid", "subject_id", "cutoff", "resolved_id").agg(F.count_distinct("end_time").alias("ends"), F.min("end_time").alias("end_time"))
    day = F.to_date("end_time") == F.to_date("cutoff")
    problem = F.when(F.col("resolved_id").isNull(), "no episode").when(F.col("ends") != 1, "end not unique").when(~day, "ends on another day")
    return one.select("qid", "subject_id", "resolved_id", problem.alias("problem"), F.when(problem.isNull(), F.col("end_time") + second).alias("cutoff"))


def mask_target(view: DataFrame, manifest: DataFrame, key: str, enabled: bool = True) -> DataFrame:
    """Without the rows of each question's target; or, if disabled, with would_mask in their place. manifest has
    the questions that need a mask, with target_id; one that is missing is an error of the query, as nothing
    would hide its rows. Ids compare as texts: "123", 123 and "123.0" are one."""
    if key not in view.columns:
        raise ValueError(f"no column {key} to mask by")
    missing = F.raise_error(F.concat(F.lit("no target for question "), F.col("qid").cast("string"))).cast("string")
    target = F.coalesce(normalize_id(F.col("target_id")), missing)
    targets = manifest.select("qid", target.alias("_target")).distinct()
    marked = view.join(targets, "qid", "left").withColumn("_hit", F.coalesce(normalize_id(F.col(key)) == F.col("_target"), F.lit(False))).drop("_target")
    return marked.where(~F.col("_hit")).drop("_hit") if enabled else marked.withColumnRenamed("_hit", "would_mask")


def restore_note(view: DataFrame, notes: DataFrame, episodes: DataFrame, key: str = "episode_id", time: str = "charttime", stored: str = "storetime", derived: str = "episode_available_time") -> DataFrame:
    """The note of each question's index episode, which is part of the task even where it was stored later.
    episodes: (qid, cutoff, resolved_id), as from ``resolve_episode``. Such a note takes the place of the same
    episode's notes in the view; a store time that is not before the cutoff is null, and ``derived`` has the
    episode's end, a second before the cutoff."""
    known = episodes.where(F.col("resolved_id").isNotNull() & F.col("cutoff").isNotNull()).select("qid", F.col("cutoff").alias("_cutoff"), normalize_id(F.col("resolved_id")).alias("_id"))
    named = notes.withColumn("_id", normalize_id(F.col(key))).join(known, "_id").where(before(parse_time(F.col(time), time), F.col("_cutoff")))
    own = {stored: F.when(before(parse_time(F.col(stored), stored), F.col("_cutoff")), F.col(stored))} if stored in notes.columns else {}
    note = named.withColumns(own).withColumn("cutoff", F.col("_cutoff")).withColumn(derived, F.col("_cutoff") - F.expr("INTERVAL 1 SECOND")).drop("_cutoff", "_id")
    others = view.withColumn("_id", normalize_id(F.col(key))).join(note.select("qid", normalize_id(F.col(key)).alias("_id")).distinct(), ["qid", "_id"], "left_anti").drop("_id")
    return others.unionByName(note, allowMissingColumns=True)


def modality_gate(manifest: DataFrame, modalities: str = "modalities") -> DataFrame:
    """Questions whose modalities include records."""
    return manifest.where(F.arrays_overlap(F.transform(modalities, F.lower), F.array(*[F.lit(x) for x in ("ehr", "ehr_table", "clinical_ehr")])))
