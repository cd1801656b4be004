"""Policies: what each table needs for its point-in-time view, as plain objects compiled to one plan.

Tables may be text throughout: every clock is parsed under its column's name, so that a bare date of a day
column means the end of that day and junk is no time. A table, column or mask that no policy or allow-list
names is an error before any job runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleanse import allow_rows, availability_time, before, coalesce_times, guard_completion, guard_field, null_sentinels, parse_time, present, require_nonempty
from ..operators.asof import attach, mask_target


@dataclass(frozen=True)
class FieldGuard:
    """``field`` is null unless one of its own clocks, by ``mode``, is before the cutoff."""

    field: str
    available: tuple[str, ...]
    mode: str = "coalesce"


@dataclass(frozen=True)
class TablePolicy:
    """A table with clocks of its own; without any, all rows of the subject are seen."""

    event: tuple[str, ...] = ()
    available: tuple[str, ...] = ()
    available_mode: str = "latest"
    guards: tuple[FieldGuard, ...] = ()
    completion: tuple[str, ...] = ()
    completion_fields: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChildPolicy:
    """A table whose rows follow the visible rows of a parent; with ``offset_seconds`` they come that much
    after the parent's time, under the name ``derived``, and must themselves be before the cutoff."""

    parent: str
    keys: tuple[str, ...]
    parent_time: str | None = None
    offset_seconds: int = 0
    drop: tuple[str, ...] = ()
    derived: str = "derived_time"
    keep: tuple[str, ...] = ()
    allow_column: str | None = None
    allow_values: tuple[str, ...] = ()
    require: tuple[str, ...] = ()


@dataclass(frozen=True)
class MaskPolicy:
    """For questions of these tasks, rows whose ``key`` is the manifest's ``target`` are never shown."""

    tasks: tuple[str, ...]
    key: str
    target: str


def clock_like(name: str) -> bool:
    low = name.lower()
    return "time" in low or "date" in low or low == "dod"


def _times(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [parse_time(F.col(c), c) for c in names if c in df.columns]


def validate(tables: Mapping[str, DataFrame], policies: Mapping[str, TablePolicy | ChildPolicy], allowed: Mapping[str, Sequence[str]]) -> None:
    """Fails before any job runs: unknown tables, tables without an allow-list, unknown columns, clocks, guards'
    clocks or keys that are not there, and parents without a policy."""
    problems = [f"unknown table {t}" for t in tables if t not in policies]
    for name, df in tables.items():
        own = set(df.columns)
        if name in policies and name not in allowed:
            problems.append(f"no allow-list for {name}")
        problems += [f"unknown column {name}.{c}" for c in sorted(own - set(allowed.get(name, own)))]
        policy = policies.get(name)
        if isinstance(policy, ChildPolicy):
            problems += [f"missing column {name}.{c}" for c in policy.keys if c not in own]
            problems += [f"unknown parent {policy.parent} of {name}"] * (policy.parent not in policies)
        elif policy:
            clocks = [policy.event, policy.available, *[g.available for g in policy.guards if g.field in own]]
            problems += [f"missing column {name}.{c[0]}" for c in clocks if c and not own & set(c)]
    if problems:
        raise ValueError("; ".join(problems))


def _changes(view: DataFrame, policy: TablePolicy) -> dict[str, Column]:
    """What completion, guards and the last check of all clocks leave of each column that they touch."""
    cutoff = F.col("cutoff")
    changed: dict[str, Column] = {}
    if policy.completion_fields:
        complete = _times(view, policy.completion) if set(policy.completion) <= set(view.columns) else []
        changed |= guard_completion([f for f in policy.completion_fields if f in view.columns], complete, cutoff)
    for g in policy.guards:
        if g.field in view.columns:
            times = _times(view, g.available)
            safe = availability_time(times, g.mode) if times else F.lit(None).cast("timestamp_ntz")
            changed[g.field] = guard_field(changed.get(g.field, F.col(g.field)), safe, cutoff)
    for c in view.columns:
        if clock_like(c):
            changed[c] = guard_field(changed.get(c, F.col(c)), parse_time(F.col(c), c), cutoff)
    return changed


def _seen(view: DataFrame, policy: TablePolicy) -> Column:
    happened, known = F.lit(True), F.lit(True)
    if policy.event:
        happened = before(coalesce_times(*_times(view, policy.event)), F.col("cutoff"))
    if policy.available:
        known = before(availability_time(_times(view, policy.available), policy.available_mode), F.col("cutoff"))
    return happened & known


def _attached(df: DataFrame, manifest: DataFrame, policy: TablePolicy, cut: bool) -> DataFrame:
    """Rows with the questions of their subject; with ``cut``, first those that the last of these can see."""
    clean = null_sentinels(df)
    if not (cut and policy.event):
        return attach(clean, manifest)
    reached = clean.withColumn("_event", coalesce_times(*_times(clean, policy.event)))
    return attach(reached, manifest, "_event").drop("_event")


def table_view(df: DataFrame, manifest: DataFrame, policy: TablePolicy) -> DataFrame:
    """Order of steps: missing-value texts, event clock, availability clock, completion, guards, drops, and a
    last check by which every column named like a time loses values that are no time before the cutoff."""
    view = _attached(df, manifest, policy, cut=True)
    changed = _changes(view, policy)
    return view.where(_seen(view, policy)).select(*[changed[c].alias(c) if c in changed else F.col(c) for c in view.columns if c not in policy.drop])


def table_report(df: DataFrame, manifest: DataFrame, policy: TablePolicy) -> DataFrame:
    """Per question: input, output and dropped rows, and of the rows that stay the values that go: all, those that
    are times at or after the cutoff, and those that are no times."""
    view = _attached(df, manifest, policy, cut=False)
    changed = _changes(view, policy)
    seen, none = _seen(view, policy), F.lit(0)
    count = lambda flags: reduce(Column.__add__, [f.cast("int") for f in flags], none)
    gone = [present(F.col(c)) & ~present(changed[c]) for c in changed if c not in policy.drop] + [present(F.col(c)) for c in policy.drop if c in view.columns]
    clocks = [(c, parse_time(F.col(c), c)) for c in view.columns if clock_like(c) and c not in policy.drop]
    late = [F.coalesce(t >= F.col("cutoff"), F.lit(False)) for _, t in clocks]
    broken = [present(F.col(c)) & t.isNull() for c, t in clocks]
    told = view.select("qid", seen.alias("seen"), *[F.when(seen, count(x)).otherwise(0).alias(n) for n, x in (("redacted", gone), ("future", late), ("unparseable", broken))])
    sums = [F.sum(c).alias(c) for c in ("redacted", "future", "unparseable")]
    return told.groupBy("qid").agg(F.count("*").alias("input_rows"), F.count_if("seen").alias("output_rows"), F.count_if(~F.col("seen")).alias("dropped_rows"), *sums)


def child_view(child: DataFrame, parent_view: DataFrame, policy: ChildPolicy) -> DataFrame:
    """Child rows of visible parents, per question. Keys whose parents disagree on the time are left out."""
    keys, child = list(policy.keys), null_sentinels(child)
    if policy.parent_time is None:
        view = child.join(parent_view.select("qid", "cutoff", *keys).distinct(), keys)
    else:
        t = parse_time(F.col(policy.parent_time), policy.parent_time)
        times = parent_view.groupBy("qid", "cutoff", *keys).agg(F.min(t).alias("_first"), F.max(t).alias("_last")).where(F.col("_first") == F.col("_last"))
        timed = times.withColumn(policy.derived, F.col("_first") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(policy.offset_seconds)))
        view = child.drop(policy.derived).join(timed.where(before(F.col(policy.derived), F.col("cutoff"))).drop("_first", "_last"), keys)
    if policy.allow_column:
        view = allow_rows(view, policy.allow_column, policy.allow_values)
    if policy.require:
        view = require_nonempty(view, policy.require)
    if policy.keep:
        view = view.select(*[c for c in view.columns if c in (*policy.keep, "qid", "cutoff")])
    view = view.drop(*policy.drop)
    return view.select(*[guard_field(F.col(c), parse_time(F.col(c), c), F.col("cutoff")).alias(c) if clock_like(c) else F.col(c) for c in view.columns])


def point_in_time_view(
    tables: Mapping[str, DataFrame],
    manifest: DataFrame,
    policies: Mapping[str, TablePolicy | ChildPolicy],
    allowed: Mapping[str, Sequence[str]],
    constraints: Mapping[str, ChildPolicy] | None = None,
    masks: Mapping[str, MaskPolicy] | None = None,
) -> dict[str, DataFrame]:
    """One lazy plan per table for all questions. A parent may itself be a child. ``constraints`` tie tables with
    clocks of their own to visible parents; ``masks`` hide the target's rows for good, and a question of a
    masked task without a target is an error of its query."""
    validate(tables, policies, allowed)
    done: dict[str, DataFrame] = {}

    def masked(name: str, view: DataFrame) -> DataFrame:
        rule = (masks or {}).get(name)
        if rule is None:
            return view
        targets = manifest.where(F.col("task").isin(*rule.tasks)).select("qid", F.col(rule.target).alias("target_id"))
        return mask_target(view, targets, rule.key)

    def build(name: str) -> DataFrame:
        if name not in done:
            policy = policies[name]
            if isinstance(policy, TablePolicy):
                view = table_view(tables[name], manifest, policy)
                if rule := (constraints or {}).get(name):
                    view = view.join(build(rule.parent).select("qid", *rule.keys).distinct(), ["qid", *rule.keys], "left_semi")
            elif policy.parent in tables:
                view = child_view(tables[name], build(policy.parent), policy)
            else:
                view = child_view(tables[name], manifest.select("qid", "cutoff", *[F.lit(None).cast("string").alias(k) for k in policy.keys]).where("false"), ChildPolicy(policy.parent, policy.keys, keep=policy.keep))
            done[name] = masked(name, view)
        return done[name]

    return {name: build(name) for name in tables}


def audit_views(views: Mapping[str, DataFrame], policies: Mapping[str, TablePolicy | ChildPolicy], constraints: Mapping[str, ChildPolicy] | None = None, forbidden: Sequence[str] = ("label", "ground_truth", "prediction", "answer")) -> DataFrame:
    """(table_name, rule, n) of what a set of views must not hold, one row per rule that is broken: times at or
    after the cutoff, values of time columns that are none, keys without a visible parent. Columns that a policy
    drops or that give the answer away are an error at once."""
    out = None
    for name, view in views.items():
        policy = policies.get(name)
        wrong = sorted(set(view.columns) & {*forbidden, *(policy.drop if policy else ())})
        if policy is None or wrong:
            raise ValueError(f"{name}: " + (f"columns {wrong}" if policy else "no policy"))
        clocks = [(c, parse_time(F.col(c), c)) for c in view.columns if clock_like(c)]
        rules = {f"future {c}": F.coalesce(t >= F.col("cutoff"), F.lit(False)) for c, t in clocks} | {f"unparseable {c}": present(F.col(c)) & t.isNull() for c, t in clocks}
        parts = []
        if rules:
            counts = view.agg(*[F.count_if(f).alias(r) for r, f in rules.items()])
            parts.append(counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in rules]), F.array(*[F.col(f"`{r}`") for r in rules]))).alias("rule", "n")))
        tie = policy if isinstance(policy, ChildPolicy) else (constraints or {}).get(name)
        if tie and tie.parent in views and set(tie.keys) <= set(view.columns):
            orphans = view.join(views[tie.parent].select("qid", *tie.keys), ["qid", *tie.keys], "left_anti")
            parts.append(orphans.agg(F.lit(f"no visible {tie.parent}").alias("rule"), F.count("*").alias("n")))
        for part in parts:
            own = part.where("n > 0").select(F.lit(name).alias("table_name"), "rule", "n")
            out = own if out is None else out.unionByName(own)
    return out


#: The tables of the two image-question sets.
IMAGE_EVENT_TABLES = {"events", "stays", "tb_cxr"}
IMAGE_HOSPITAL_TABLES = {"admissions", "chartevents", "cost", "diagnoses_icd", "icustays", "inputevents", "labevents", "microbiologyevents", "outputevents", "patients", "prescriptions", "procedures_icd", "tb_cxr", "transfers"}


def route_schema(columns: Mapping[str, Sequence[str]]) -> str:
    """The policy family that a set of tables belongs to, by their names and columns. Further tables do not
    change it; parts of the hospital set count if their rows are numbered."""
    names = set(columns)
    if names >= IMAGE_EVENT_TABLES:
        return "medmod"
    if names >= {"admissions", "patients", "tb_cxr"} or names and names <= IMAGE_HOSPITAL_TABLES and any("row_id" in c for c in columns.values()):
        return "ehrxqa"
    return "strict" if "anchor_year" in columns.get("patients", ()) or names & {"emar", "edstays"} else "legacy"


def read_allowed(dictionary: DataFrame) -> dict[str, list[str]]:
    """Allow-lists from a data dictionary (table_name, column_name); it has one row per column, not per record."""
    rows = dictionary.groupBy("table_name").agg(F.collect_set("column_name").alias("c")).collect()
    return {r["table_name"]: sorted(r["c"]) for r in rows}

