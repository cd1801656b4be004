"""Views for image questions: inclusive cutoffs, scans that the question links, and records only where its
modalities include them. Fixed values: names of tables, clocks and outcome columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleanse import NTZ, normalize_id, null_sentinels, parse_time_by_value
from ..operators.asof import attach, modality_gate, redact_after
from .policies import route_schema

OUTCOMES = ("last_careunit", "outtime", "los", "dischtime", "deathtime", "dod", "mortality_inunit", "mortality", "mortality_inhospital")


@dataclass(frozen=True)
class ImagePolicy:
    """Rows up to the cutoff by the first of ``clock`` that there is; ``redact``: times that are null after it;
    ``gated``: fields that are null until another column's time; ``drop``: columns that go."""

    clock: tuple[str, ...] = ()
    redact: tuple[str, ...] = ()
    gated: tuple[tuple[str, str], ...] = ()
    drop: tuple[str, ...] = ()


EVENTS = {"events": ImagePolicy(("charttime",)), "stays": ImagePolicy(("intime",), drop=OUTCOMES)}
_STAY = ImagePolicy(("intime",), redact=("outtime",), gated=(("last_careunit", "outtime"),))
HOSPITAL = {
    "admissions": ImagePolicy(("admittime",), gated=tuple((c, "dischtime") for c in ("dischtime", "deathtime", "discharge_location", "hospital_expire_flag"))),
    "prescriptions": ImagePolicy(("starttime",), redact=("stoptime",)),
    "transfers": _STAY,
    "icustays": _STAY,
    "labevents": ImagePolicy(("charttime",)),
    "chartevents": ImagePolicy(("charttime",)),
    "outputevents": ImagePolicy(("charttime",)),
    "inputevents": ImagePolicy(("starttime",), redact=("endtime",)),
    "microbiologyevents": ImagePolicy(("charttime", "chartdate")),
    "cost": ImagePolicy(("chargetime",)),
    "patients": ImagePolicy(redact=("dod",)),
}
CODED = ("diagnoses_icd", "procedures_icd")
SCANS = "tb_cxr"


def _plain(c: str) -> Column:
    """A time as it stands; a bare date is its midnight."""
    return F.col(c).try_cast(NTZ)


def inclusive_view(df: DataFrame, manifest: DataFrame, policy: ImagePolicy) -> DataFrame:
    """Rows up to the cutoff, without what came to be known later. A clock that is not there is an error."""
    clean = null_sentinels(df)
    named = next((c for c in policy.clock if c in clean.columns), None)
    if policy.clock and named is None:
        raise ValueError(f"no column {policy.clock[0]}")
    if named:
        timed = clean.withColumn(named, parse_time_by_value(F.col(named).cast("string")))
        view = attach(timed, manifest, named, inclusive=True).where(F.col(named) <= F.col("cutoff"))
    else:
        view = attach(clean, manifest)
    changed = {c: redact_after(F.col(c), parse_time_by_value(F.col(c).cast("string")), F.col("cutoff")) for c in policy.redact if c in view.columns}
    for field, clock in policy.gated:
        if field in view.columns:
            changed[field] = redact_after(F.col(field), _plain(clock), F.col("cutoff")) if clock in view.columns else F.lit(None).cast(view.schema[field].dataType)
    return view.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in view.columns if c.lower() not in policy.drop])


def linked_scans(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scans up to the cutoff that the question's study_ids name; a question that names none sees none."""
    view = inclusive_view(scans, manifest, ImagePolicy(("studydatetime",)))
    links = manifest.select("qid", F.explode("study_ids").alias("_study")).select("qid", normalize_id(F.col("_study")).alias("_study")).distinct()
    return view.withColumn("_study", normalize_id(F.col("study_id"))).join(links, ["qid", "_study"], "left_semi").drop("_study")


def _coded(df: DataFrame, admissions: DataFrame | None, manifest: DataFrame) -> DataFrame:
    """Codes of encounters that ended by the cutoff; of a table without encounters, by its own clock."""
    if admissions is None and "charttime" in df.columns:
        return inclusive_view(df, manifest, ImagePolicy(("charttime",)))
    if admissions is None or not {"hadm_id", "dischtime"} <= set(admissions.columns) or "hadm_id" not in df.columns:
        return attach(null_sentinels(df), manifest).where("false")
    ended = attach(null_sentinels(admissions), manifest).where(_plain("dischtime") <= F.col("cutoff"))
    ended = ended.select("qid", normalize_id(F.col("hadm_id")).alias("_hadm")).distinct()
    return attach(null_sentinels(df), manifest).withColumn("_hadm", normalize_id(F.col("hadm_id"))).join(ended, ["qid", "_hadm"], "left_semi").drop("_hadm")


def image_view(tables: Mapping[str, DataFrame], manifest: DataFrame) -> dict[str, DataFrame]:
    """manifest: qid, subject_id, cutoff, modalities, study_ids. Tables without a policy have no rows."""
    family = route_schema({n: df.columns for n, df in tables.items()})
    if family not in ("medmod", "ehrxqa"):
        raise ValueError("the tables are of no image-question set")
    rules = EVENTS if family == "medmod" else HOSPITAL
    with_records = modality_gate(manifest)

    def view(name: str, df: DataFrame) -> DataFrame:
        if name == SCANS:
            return linked_scans(df, manifest)
        if name in CODED and family == "ehrxqa":
            return _coded(df, tables.get("admissions"), with_records)
        if name in rules:
            return inclusive_view(df, with_records, rules[name])
        return attach(df, with_records).where("false")

    return {name: view(name, df) for name, df in tables.items()}
