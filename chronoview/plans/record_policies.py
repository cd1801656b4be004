"""Policies of the clinical record tables, for ``policies.point_in_time_view``.

Fixed values: names of tables, columns, tasks and field names, and the delay of coded history. The allow-lists
of columns are a parameter, read from the data dictionary that comes with the tables (``read_allowed``).
"""

from __future__ import annotations

from .policies import ChildPolicy, FieldGuard, MaskPolicy, TablePolicy

DAY = 24 * 60 * 60


def _ends(clock: str, *fields: str) -> tuple[FieldGuard, ...]:
    """The clock itself and fields that are known once it has passed."""
    return tuple(FieldGuard(f, (clock,)) for f in (clock, *fields))


def _stored(**more) -> TablePolicy:
    return TablePolicy(("charttime",), ("storetime",), **more)


def _running(*fields: str) -> TablePolicy:
    """Seen from the start; what is known at the end is hidden while it runs."""
    return TablePolicy(("starttime",), completion=("endtime", "storetime"), completion_fields=("endtime", "storetime", *fields))


def _coded(parent: str, key: str, clock: str, *keep: str) -> ChildPolicy:
    """Codes of an encounter, a day after its end."""
    return ChildPolicy(parent, (key,), clock, DAY, derived="available_time", keep=keep)


TABLES: dict[str, TablePolicy | ChildPolicy] = {
    "patients": TablePolicy(drop=("dod",)),
    "admissions": TablePolicy(("admittime",), guards=(*_ends("dischtime", "discharge_location", "hospital_expire_flag"), *_ends("deathtime"), *_ends("edouttime")), drop=("text",)),
    "transfers": TablePolicy(("intime",), guards=_ends("outtime")),
    "edstays": TablePolicy(("intime",), guards=_ends("outtime", "disposition")),
    "icustays": TablePolicy(("intime",), guards=_ends("outtime", "los", "last_careunit")),
    "services": TablePolicy(("transfertime",)),
    "prescriptions": TablePolicy(("starttime",), guards=_ends("stoptime")),
    "poe": TablePolicy(("ordertime",), drop=("order_status", "discontinue_of_poe_id", "discontinued_by_poe_id")),
    "medrecon": TablePolicy(("charttime",)),
    "pyxis": TablePolicy(("charttime",)),
    "vitalsign": TablePolicy(("charttime",)),
    "omr": TablePolicy(("chartdate",)),
    "chartevents": _stored(),
    "datetimeevents": _stored(),
    "labevents": _stored(),
    "outputevents": _stored(),
    "radiology": _stored(),
    "discharge": _stored(),
    "emar": _stored(guards=_ends("scheduletime")),
    "microbiologyevents": TablePolicy(("charttime", "chartdate"), ("storetime", "storedate"), "coalesce"),
    "inputevents": _running("amount", "amountuom", "rate", "rateuom", "totalamount", "totalamountuom", "isopenbag", "continueinnextdept", "statusdescription"),
    "ingredientevents": _running("amount", "amountuom", "rate", "rateuom", "statusdescription"),
    "procedureevents": _running("value", "valueuom", "isopenbag", "continueinnextdept", "statusdescription"),
    "pharmacy": TablePolicy(("entertime",), ("verifiedtime",), drop=("stoptime", "status", "expirationdate", "dispensation", "fill_quantity")),
    "diagnoses_icd": _coded("admissions", "hadm_id", "dischtime", "subject_id", "hadm_id", "seq_num", "icd_code", "icd_version", "available_time"),
    "diagnosis": _coded("edstays", "stay_id", "outtime", "subject_id", "stay_id", "seq_num", "icd_code", "icd_version", "icd_title", "available_time"),
    "procedures_icd": _coded("admissions", "hadm_id", "dischtime"),
    "hcpcsevents": _coded("admissions", "hadm_id", "dischtime"),
    "drgcodes": _coded("admissions", "hadm_id", "dischtime"),
    "discharge_detail": ChildPolicy("discharge", ("note_id",)),
    "radiology_detail": ChildPolicy("radiology", ("note_id",)),
    "poe_detail": ChildPolicy("poe", ("poe_id", "poe_seq"), allow_column="field_name", allow_values=("Admit to", "Admit category", "Tubes & Drains type", "Code status", "Transfer to", "Level of Urgency", "Indication")),
    "triage": ChildPolicy("edstays", ("stay_id",), "intime", 1, derived="charttime"),
}

#: What an administration says of the drug, without what was done.
_DRUG = ("administration_type", "pharmacy_id", "barcode_type", "dose_due", "dose_due_unit", "product_unit", "product_code", "product_description", "product_description_other", "route", "side", "site")
TABLES["emar_detail"] = ChildPolicy("emar", ("emar_id", "emar_seq"), keep=("subject_id", "emar_id", "emar_seq", "parent_field_ordinal", *_DRUG), require=_DRUG)

#: Tables with clocks of their own that also need a visible stay.
CONSTRAINTS = {name: ChildPolicy("edstays", ("stay_id",)) for name in ("medrecon", "pyxis", "vitalsign")}

#: Answers of tasks that ask for an encounter's codes.
MASKS = {
    "diagnoses_icd": MaskPolicy(("diagnoses_icd", "diagnoses_ccs"), "hadm_id", "target_hadm_id"),
    "diagnosis": MaskPolicy(("diagnosis", "diagnosis_ccs"), "stay_id", "target_stay_id"),
}

#: Tables that are never shown, tasks that see their whole index episode, and how that note's time is named.
DROPPED = ("cost",)
EPISODE_TASKS = ("Readmission_30day", "Readmission_60day")
EPISODE_TIME = "episode_available_time"


#: Snapshots that are kept on disk are stricter: intervals show only once they have ended and been stored, deaths and ends of
#: stays only once they have passed; codes, triage and the pharmacy's final states are not kept at all.
STRICT_TABLES: dict[str, TablePolicy | ChildPolicy] = {name: p for name, p in TABLES.items() if isinstance(p, TablePolicy) and name != "pharmacy"} | {
    "patients": TablePolicy(guards=_ends("dod")),
    "icustays": TablePolicy(("intime",), guards=_ends("outtime", "los")),
    **{name: TablePolicy(("endtime",), ("storetime",)) for name in ("inputevents", "ingredientevents", "procedureevents")},
    "discharge_detail": ChildPolicy("discharge", ("note_id",)),
    "radiology_detail": ChildPolicy("radiology", ("note_id",)),
    "poe_detail": ChildPolicy("poe", ("poe_id", "poe_seq")),
    "emar_detail": ChildPolicy("emar", ("emar_id",)),
}
STRICT_DROPPED = ("diagnoses_icd", "diagnosis", "procedures_icd", "hcpcsevents", "drgcodes", "pharmacy", "cost", "triage")
STRICT_VERSION = "strict-snapshot-1"
