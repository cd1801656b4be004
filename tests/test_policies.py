"""Views over tables that are text throughout, and what must fail closed."""

import pytest
from pyspark.sql import functions as F

from chronoview.functions import text as tx
from chronoview.operators import asof
from chronoview.plans import image_views as iv
from chronoview.plans import policies as pol
from chronoview.plans import record_policies as rec
from chronoview.sources import io

CUTOFF = "2200-01-02 10:00:00"


def frame(spark, columns, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


@pytest.fixture
def manifest(spark):
    rows = [("q", "1", CUTOFF, "other", None, None), ("m", "2", CUTOFF, "diagnoses_icd", "20.0", None)]
    m = frame(spark, "qid subject_id cutoff task target_hadm_id target_stay_id", *rows)
    return m.withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_text_days_end_at_midnight_and_junk_goes(spark, manifest):
    df = frame(spark, "subject_id id chartdate", ("1", "a", "2200-01-01"), ("1", "b", "2200-01-02"), ("1", "c", "soon"), ("1", "d", ""))
    assert ids(pol.table_view(df, manifest, rec.TABLES["omr"])) == ["a"]


def test_text_clocks_are_strict(spark, manifest):
    rows = [("a", "09:00", "09:30"), ("b", "10:00", "09:30"), ("c", "09:00", "10:00"), ("d", "09:00", "nan")]
    df = frame(spark, "subject_id id charttime storetime", *[("1", i, f"2200-01-02 {x}:00", f"2200-01-02 {y}:00" if ":" in y else y) for i, x, y in rows])
    assert ids(pol.table_view(df, manifest, rec.TABLES["labevents"])) == ["a"]


def test_precise_store_time_comes_before_the_day(spark, manifest):
    row = lambda i, stored, day: ("1", i, "2200-01-01", "2200-01-01 08:00:00", stored, day)
    df = frame(spark, "subject_id id chartdate charttime storetime storedate", row("a", "2200-01-02 09:00:00", "2200-01-02"), row("b", "", "2200-01-02"), row("c", None, "2200-01-01"))
    assert ids(pol.table_view(df, manifest, rec.TABLES["microbiologyevents"])) == ["a", "c"]


def test_outcomes_wait_for_the_end_and_are_counted(spark, manifest):
    df = frame(spark, "subject_id hadm_id admittime dischtime discharge_location text", ("1", "1", "2200-01-01 08:00:00", "2200-01-02 09:00:00", "home", "x"), ("1", "2", "2200-01-02 08:00:00", "2200-01-03 09:00:00", "away", "y"), ("1", "3", "2200-01-04 08:00:00", None, None, None))
    got = {r["hadm_id"]: r for r in pol.table_view(df, manifest, rec.TABLES["admissions"]).collect()}
    assert got["1"]["discharge_location"] == "home" and got["2"]["discharge_location"] is None and got["2"]["dischtime"] is None
    assert "text" not in got["1"].asDict() and set(got) == {"1", "2"}
    told = pol.table_report(df, manifest, rec.TABLES["admissions"]).collect()[0]
    assert (told["input_rows"], told["output_rows"], told["dropped_rows"], told["redacted"], told["future"], told["unparseable"]) == (3, 2, 1, 4, 1, 0)


def _tables(spark):
    return {
        "admissions": frame(spark, "subject_id hadm_id admittime dischtime", ("2", "20", "2199-12-01 08:00:00", "2199-12-03 09:00:00"), ("2", "21", "2199-12-05 08:00:00", "2199-12-06 09:00:00"), ("2", "22", "2200-01-01 08:00:00", "2200-01-02 09:00:00")),
        "diagnoses_icd": frame(spark, "subject_id hadm_id icd_code charttime", ("2", "20", "A", "2199-01-01"), ("2", "21", "B", "2199-01-01"), ("2", "22", "C", "2199-01-01")),
        "edstays": frame(spark, "subject_id stay_id intime outtime", ("1", "5", "2200-01-02 08:00:00", None), ("1", "6", "2200-01-02 11:00:00", None)),
        "vitalsign": frame(spark, "subject_id stay_id charttime pain", ("1", "5", "2200-01-02 09:00:00", "1"), ("1", "7", "2200-01-02 09:00:00", "2")),
        "triage": frame(spark, "subject_id stay_id pain", ("1", "5", "3"), ("1", "6", "4")),
    }


def test_record_view_of_several_tables_passes_its_audit(spark, manifest):
    tables = _tables(spark)
    allowed = {n: df.columns for n, df in tables.items()}
    views = pol.point_in_time_view(tables, manifest, rec.TABLES, allowed, rec.CONSTRAINTS, rec.MASKS)
    assert ids(views["diagnoses_icd"], "icd_code") == ["B"] and "charttime" not in views["diagnoses_icd"].columns
    assert ids(views["vitalsign"], "pain") == ["1"] and ids(views["triage"], "pain") == ["3"]
    assert str(views["triage"].collect()[0]["charttime"]) == "2200-01-02 08:00:01"
    assert pol.audit_views(views, rec.TABLES, rec.CONSTRAINTS).count() == 0
    leaking = {**views, "vitalsign": asof.attach(tables["vitalsign"], manifest).withColumn("charttime", F.lit("2200-01-05"))}
    found = {(r["table_name"], r["rule"]): r["n"] for r in pol.audit_views(leaking, rec.TABLES, rec.CONSTRAINTS).collect()}
    assert found == {("vitalsign", "future charttime"): 2, ("vitalsign", "no visible edstays"): 1}


def test_what_is_not_allowed_or_masked_fails(spark, manifest):
    tables = _tables(spark)
    allowed = {n: df.columns for n, df in tables.items()}
    with pytest.raises(ValueError, match="no allow-list for triage"):
        pol.point_in_time_view(tables, manifest, rec.TABLES, {n: c for n, c in allowed.items() if n != "triage"})
    extra = {**tables, "triage": tables["triage"].withColumn("fresh", F.lit(1))}
    with pytest.raises(ValueError, match="unknown column triage.fresh"):
        pol.point_in_time_view(extra, manifest, rec.TABLES, allowed)
    with pytest.raises(Exception, match="no target for question"):
        pol.point_in_time_view(tables, manifest.withColumn("target_hadm_id", F.lit("nan")), rec.TABLES, allowed, masks=rec.MASKS)["diagnoses_icd"].collect()
    with pytest.raises(ValueError, match="missing column services.transfertime"):
        pol.validate({"services": frame(spark, "subject_id", ("1",))}, rec.TABLES, {"services": ["subject_id"]})


def test_index_note_is_restored(spark, manifest):
    notes = frame(spark, "subject_id hadm_id note_id charttime storetime", ("1", "9", "n", "2200-01-02 09:59:59", "2200-01-05 08:00:00"), ("1", "8", "o", "2200-01-01 08:00:00", "2200-01-01 09:00:00"))
    stays = frame(spark, "subject_id episode_id end_time", ("1", "9", "2200-01-02 09:59:59")).withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))
    asked = manifest.where("qid = 'q'").withColumn("episode_id", F.lit(None).cast("string"))
    hints = notes.select("subject_id", F.col("hadm_id").alias("episode_id"), F.col("charttime").cast("timestamp_ntz").alias("charttime"))
    episodes = asof.resolve_episode(asked, stays, hints)
    view = pol.table_view(notes, asked, rec.TABLES["discharge"])
    got = {r["note_id"]: r for r in asof.restore_note(view, notes, episodes, "hadm_id").collect()}
    assert set(got) == {"n", "o"} and got["n"]["storetime"] is None and str(got["n"]["episode_available_time"]) == "2200-01-02 09:59:59"


def test_image_views_gate_and_link(spark, manifest):
    m = manifest.withColumn("modalities", F.array(F.lit("EHR"))).withColumn("study_ids", F.array(F.lit("7")))
    scans = frame(spark, "subject_id study_id studydatetime", ("1", "7.0", CUTOFF), ("1", "8", CUTOFF), ("1", "7", "2200-01-03"))
    tables = {"events": frame(spark, "subject_id charttime", ("1", CUTOFF), ("1", "2200-01-02")), "stays": frame(spark, "subject_id intime los", ("1", "2200-01-01", "3")), "tb_cxr": scans, "odd": frame(spark, "subject_id", ("1",))}
    views = iv.image_view(tables, m)
    assert [views[n].count() for n in tables] == [1, 1, 1, 0] and "los" not in views["stays"].columns
    assert iv.image_view(tables, m.withColumn("modalities", F.array(F.lit("image"))))["events"].count() == 0
    with pytest.raises(ValueError):
        iv.image_view({"labs": scans}, m)
    assert pol.route_schema({**{n: [] for n in tables}}) == "medmod"
    assert pol.route_schema({"labevents": ["row_id"]}) == "ehrxqa" and pol.route_schema({"own": ["row_id"]}) == "legacy"


def test_csv_cells_may_hold_lines_and_quotes(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,text\n1,"two\nlines with ""quotes"""\n2,plain\n')
    rows = {r["id"]: r["text"] for r in io.scan_table_dir(spark, str(tmp_path))["notes"].collect()}
    assert rows == {"1": 'two\nlines with "quotes"', "2": "plain"}


def test_subject_store_takes_text_ids(spark, tmp_path):
    df = frame(spark, "subject_id x", ("1", "a"), ("1", "b"), ("2", "c"))
    io.write_subject_store({"t": df}, str(tmp_path / "s"))
    assert io.read_subject_tables(spark, str(tmp_path / "s"), ["t"], "1")["t"].count() == 2
    assert io.read_subject_tables(spark, str(tmp_path / "s"), ["t"], 2)["t"].count() == 1
    assert io.subset_by_subject({"t": df}, df.where("false"))["t"].count() == 3


def test_empty_prediction_matches_no_name(spark):
    df = spark.createDataFrame([("", ["", "alpha"]), ("alph", ["", "alpha"]), ("  ", ["beta"])], "p string, v array<string>")
    assert [r[0] for r in df.select(tx.align(F.col("p"), F.col("v"))).collect()] == ["", "alpha", "  "]


def test_proven_late_rows_go_with_their_details(spark, manifest):
    rows = frame(spark, "qid id charttime storetime", ("q", "a", "2200-01-01", "n/a"), ("q", "b", "2200-01-01", "2200-01-05"), ("q", "c", "?", "")).withColumn("cutoff", F.lit(CUTOFF).cast("timestamp_ntz"))
    stated, counts = asof.availability_states(rows, ["charttime", "storetime"])
    kept, details = asof.drop_proven_late(stated, {"d": (rows.select("qid", "id"), ["id"])})
    assert ids(kept) == ["a", "c"] == ids(details["d"]) and tuple(counts.collect()[0]) == ("q", 1, 1, 1)


def test_all_replies_to_a_thought_vanish(spark):
    rows = [(1, 1, "assistant", "think", "hm"), (1, 2, "tool", "", "r1"), (1, 3, "tool", "", "r2"), (1, 4, "assistant", "act", "go"), (1, 5, "tool", "", "out")]
    turns = spark.createDataFrame(rows, "k int, o int, role string, kind string, text string")
    got = [(r["o"], r["reasoning"]) for r in tx.fold_think(turns, "k", "o").orderBy("o").collect()]
    assert got == [(4, "hm"), (5, None)]
