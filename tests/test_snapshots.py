"""Snapshots: strict rows, one build a subject, nothing trusted that is not what its manifest says."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoview.plans import record_policies as rp, snapshots as snap

LABS = "subject_id int, labevent_id string, charttime string, storetime string"
RUNS = "subject_id int, itemid string, starttime string, endtime string, storetime string, amount string"


@pytest.fixture
def tables(spark):
    labs = [(s, f"l{i}", f"2200-01-0{i} 10:00:00", f"2200-01-0{i} 11:00:00") for s in (1, 2, 3) for i in range(1, 6)] + [(1, "x", "junk", "2200-01-01"), (9, "y", "2200-01-01 00:00:00", "")]
    runs = [(1, "done", "2200-01-01 00:00:00", "2200-01-02 00:00:00", "2200-01-02 01:00:00", "5"), (1, "open", "2200-01-01 00:00:00", "2200-01-09 00:00:00", "2200-01-09 01:00:00", "7")]
    codes = spark.createDataFrame([(1, "h", "c")], "subject_id int, hadm_id string, icd_code string")
    own = {"labevents": spark.createDataFrame(labs, LABS), "inputevents": spark.createDataFrame(runs, RUNS), "diagnoses_icd": codes}
    return own, {n: df.columns for n, df in own.items()}


def asked(spark, *rows):
    return spark.createDataFrame([(s, c) for s, c in rows], "subject_id int, cutoff string").withColumn("cutoff", F.to_timestamp_ntz("cutoff"))


def test_strict_views_show_only_what_has_ended(spark, tables):
    own, allowed = tables
    m = asked(spark, (1, "2200-01-03 10:30:00")).withColumn("qid", F.lit("q"))
    views = snap.strict_view(own, m, allowed)
    assert set(views) == {"labevents", "inputevents"}  # codes are not kept
    assert [r["itemid"] for r in views["inputevents"].collect()] == ["done"]
    assert sorted(r["labevent_id"] for r in views["labevents"].collect()) == ["l1", "l2"]
    assert set(rp.STRICT_TABLES) & set(rp.STRICT_DROPPED) == set()
    with pytest.raises(ValueError, match="unknown table"):
        snap.strict_view(own | {"new": own["labevents"]}, m, allowed | {"new": own["labevents"].columns})


def test_builds_resume_and_single_subjects_are_built_anew(spark, tables, tmp_path):
    own, allowed = tables
    path = str(tmp_path / "snap")
    three, four = "2200-01-03 10:30:00", "2200-01-04 23:00:00"
    assert snap.build_snapshots(own, asked(spark, (1, three), (2, three)), allowed, path) == 2
    assert snap.build_snapshots(own, asked(spark, (1, three), (2, three)), allowed, path) == 0
    assert snap.build_snapshots(own, asked(spark, (1, three), (2, four), (3, three)), allowed, path) == 2  # another cutoff, and a new one
    read = lambda: {(r["subject_id"], r["labevent_id"]) for r in snap.read_snapshot(spark, path, "labevents", LABS).collect()}
    want = {(1, "l1"), (1, "l2"), (2, "l1"), (2, "l2"), (2, "l3"), (2, "l4"), (3, "l1"), (3, "l2")}
    assert read() == want
    assert snap.build_snapshots(own, asked(spark, (1, three), (3, three)), allowed, path, anew=spark.createDataFrame([(3,), (8,)], "subject_id int")) == 1
    assert read() == want and snap.read_snapshot(spark, path, "labevents", LABS).count() == len(want)
    with pytest.raises(ValueError, match="several cutoffs"):
        snap.build_snapshots(own, asked(spark, (1, three), (1, four)), allowed, path)


def test_what_differs_from_the_manifest_is_built_again(spark, tables, tmp_path):
    own, allowed = tables
    path = str(tmp_path / "snap")
    ask = asked(spark, (1, "2200-01-03 10:30:00"), (2, "2200-01-03 10:30:00"), (7, "2200-01-03 10:30:00"))
    assert snap.build_snapshots(own, ask, allowed, path) == 3
    schemas = {"labevents": LABS, "inputevents": RUNS}
    assert snap.audit_snapshots(spark, path, schemas).count() == 0
    for file in glob.glob(f"{path}/build=*/labevents/*.parquet"):  # a row of subject 2 is lost
        rows = pq.read_table(file)
        kept = [not (s == 2 and x == "l1") for s, x in zip(rows["subject_id"].to_pylist(), rows["labevent_id"].to_pylist(), strict=True)]
        pq.write_table(rows.filter(kept), file)
    for crc in glob.glob(f"{path}/build=*/labevents/.*.crc"):
        (tmp_path / crc).unlink()
    assert [tuple(r) for r in snap.audit_snapshots(spark, path, schemas).collect()] == [("2", "labevents: files")]
    assert snap.build_snapshots(own, ask, allowed, path) == 1
    assert snap.audit_snapshots(spark, path, schemas).count() == 0
    assert snap.read_snapshot(spark, path, "labevents", LABS).where("subject_id = 2").count() == 2


def test_late_values_are_found_whatever_the_manifest_says(spark, tables, tmp_path):
    own, allowed = tables
    path = str(tmp_path / "snap")
    snap.build_snapshots(own, asked(spark, (1, "2200-01-03 10:30:00")), allowed, path)
    now = snap.current(spark, path).withColumn("cutoff", F.to_timestamp_ntz(F.lit("2200-01-02 00:00:00"))).withColumn("built_at", F.current_timestamp())
    now.write.mode("append").parquet(f"{path}/manifest")
    found = {r["problem"] for r in snap.audit_snapshots(spark, path, {"labevents": LABS}).collect()}
    assert "labevents: late" in found


def test_manifest_rows_are_made_in_many_tasks(spark):
    """Few files, but what makes the rows of the manifest stays in its own tasks."""
    rows = spark.range(0, 1000, 1, 8).select(F.col("id").alias("subject_id"), F.spark_partition_id().alias("task"))
    out = snap._gathered(rows, 1000)
    assert out.rdd.getNumPartitions() == 1 and out.select("task").distinct().count() == 8
