"""Point-in-time scenarios on small hand-made records."""

import pytest
from pyspark.sql import functions as F

from chronoview.functions import cleanse as cl
from chronoview.operators import asof, joins, linking, records
from chronoview.plans import policies as pol

CUTOFF = "2200-01-02 10:00:00"


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


@pytest.fixture
def manifest(spark):
    return frame(spark, [("q", "1", CUTOFF)], ["qid", "subject_id", "cutoff"]).withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))


def timed(df, *columns):
    return df.select(*[cl.parse_time(F.col(c), c).alias(c) if c in columns else F.col(c) for c in df.columns])


def test_both_clocks_are_strict(spark, manifest):
    rows = [("a", "1", "2200-01-02 09:00:00", "2200-01-02 09:30:00"), ("b", "1", "2200-01-02 10:00:00", "2200-01-02 09:30:00"), ("c", "1", "2200-01-02 09:00:00", "2200-01-02 10:00:00"), ("d", "1", "2200-01-02 09:00:00", "")]
    labs = timed(frame(spark, rows, ["id", "subject_id", "charttime", "storetime"]), "charttime", "storetime")
    view = pol.table_view(labs, manifest, pol.TablePolicy(("charttime",), ("storetime",)))
    assert [r["id"] for r in view.collect()] == ["a"]


def test_date_only_means_end_of_day(spark, manifest):
    rows = [("a", "1", "2200-01-01"), ("b", "1", "2200-01-02"), ("c", "1", "soon")]
    view = pol.table_view(timed(frame(spark, rows, ["id", "subject_id", "chartdate"]), "chartdate"), manifest, pol.TablePolicy(("chartdate",)))
    assert [r["id"] for r in view.collect()] == ["a"]


def test_ongoing_row_stays_without_its_result(spark, manifest):
    rows = [("a", "1", "2200-01-02 08:00:00", "2200-01-02 09:00:00", "5"), ("b", "1", "2200-01-02 08:00:00", "2200-01-02 11:00:00", "6")]
    df = timed(frame(spark, rows, ["id", "subject_id", "starttime", "endtime", "amount"]), "starttime", "endtime")
    policy = pol.TablePolicy(("starttime",), completion=("endtime",), completion_fields=("amount",))
    assert {r["id"]: r["amount"] for r in pol.table_view(df, manifest, policy).collect()} == {"a": "5", "b": None}
    without_clock = pol.table_view(df.drop("endtime"), manifest, policy)
    assert {r["amount"] for r in without_clock.collect()} == {None}


def test_child_follows_parent_with_offset_and_agreement(spark, manifest):
    stays = timed(frame(spark, [("s1", "1", "2200-01-01 08:00:00"), ("s2", "1", "2200-01-02 08:00:00"), ("s3", "1", "2200-01-01 01:00:00"), ("s3", "1", "2200-01-01 02:00:00")], ["stay_id", "subject_id", "outtime"]), "outtime")
    codes = frame(spark, [("s1", "A"), ("s2", "B"), ("s3", "C"), ("s4", "D")], ["stay_id", "code"])
    rules = {"stays": pol.TablePolicy(("outtime",)), "codes": pol.ChildPolicy("stays", ("stay_id",), "outtime", 86400)}
    view = pol.point_in_time_view({"stays": stays, "codes": codes}, manifest, rules, {"stays": stays.columns, "codes": codes.columns})
    assert [r["code"] for r in view["codes"].collect()] == ["A"]


def test_unknown_tables_and_columns_fail_before_any_job(spark, manifest):
    df = frame(spark, [("1", "x")], ["subject_id", "charttime"])
    with pytest.raises(ValueError, match="unknown table extra"):
        pol.validate({"extra": df}, {}, {})
    with pytest.raises(ValueError, match="unknown column labs.charttime"):
        pol.validate({"labs": df}, {"labs": pol.TablePolicy(("charttime",))}, {"labs": ["subject_id"]})
    with pytest.raises(ValueError, match="missing column labs.storetime"):
        pol.validate({"labs": df}, {"labs": pol.TablePolicy(("charttime",), ("storetime",))}, {})


def test_later_cutoff_never_loses_rows(spark, manifest):
    rows = [(str(i), "1", f"2200-01-0{1 + i % 4} 0{i % 10}:00:00") for i in range(20)]
    df = timed(frame(spark, rows, ["id", "subject_id", "event_time"]), "event_time")
    early = {r["id"] for r in asof.as_of_event(df, manifest).collect()}
    late = {r["id"] for r in asof.as_of_event(df, manifest.withColumn("cutoff", F.col("cutoff") + F.expr("INTERVAL 1 DAY"))).collect()}
    assert early and early < late


def test_inclusive_filter_needs_its_column(spark, manifest):
    with pytest.raises(ValueError):
        asof.as_of_inclusive(frame(spark, [("1",)], ["subject_id"]), manifest, "charttime")


def test_text_sweep_and_identifiers(spark):
    df = frame(spark, [("seen 2200-01-03", "123.0", "1e3"), ("seen 2200-01-01", " 123", "73.0"), (None, "x-1", "nan")], ["note", "i", "n"])
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    swept = cl.sweep_future_text(df, ["note"], cut).collect()
    assert [r["note"] for r in swept] == [None, "seen 2200-01-01", None] and [r["swept"] for r in swept] == [1, 0, 0]
    assert [tuple(r) for r in df.select(cl.normalize_id(F.col("i")), cl.normalize_scalar(F.col("n"))).collect()] == [("123", "1000"), ("123", "73"), ("x-1", None)]


def test_tri_state(spark):
    df = frame(spark, [("2200-01-02",), ("2200-01-02 11:00:00",), ("2200-01-01",), ("junk",), (None,)], ["t"])
    state = lambda c: [r[0] for r in df.select(cl.tri_state(F.col("t"), F.lit(c).cast("timestamp_ntz"))).collect()]
    assert state(CUTOFF) == ["unknown", "after", "before", "unknown", "unknown"]
    assert state("2200-01-02 23:59:59")[0] == "before"


def test_range_start_after_end_is_an_error(spark, manifest):
    df = timed(frame(spark, [("1", "2200-01-01")], ["subject_id", "event_time"]), "event_time")
    seen = asof.attach(df, manifest)
    late, early = F.lit("2200-01-03").cast("timestamp_ntz"), F.lit("2200-01-01").cast("timestamp_ntz")
    with pytest.raises(Exception, match="start is after end"):
        asof.clamp_range(seen, late, early).collect()
    assert asof.clamp_range(seen, early, late).count() == 1


def test_audit_raises_on_violation(spark, manifest):
    df = asof.attach(timed(frame(spark, [("1", "2200-01-05")], ["subject_id", "event_time"]), "event_time"), manifest)
    found = records.violations(df, {"future": F.col("event_time") >= F.col("cutoff")})
    with pytest.raises(ValueError):
        records.require_none(found)
    records.require_none(found.where("n > 5"))


def test_ambiguous_report_links_stay_open(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "l int, tokens array<string>")
    right = spark.createDataFrame([(10, ["a", "b", "c"]), (11, ["b", "a", "d"]), (12, ["q"])], "r int, tokens array<string>")
    assert linking.link_reports(left, right, "l", "r").count() == 0
    assert linking.link_reports(left, right.where("r <> 11"), "l", "r").collect()[0]["r"] == 10


def test_route_and_sql_guard(spark):
    assert pol.route_schema({"events": [], "stays": [], "tb_cxr": []}) == "medmod"
    assert pol.route_schema({"patients": ["anchor_year"]}) == "strict"
    assert pol.route_schema({"labs": []}) == "legacy"
    with pytest.raises(ValueError):
        records.sql_on_view({"labs": spark.range(1)}, "DROP TABLE labs")
