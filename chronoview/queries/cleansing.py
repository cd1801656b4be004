"""Queries for cleansing (B) and as-of filters (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleanse as cl
from ..operators import asof
from ..plans.image_views import image_view
from ..plans.registry import BOTH, MANIFEST, RECORDS, query, stamp

S = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("""SELECT event_id, CASE WHEN lower(trim(x)) IN ('', 'nan', 'nat', 'none', 'null', '<na>') THEN NULL ELSE x END AS x FROM (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE event_type END AS x FROM events)""")
def b1_null_sentinels(t):
    k = F.col("event_id") % 5
    raw = t.events.select("event_id", F.when(k == 0, " NaN ").when(k == 1, "None").when(k == 2, "").otherwise(F.col("event_type")).alias("x"))
    return cl.null_sentinels(raw)


@query(f"""SELECT event_id, {S.format('t')} AS t, {S.format('d')} AS d FROM (SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) END AS t, date_trunc('day', ts) + INTERVAL '86399.999999 seconds' AS d FROM events)""")
def b2_parse_time(t):
    text, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 3
    raw = t.events.select("event_id", F.when(k == 0, text).when(k == 1, F.substring(text, 1, 10)).otherwise(F.concat(F.lit("x"), text)).alias("t"), F.substring(text, 1, 10).alias("chartdate"))
    return raw.select("event_id", stamp(cl.parse_time(F.col("t"))).alias("t"), stamp(cl.parse_time(F.col("chartdate"), "chartdate")).alias("d"))


@query(f"{BOTH} SELECT event_id, {S.format('coalesce(a, event_time)')} AS first_time, {S.format('greatest(a, event_time)')} AS last_time FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN available_time END AS a FROM r)")
def b3_b4_b5_clocks(t):
    r = t.records.withColumn("a", F.when(F.col("event_id") % 2 == 0, F.col("available_time")))
    both = [F.col("a"), F.col("event_time")]
    return r.select("event_id", stamp(cl.availability_time(both, "first")).alias("first_time"), stamp(cl.availability_time(both, "latest")).alias("last_time"))


@query("""SELECT o_orderkey, o_orderkey::VARCHAR AS id, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS scalar,
  lpad(o_custkey::VARCHAR, 11, '0') AS code FROM orders""")
def b6_b7_normalize(t):
    o = t.orders
    return o.select(
        "o_orderkey",
        cl.normalize_id(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))).alias("id"),
        cl.normalize_scalar(F.col("o_totalprice").cast("string")).alias("scalar"),
        cl.normalize_code(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("code"),
    )


@query(f"{BOTH} SELECT m.qid, event_id, CASE WHEN available_time < cutoff THEN value END AS value FROM r JOIN m USING (subject_id) WHERE event_time < cutoff")
def b8_guard_field(t):
    seen = asof.as_of_event(t.records, t.manifest)
    return seen.select("qid", "event_id", cl.guard_field(F.col("value"), F.col("available_time"), F.col("cutoff")).alias("value"))


@query(f"""{BOTH} SELECT qid, event_id, CASE WHEN event_time < cutoff AND available_time < cutoff THEN value END AS value,
  CASE WHEN event_time < cutoff AND available_time < cutoff THEN props END AS props FROM r JOIN m USING (subject_id)""")
def b9_guard_completion(t):
    seen = asof.attach(t.records, t.manifest)
    guarded = cl.guard_completion(["value", "props"], [F.col("event_time"), F.col("available_time")], F.col("cutoff"))
    return seen.select("qid", "event_id", *[c.alias(n) for n, c in guarded.items()])


def _late(names: str) -> str:
    return f"""{BOTH}, x AS (SELECT qid, event_id, cutoff, event_time AS scheduletime, available_time AS donetime, event_id % 4 = 0 AS broken FROM r JOIN m USING (subject_id))
  SELECT qid, event_id, {names} FROM x"""


def _timed(t):
    x = asof.attach(t.records, t.manifest)
    done = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.col("available_time").cast("string"))
    return x.select("qid", "event_id", "cutoff", F.col("event_time").alias("scheduletime"), done.alias("donetime"))


@query(_late(f"""CASE WHEN scheduletime < cutoff THEN {S.format('scheduletime')} END AS scheduletime, CASE WHEN NOT broken AND donetime < cutoff THEN {S.format('donetime')} END AS donetime,
  ((scheduletime >= cutoff)::INT + (NOT broken AND donetime >= cutoff)::INT)::INT AS future_nulled, broken::INT AS unparseable_nulled"""))
def b10_sanitize_timestamps(t):
    out = cl.sanitize_timestamps(_timed(t), "cutoff")
    return out.select("qid", "event_id", stamp("scheduletime").alias("scheduletime"), stamp("donetime").alias("donetime"), "future_nulled", "unparseable_nulled")


@query(_late(f"""{S.format('scheduletime')} AS scheduletime, CASE WHEN NOT broken AND donetime < cutoff THEN {S.format('donetime')} END AS donetime,
  (NOT broken AND donetime >= cutoff)::INT AS future_nulled, broken::INT AS unparseable_nulled"""))
def b11_sanitize_faithful(t):
    out = cl.sanitize_timestamps(_timed(t), "cutoff", exempt=cl.PLAN_COLUMNS)
    return out.select("qid", "event_id", stamp("scheduletime").alias("scheduletime"), stamp("donetime").alias("donetime"), "future_nulled", "unparseable_nulled")


@query(f"""{BOTH} SELECT qid, count(*) AS n, count(*) FILTER (event_time > cutoff) AS swept FROM (
  SELECT qid, cutoff, date_trunc('second', event_time) AS event_time FROM r JOIN m USING (subject_id)) GROUP BY qid""")
def b12_sweep_future_text(t):
    x = asof.attach(t.records, t.manifest).select("qid", "cutoff", F.concat(F.lit("seen at "), stamp("event_time"), F.lit(" by staff")).alias("note"))
    return cl.sweep_future_text(x, ["note"], F.col("cutoff")).groupBy("qid").agg(F.count("*").alias("n"), F.sum("swept").alias("swept"))


@query("SELECT o_orderkey, o_custkey, 1 + (o_totalprice IS NOT NULL)::INT AS redacted FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def b13_b14_b15_drop_allow_require(t):
    kept = cl.allow_rows(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    kept = cl.require_nonempty(kept, ["o_orderstatus", "o_totalprice"])
    return cl.keep_columns(cl.drop_columns(kept, ["o_orderstatus", "o_totalprice"]), ["o_orderkey", "o_custkey", "redacted"])


@query("""WITH e AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, strftime(e.e - INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS code_time FROM lineitem LEFT JOIN e USING (l_orderkey)""")
def b17_derive_code_time(t):
    from ..operators.joins import derive_code_time

    ends = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_time"))
    return derive_code_time(t.lineitem.select("l_orderkey", "l_linenumber"), ends, ["l_orderkey"], "end_time").select("l_orderkey", "l_linenumber", stamp("code_time").alias("code_time"))


@query("""WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l, list_filter(list(o_orderkey ORDER BY o_orderkey), lambda x: x % 2 = 0) AS k FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN len(l) > 1 AND len(k) > 0 AND len(k) < len(l) THEN k ELSE l END, '|') AS cell FROM c""")
def b18_prune_list(t):
    o = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    even = F.transform(F.filter("ids", lambda x: x % 2 == 0), lambda x: x.cast("string"))
    return o.select("o_custkey", cl.prune_list(F.array_join(F.transform("ids", lambda x: x.cast("string")), "|"), even).alias("cell"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_custkey":' || o_custkey || ',"gone":null}' AS js, substr(o_orderpriority, 1, 4) AS cut FROM orders""")
def b19_b20_json_truncate(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", F.lit(None).cast("string").alias("gone"))
    return o.select("o_orderkey", cl.row_json(o).alias("js"), cl.truncate_text(F.col("o_orderpriority"), 4).alias("cut"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def b21_drop_outcome_columns(t):
    return cl.drop_columns(t.orders, ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(f"{BOTH} SELECT qid, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r JOIN m USING (subject_id) WHERE event_time < cutoff GROUP BY qid")
def c1_as_of_event(t):
    return asof.as_of_event(t.records, t.manifest).groupBy("qid").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"{BOTH} SELECT qid, event_id, event_type, value FROM r JOIN m USING (subject_id) WHERE event_time < cutoff AND available_time < cutoff")
def c2_as_of_available(t):
    return asof.as_of_available(t.records, t.manifest).select("qid", "event_id", "event_type", "value")


@query(f"{BOTH} SELECT qid, event_id FROM (SELECT *, date_trunc('day', event_time) + INTERVAL '23:59:59' AS t FROM r) JOIN m USING (subject_id) WHERE t <= cutoff")
def c3_as_of_inclusive(t):
    dated = t.records.withColumn("t", cl.parse_time_by_value(F.date_format("event_time", "yyyy-MM-dd")))
    return asof.as_of_inclusive(dated, t.manifest, "t").select("qid", "event_id")


@query(f"{BOTH} SELECT qid, event_id, CASE WHEN available_time <= cutoff THEN value END AS value FROM r JOIN m USING (subject_id)")
def c4_redact_after(t):
    x = asof.attach(t.records, t.manifest)
    return x.select("qid", "event_id", asof.redact_after(F.col("value"), F.col("available_time"), F.col("cutoff")).alias("value"))


@query(f"{BOTH} SELECT qid, count(*) AS n FROM r JOIN m USING (subject_id) WHERE event_time <= cutoff GROUP BY qid")
def c6_legacy_view(t):
    return asof.legacy_view(t.records, t.manifest).groupBy("qid").agg(F.count("*").alias("n"))


@query(f"{BOTH} SELECT qid, event_id FROM r JOIN m USING (subject_id) WHERE event_time <= cutoff AND task = 'first'")
def c7_c10_modality_view(t):
    m = t.manifest.withColumn("modalities", F.when(F.col("task") == "first", F.array(F.lit("EHR"), F.lit("image"))).otherwise(F.array(F.lit("image"))))
    return asof.as_of_inclusive(t.records, asof.modality_gate(m), "event_time").select("qid", "event_id")


def _image_manifest(t):
    scans = t.records.where("event_type = 'view' and event_id % 2 = 0").groupBy("subject_id").agg(F.collect_list(F.col("event_id").cast("string")).alias("study_ids"))
    m = t.manifest.withColumn("modalities", F.when(F.col("task") == "first", F.array(F.lit("EHR"), F.lit("image"))).otherwise(F.array(F.lit("image"))))
    return m.join(scans, "subject_id", "left")


def _of_type(t, kind, **columns):
    return t.records.where(F.col("event_type") == kind).select("subject_id", *[c.alias(n) for n, c in columns.items()])


def _scans(t):
    return _of_type(t, "view", study_id=F.concat(F.col("event_id").cast("string"), F.lit(".0")), studydatetime=stamp("event_time"))


_SEES_SCANS = "event_type = 'view' AND event_id % 2 = 0 AND date_trunc('second', event_time) <= cutoff"


@query(f"""{BOTH} SELECT 'events' AS table_name, qid, count(*) AS n, 0::BIGINT AS known FROM r JOIN m USING (subject_id) WHERE task = 'first' AND event_type = 'click' AND date_trunc('day', event_time) + INTERVAL '23:59:59' <= cutoff GROUP BY ALL
UNION ALL SELECT 'stays', qid, count(*), 0 FROM r JOIN m USING (subject_id) WHERE task = 'first' AND event_type = 'purchase' AND date_trunc('second', event_time) <= cutoff GROUP BY ALL
UNION ALL SELECT 'tb_cxr', qid, count(*), 0 FROM r JOIN m USING (subject_id) WHERE {_SEES_SCANS} GROUP BY ALL""")
def c7_image_event_view(t):
    tables = {
        "events": _of_type(t, "click", id=F.col("event_id"), charttime=F.date_format("event_time", "yyyy-MM-dd")),
        "stays": _of_type(t, "purchase", stay_id=F.col("event_id"), intime=stamp("event_time"), los=F.col("value")),
        "tb_cxr": _scans(t),
    }
    return _counted(image_view(tables, _image_manifest(t)))


def _counted(views, **known):
    out = None
    for name, view in views.items():
        if {"los", "mortality"} & set(view.columns):
            raise ValueError(f"{name} shows its outcome")
        own = view.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(known.get(name, F.lit(False))).alias("known")).select(F.lit(name).alias("table_name"), "qid", "n", "known")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{BOTH}, x AS (SELECT *, date_trunc('second', event_time) <= cutoff AS seen, date_trunc('second', available_time) <= cutoff AS ended FROM r JOIN m USING (subject_id)), f AS (SELECT * FROM x WHERE task = 'first')
SELECT 'admissions' AS table_name, qid, count(*) AS n, count(*) FILTER (ended) AS known FROM f WHERE event_type = 'purchase' AND seen GROUP BY ALL
UNION ALL SELECT 'diagnoses_icd', qid, count(*), 0 FROM f WHERE event_type = 'purchase' AND ended GROUP BY ALL
UNION ALL SELECT 'patients', qid, count(*), 0 FROM f WHERE event_type = 'signup' GROUP BY ALL
UNION ALL SELECT 'tb_cxr', qid, count(*), 0 FROM r JOIN m USING (subject_id) WHERE {_SEES_SCANS} GROUP BY ALL""")
def c8_image_hospital_view(t):
    stay = {"hadm_id": F.concat(F.col("event_id").cast("string"), F.lit(".0"))}
    tables = {
        "admissions": _of_type(t, "purchase", **stay, admittime=stamp("event_time"), dischtime=stamp("available_time"), hospital_expire_flag=F.lit("1")),
        "diagnoses_icd": _of_type(t, "purchase", hadm_id=F.col("event_id").cast("string"), icd_code=F.col("props")),
        "patients": _of_type(t, "signup", gender=F.lit("f")),
        "tb_cxr": _scans(t),
    }
    return _counted(image_view(tables, _image_manifest(t)), admissions=F.col("hospital_expire_flag").isNotNull())


@query(f"""{BOTH}, x AS (SELECT qid, event_id, CASE WHEN event_id % 3 <> 0 AND date_trunc('second', event_time) > cutoff OR event_id % 4 <> 0 AND date_trunc('second', available_time) > cutoff THEN 'after'
  WHEN event_id % 3 <> 0 OR event_id % 4 <> 0 THEN 'before' ELSE 'unknown' END AS state FROM r JOIN m USING (subject_id))
SELECT qid, count(*) FILTER (state = 'before') AS before, count(*) FILTER (state = 'after') AS after, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state <> 'after') AS kept,
  count(*) FILTER (state <> 'after' AND event_id % 2 = 0) AS children FROM x GROUP BY 1""")
def c16_availability_filter(t):
    clock = lambda c, k: F.when(F.col("event_id") % k == 0, "n/a").otherwise(stamp(c))
    rows = asof.attach(t.records, t.manifest).select("qid", "cutoff", "event_id", clock("event_time", 3).alias("charttime"), clock("available_time", 4).alias("storetime"))
    stated, counts = asof.availability_states(rows, ["charttime", "storetime"])
    kept, children = asof.drop_proven_late(stated, {"detail": (rows.where("event_id % 2 = 0").select("qid", "event_id"), ["event_id"])})
    of = lambda df, n: df.groupBy("qid").agg(F.count("*").alias(n))
    joined = counts.join(of(kept, "kept"), "qid", "left").join(of(children["detail"], "children"), "qid", "left")
    return joined.select("qid", "before", "after", "unknown", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("children", F.lit(0)).alias("children"))


@query(f"""{BOTH}, e AS (SELECT subject_id, event_id AS episode_id, date_trunc('second', event_time) AS end_time FROM r WHERE event_type = 'purchase'),
q AS (SELECT m.qid, m.subject_id, x.episode_id, CASE WHEN m.task = 'first' THEN date_trunc('day', x.end_time) + INTERVAL 1 HOUR ELSE m.cutoff END AS cutoff
  FROM m JOIN (SELECT subject_id, min(episode_id) AS id FROM e GROUP BY 1) f USING (subject_id) JOIN e x ON x.episode_id = f.id)
SELECT q.qid, q.episode_id AS resolved_id, CASE WHEN e.end_time::DATE <> q.cutoff::DATE THEN 'ends on another day' END AS problem,
  CASE WHEN e.end_time::DATE = q.cutoff::DATE THEN strftime(e.end_time + INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') END AS cutoff FROM q JOIN e ON e.episode_id = q.episode_id""")
def c11_resolve_episode(t):
    e = t.records.where("event_type = 'purchase'").select("subject_id", F.col("event_id").alias("episode_id"), F.date_trunc("second", "event_time").cast("timestamp_ntz").alias("end_time"))
    first = e.groupBy("subject_id").agg(F.min("episode_id").alias("episode_id")).join(e, ["subject_id", "episode_id"])
    m = t.manifest.join(first, "subject_id")
    near = F.date_trunc("day", "end_time").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    m = m.select("qid", "subject_id", "episode_id", F.when(F.col("task") == "first", near).otherwise(F.col("cutoff")).alias("cutoff"))
    return asof.resolve_episode(m, e).select("qid", "resolved_id", "problem", stamp("cutoff").alias("cutoff"))


_TARGET = f"{BOTH}, g AS (SELECT m.*, x.target_id FROM m JOIN (SELECT subject_id, min(event_id) AS target_id FROM r GROUP BY 1) x USING (subject_id))"


@query(f"{_TARGET} SELECT qid, count(*) AS n, min(event_id) AS first_id FROM r JOIN g USING (subject_id) WHERE event_time < cutoff AND event_id <> target_id GROUP BY qid")
def c13_mask_target(t):
    m = t.manifest.join(t.records.groupBy("subject_id").agg(F.min("event_id").alias("target_id")), "subject_id")
    view = asof.mask_target(asof.as_of_event(t.records, m), m.withColumnRenamed("target_id", "target_id"), "event_id")
    return view.groupBy("qid").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"{_TARGET} SELECT qid, count(*) AS n, count(*) FILTER (event_id = target_id) AS would_mask FROM r JOIN g USING (subject_id) WHERE event_time < cutoff GROUP BY qid")
def c14_count_masked(t):
    m = t.manifest.join(t.records.groupBy("subject_id").agg(F.min("event_id").alias("target_id")), "subject_id")
    view = asof.mask_target(asof.as_of_event(t.records, m), m, "event_id", enabled=False)
    return view.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("would_mask").alias("would_mask"))


@query(f"""{BOTH} SELECT qid, event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 AND event_time::DATE = cutoff::DATE THEN 'unknown'
  WHEN (CASE WHEN event_id % 3 = 1 THEN date_trunc('day', event_time) ELSE date_trunc('second', event_time) END) > cutoff THEN 'after' ELSE 'before' END AS state FROM r JOIN m USING (subject_id)""")
def c15_tri_state(t):
    x, text, k = asof.attach(t.records, t.manifest), stamp("event_time"), F.col("event_id") % 3
    value = F.when(k == 0, "n/a").when(k == 1, F.substring(text, 1, 10)).otherwise(text)
    return x.select("qid", "event_id", cl.tri_state(value, F.col("cutoff")).alias("state"))


@query(f"""{BOTH} SELECT qid, count(*) AS n FROM r JOIN m USING (subject_id) WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time <= TIMESTAMP '2024-01-25'
  AND event_time < least(cutoff, TIMESTAMP '2024-01-15') GROUP BY qid""")
def c17_c19_clamped_range(t):
    m = asof.clamp_cutoff(t.manifest, F.lit("2024-01-15").cast("timestamp_ntz"))
    x = asof.clamp_range(asof.attach(t.records, m, "event_time"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))
    return x.groupBy("qid").agg(F.count("*").alias("n"))


@query(f"""{BOTH} SELECT qid, count(*) AS input_rows, count(*) FILTER (event_time < cutoff AND available_time < cutoff) AS output_rows,
  count(*) FILTER (event_time >= cutoff) AS not_yet_happened, count(*) FILTER (event_time < cutoff AND available_time >= cutoff) AS not_yet_known FROM r JOIN m USING (subject_id) GROUP BY qid""")
def e4_view_report(t):
    return asof.view_report(t.records, t.manifest)
