"""Queries for sources and sinks (A) and streams (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..operators.scoring import score_sets
from ..plans import policies as pol, record_policies as rp, snapshots as snap
from ..plans.registry import BOTH, query, stamp
from ..sources import io
from ..streaming import streams as st


@query("SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def a1_scan_table_dir(t):
    path = io.work_path(t.spark, "scan")
    t.events.select("event_id", "user_id", "event_type", stamp("ts").alias("ts")).write.option("header", True).csv(f"{path}/events.csv")
    df = io.scan_table_dir(t.spark, path)["events"]
    return df.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", "ts")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a3_incremental_subjects(t):
    return io.incremental_subjects(t.customer, t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT 'events' AS table_name, event_id AS id FROM events WHERE user_id = 7 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey = 7")
def a4_a5_subject_store(t):
    path = io.work_path(t.spark, "store")
    tables = {"events": t.events.select("event_id", F.col("user_id").alias("subject_id")), "orders": t.orders.select("o_orderkey", F.col("o_custkey").alias("subject_id"))}
    io.write_subject_store(tables, path)
    read = io.read_subject_tables(t.spark, path, list(tables), 7)
    return read["events"].select(F.lit("events").alias("table_name"), F.col("event_id").alias("id")).unionByName(read["orders"].select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id")))


@query("SELECT p_brand, count(*) AS n, min(p_name) AS first_name FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1")
def a6_load_reference(t):
    from ..operators.joins import enrich

    used = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct()
    return enrich(used, t.part, ["p_partkey"]).where("p_name is not null").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


@query(f"WITH {BOTH[5:]} SELECT qid, subject_id, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff FROM m")
def a7_read_manifest(t):
    path = io.work_path(t.spark, "manifest")
    t.manifest.select("qid", "subject_id", stamp("cutoff").alias("cutoff")).write.json(path)
    return io.read_manifest(t.spark, path, "qid:string, subject_id:bigint, cutoff:string")


@query("SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS good, count(*) FILTER (o_orderkey % 10 = 0) AS malformed FROM orders")
def a8_read_results(t):
    path = io.work_path(t.spark, "results")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("status")))
    t.orders.select(F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    rows, bad = io.read_results(t.spark, path, "qid long, status string")
    return rows.agg(F.count("*").alias("good")).crossJoin(bad)


@query("""WITH u AS (SELECT c_custkey AS qid, c_name AS name, NULL AS extra FROM customer UNION ALL SELECT s_suppkey + 1000000, NULL, s_name FROM supplier) SELECT qid, name, extra FROM u ORDER BY ('0x' || substr(md5('4:' || qid), 1, 8))::BIGINT, qid LIMIT 50""")
def a10_concat_sources(t):
    a = t.customer.select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("name"))
    b = t.supplier.select((F.col("s_suppkey") + 1000000).alias("qid"), F.col("s_name").alias("extra"))
    return io.concat_sources([a, b], 50, 4)


@query(f"{BOTH}, f AS (SELECT qid, count(*) AS n FROM r JOIN m USING (subject_id) WHERE event_time < cutoff GROUP BY 1), k AS (SELECT qid, count(*) AS n FROM r JOIN m USING (subject_id) WHERE event_time < cutoff AND event_type = 'error' GROUP BY 1) SELECT 'full' AS view, 'events' AS table_name, qid, n AS n_rows, 'qid,event_id,value' AS columns FROM f UNION ALL SELECT 'recent', 'events', qid, n, 'qid,event_id' FROM k")
def a11_write_views(t):
    seen = asof.as_of_event(t.records, t.manifest)
    views = {("full", "events"): seen.select("qid", "event_id", "value"), ("recent", "events"): seen.where("event_type = 'error'").select("qid", "event_id")}
    return io.write_views(views, io.work_path(t.spark, "views")).drop("checksum")


@query("SELECT o_orderkey AS pos, o_custkey FROM orders")
def a12_shards(t):
    m = t.orders.select(F.col("o_orderkey").alias("pos"), "o_custkey")
    return io.merge_shards([io.shard(m, i, 4) for i in range(4)], 4)


@query(f"{BOTH} SELECT subject_id, count(DISTINCT cutoff) AS cutoffs FROM m GROUP BY 1 HAVING count(DISTINCT cutoff) > 1")
def a13_snapshot_conflicts(t):
    return io.cutoff_conflicts(t.manifest)


@query("SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM conversations GROUP BY ALL")
def a14_write_train_val(t):
    from .texts import messages

    none = F.lit(None).cast("string")
    wide = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), none.alias("reasoning_content"), none.alias("tool_call_id"), m["tool_calls"].alias("tool_calls")))
    path = io.work_path(t.spark, "train")
    io.write_train_val(messages(t).withColumn("messages", wide).withColumn("split", F.when(F.col("conv_id") % 5 == 0, "val").otherwise("train")), path)
    return t.spark.read.parquet(path).select("conv_id", "split", F.size("messages").cast("bigint").alias("n"))


@query("SELECT o_orderkey AS qid FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0")
def a15_resume(t):
    m = t.orders.select(F.col("o_orderkey").alias("qid"))
    results = m.where("qid % 3 <> 0").withColumn("status", F.when(F.col("qid") % 4 == 0, "error").otherwise("incomplete"))
    return io.resume(m, results)


@query("""WITH c AS (SELECT 't' || l_orderkey AS table_name, 'c' || l_linenumber || '_' || l_partkey AS column_name, max('d' || l_suppkey) AS description FROM lineitem GROUP BY ALL), l AS (SELECT 't' || o_orderkey AS a, 't' || (o_orderkey + 1) AS b FROM orders)
SELECT table_name, column_name, description FROM c UNION ALL SELECT a, column_name, description FROM l JOIN c ON c.table_name = b WHERE NOT EXISTS (FROM c AS own WHERE own.table_name = a AND own.column_name = c.column_name)""")
def a16_describe(t):
    tab = lambda k: F.concat(F.lit("t"), k.cast("string"))
    named = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"))
    columns = t.lineitem.groupBy(tab(F.col("l_orderkey")).alias("table_name"), named.alias("column_name")).agg(F.max(F.concat(F.lit("d"), F.col("l_suppkey").cast("string"))).alias("description"))
    links = t.orders.select(tab(F.col("o_orderkey")).alias("table_name"), tab(F.col("o_orderkey") + 1).alias("link_table"))
    return io.describe(columns, links)


@query("""WITH q AS (SELECT l_orderkey AS qid, list_distinct(list(lower('P' || l_partkey))) AS g, list_distinct(list('p' || l_partkey) FILTER (l_linenumber <= 2)) AS p FROM lineitem GROUP BY 1)
SELECT qid, 0 AS run_index, 'ok' AS status, round(CASE WHEN p IS NULL THEN 0 ELSE 2.0 * len(p) / (len(p) + len(g)) END, 9) AS f1 FROM q""")
def s1_score_stream(t):
    gold = F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    pred = F.collect_set(F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(gold.alias("gold"), pred.alias("pred"))
    source, out = io.work_path(t.spark, "in"), io.work_path(t.spark, "scores")
    q.withColumn("run_index", F.lit(0)).withColumn("status", F.lit("error")).write.json(source)
    schema = "qid long, run_index int, status string, gold array<string>, pred array<string>"
    st.score_stream(st.read_results_stream(t.spark, source, schema), out, f"{out}-state").awaitTermination()
    q.withColumn("run_index", F.lit(0)).withColumn("status", F.lit("ok")).write.mode("append").json(source)
    st.score_stream(st.read_results_stream(t.spark, source, schema), out, f"{out}-state").awaitTermination()
    return st.latest_scores(t.spark, out).select("qid", "run_index", "status", F.round("f1", 9).alias("f1"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM c),
n AS (SELECT user_id, i, any_value(event_type) AS signature, count(*) AS streak FROM i GROUP BY ALL), l AS (SELECT user_id, max(streak) AS longest FROM n GROUP BY 1) SELECT user_id AS session, signature, streak, longest AS longest_in_batch FROM n JOIN l USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def s2_streak_stream(t):
    source, out = io.work_path(t.spark, "turns"), io.work_path(t.spark, "streaks")
    t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature")).write.parquet(source)
    turns = t.spark.readStream.schema("session long, seq long, signature string").option("maxFilesPerTrigger", 1000).parquet(source)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    st.streak_stream(turns).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.option("basePath", out).parquet(f"{out}/epoch=*").select("session", "signature", "streak", "longest_in_batch")


@query(f"{BOTH} SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (available_time > event_time + INTERVAL 1 HOUR) AS late FROM r GROUP BY 1")
def s3_late_arrivals(t):
    return st.late_arrivals(t.records).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "late")


#: Events as twelve record tables, by their number: what each has of an event, and what its policy leaves.
RECORD = """e AS (SELECT event_id, user_id AS subject_id, date_trunc('second', ts) AS a, date_trunc('second', ts + to_seconds(round(value * 60))) AS b, (event_id % 12)::INTEGER AS k, event_id::VARCHAR AS x FROM events),
q AS (SELECT e.*, m.qid, m.cutoff FROM e JOIN m USING (subject_id)),
s AS (SELECT qid, ['labevents', 'chartevents', 'outputevents', 'datetimeevents', 'transfers', 'prescriptions', 'poe', 'omr', 'icustays', 'services', 'inputevents', 'pharmacy'][k + 1] AS table_name,
  CASE WHEN k <= 3 OR k = 11 THEN a < cutoff AND b < cutoff WHEN k = 7 THEN date_trunc('day', a) + INTERVAL 1 DAY <= cutoff ELSE a < cutoff END AS seen, k NOT IN (4, 5, 8, 10) OR b < cutoff AS known FROM q)"""


def record_tables(t):
    """Text tables, as they come: times to the second, every column text."""
    r = t.records.select(F.col("subject_id"), F.col("event_id").cast("string").alias("x"), stamp("event_time").alias("a"), stamp("available_time").alias("b"), (F.col("event_id") % 12).alias("k"))
    names = {
        "labevents": {"labevent_id": "x", "charttime": "a", "storetime": "b"}, "chartevents": {"itemid": "x", "charttime": "a", "storetime": "b"},
        "outputevents": {"itemid": "x", "charttime": "a", "storetime": "b"}, "datetimeevents": {"itemid": "x", "charttime": "a", "storetime": "b"},
        "transfers": {"transfer_id": "x", "intime": "a", "outtime": "b"}, "prescriptions": {"drug": "x", "starttime": "a", "stoptime": "b"},
        "poe": {"poe_id": "x", "ordertime": "a", "order_status": "b"}, "omr": {"result_value": "x", "chartdate": "substring(a, 1, 10)"},
        "icustays": {"stay_id": "x", "intime": "a", "outtime": "b", "los": "x"}, "services": {"curr_service": "x", "transfertime": "a"},
        "inputevents": {"itemid": "x", "starttime": "a", "endtime": "b", "storetime": "b", "amount": "x"}, "pharmacy": {"pharmacy_id": "x", "entertime": "a", "verifiedtime": "b", "status": "x"},
    }
    tables = {n: r.where(F.col("k") == i).selectExpr("subject_id", *[f"{v} AS {c}" for c, v in columns.items()]) for i, (n, columns) in enumerate(names.items())}
    return tables, {n: list(df.columns) for n, df in tables.items()}


@query(f"{BOTH}, {RECORD} SELECT qid, table_name, count(*) AS n, count(*) FILTER (known) AS known FROM s WHERE seen GROUP BY ALL")
def c5_record_tables(t):
    tables, allowed = record_tables(t)
    views = pol.point_in_time_view(tables, t.manifest, rp.TABLES, allowed)
    guarded = {"transfers": "outtime", "prescriptions": "stoptime", "icustays": "los", "inputevents": "amount"}
    out = None
    for name, view in views.items():
        own = view.groupBy("qid").agg(F.count("*").alias("n"), F.count(guarded.get(name, "subject_id")).alias("known")).withColumn("table_name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{BOTH}, {RECORD}, p AS (SELECT qid, a, b, cutoff FROM q WHERE k = 5) SELECT qid, count(*) AS input_rows, count(*) FILTER (a < cutoff) AS output_rows, count(*) FILTER (a >= cutoff) AS dropped_rows,
  count(*) FILTER (a < cutoff AND b >= cutoff) AS redacted, count(*) FILTER (a < cutoff AND b >= cutoff) AS future, 0::BIGINT AS unparseable FROM p GROUP BY 1""")
def e4_table_report(t):
    return pol.table_report(record_tables(t)[0]["prescriptions"], t.manifest, rp.TABLES["prescriptions"])


@query(f"""{BOTH}, {RECORD}, v AS (SELECT CASE k WHEN 0 THEN 'labevents' ELSE 'transfers' END AS table_name, unnest(CASE k WHEN 0 THEN ['charttime', 'storetime'] ELSE ['intime', 'outtime'] END) AS c, unnest([a, b]) AS x, cutoff FROM q WHERE k IN (0, 4))
SELECT table_name, 'future ' || c AS rule, count(*) AS n FROM v WHERE x >= cutoff GROUP BY ALL""")
def e6_audit_views(t):
    """The audit of views that were never cut: all that a policy would have hidden."""
    tables = record_tables(t)[0]
    raw = {n: tables[n].join(t.manifest.select("qid", "subject_id", "cutoff"), "subject_id") for n in ("labevents", "transfers")}
    return pol.audit_views(raw, rp.TABLES)


#: The strict policies over subjects at their first question's cutoff.
STRICT = f"{BOTH}, {RECORD}, z AS (SELECT * FROM q WHERE qid LIKE '%#_0' ESCAPE '#')"


@query(f"""{STRICT} SELECT qid AS subject_id, table_name, n FROM (SELECT subject_id::VARCHAR AS qid, ['labevents', 'chartevents', 'outputevents', 'datetimeevents', 'transfers', 'prescriptions', 'poe', 'omr', 'icustays', 'services', 'inputevents', ''][k + 1] AS table_name, count(*) AS n FROM z
WHERE k < 11 AND CASE WHEN k <= 3 THEN a < cutoff AND b < cutoff WHEN k = 7 THEN date_trunc('day', a) + INTERVAL 1 DAY <= cutoff WHEN k = 10 THEN b < cutoff ELSE a < cutoff END GROUP BY ALL)""")
def c18_a13_snapshots(t):
    """Built in two calls, the second of which finds all but a few subjects in place, then read back."""
    tables, allowed = record_tables(t)
    subjects = t.manifest.where("task = 'first'").select("subject_id", "cutoff")
    path = io.work_path(t.spark, "snapshots")
    snap.build_snapshots(tables, subjects.where("subject_id % 10 > 0"), allowed, path)
    snap.build_snapshots(tables, subjects, allowed, path, anew=subjects.where("subject_id % 10 = 1"))
    return snap.current(t.spark, path).where("n_rows > 0").select("subject_id", "table_name", F.col("n_rows").alias("n"))
