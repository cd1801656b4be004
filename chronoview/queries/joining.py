"""Queries for joins (D), sets (G) and the views built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, joins, linking
from ..plans import policies as pol
from ..plans.registry import BOTH, RECORDS, query, stamp

#: Orders as encounters with an end; lines as their children.
ENC = "e AS (SELECT o_orderkey, o_custkey, o_orderdate AS start, e.e AS stop FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) e ON l_orderkey = o_orderkey)"
QM = "q AS (SELECT 'c' || c_custkey AS qid, c_custkey AS o_custkey, TIMESTAMP '1997-01-01' + to_days((c_custkey % 900)::INTEGER) AS cutoff FROM customer)"
VIS = f"WITH {ENC}, {QM}, v AS (SELECT q.qid, q.cutoff, e.* FROM e JOIN q USING (o_custkey) WHERE e.start < q.cutoff AND e.stop < q.cutoff)"


def encounters(t):
    ends = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop"))
    return t.orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start"), "stop")


def customers(t):
    days = F.make_dt_interval((F.col("c_custkey") % 900).cast("int"))
    return t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_custkey").alias("o_custkey"), (F.lit("1997-01-01").cast("timestamp_ntz") + days).alias("cutoff"))


def visible(t):
    e = asof.attach(encounters(t), customers(t), "start", subject="o_custkey")
    return e.where((F.col("start") < F.col("cutoff")) & (F.col("stop") < F.col("cutoff")))


@query(f"{VIS} SELECT v.qid, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN v ON l_orderkey = o_orderkey GROUP BY 1")
def d1_visible_parent(t):
    v = visible(t).withColumnRenamed("o_orderkey", "l_orderkey")
    child = t.lineitem.join(v.select("qid", "l_orderkey"), "l_orderkey")
    return joins.visible_parent(child, v, ["l_orderkey"]).groupBy("qid").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"{VIS} SELECT v.qid, count(*) AS n FROM lineitem JOIN v ON l_orderkey = o_orderkey WHERE l_shipdate < cutoff AND l_shipdate <= stop GROUP BY 1")
def d2_parent_constraints(t):
    v = visible(t)
    child = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    own = asof.as_of_event(child, customers(t), "l_shipdate", subject="o_custkey")
    return joins.visible_parent(own, v.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).groupBy("qid").agg(F.count("*").alias("n"))


@query(f"{VIS} SELECT v.qid, l_orderkey, l_linenumber, strftime(stop + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS derived_time FROM lineitem JOIN v ON l_orderkey = o_orderkey WHERE stop + INTERVAL 24 HOUR < cutoff")
def d3_derive_parent_time(t):
    v = visible(t).withColumnRenamed("o_orderkey", "l_orderkey")
    policy = pol.ChildPolicy("orders", ("l_orderkey",), "stop", 86400)
    return pol.child_view(t.lineitem.select("l_orderkey", "l_linenumber"), v, policy).select("qid", "l_orderkey", "l_linenumber", stamp("derived_time").alias("derived_time"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def d4_enrich(t):
    c = joins.enrich(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"])
    return joins.enrich(c.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"]).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def d5_orphans(t):
    return joins.orphans(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"{BOTH} SELECT qid, r.event_id FROM r JOIN m USING (subject_id) WHERE task = 'first' AND (event_id % 3 = 0)")
def d6_linked_allowlist(t):
    ids = t.records.where("event_id % 3 = 0").groupBy("subject_id").agg(F.collect_list("event_id").alias("ids"))
    m = t.manifest.join(ids, "subject_id").withColumn("ids", F.when(F.col("task") == "first", F.col("ids")).otherwise(F.array().cast("array<bigint>")))
    return joins.linked_allowlist(t.records, m, "event_id", "ids").select("qid", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def d7_cascade_children(t):
    parents = t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.cascade_children({"orders": parents, "lineitem": t.lineitem}, "orders", "lineitem", ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query(f"WITH {ENC}, {QM} SELECT l_linenumber, l_partkey, l_suppkey, CASE WHEN e.start > q.cutoff THEN NULL ELSE l_orderkey END AS l_orderkey FROM lineitem JOIN e ON l_orderkey = o_orderkey JOIN q USING (o_custkey)")
def d8_blank_future_ids(t):
    rows = t.lineitem.join(encounters(t).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(customers(t), "o_custkey")
    starts = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return joins.blank_future_ids(rows, starts, "l_orderkey", "o_orderdate").select("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")


@query("""WITH raw AS (SELECT l_partkey AS k, CASE l_returnflag WHEN 'A' THEN 'before' WHEN 'N' THEN 'after' ELSE 'unknown' END AS state FROM lineitem WHERE l_linenumber <= 3),
c AS (SELECT k, count(*) FILTER (state = 'before') AS a, count(*) FILTER (state = 'after') AS l, count(*) FILTER (state = 'unknown') AS u FROM raw GROUP BY k),
v AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS i FROM lineitem WHERE l_linenumber <= 2)
SELECT k, l_orderkey, l_linenumber FROM v LEFT JOIN c USING (k)
WHERE i > coalesce(CASE WHEN a + u = 0 THEN least(n, l) WHEN n > a + u THEN least(l, n - a - u) ELSE 0 END, 0)""")
def d9_multiset_provenance(t):
    state = F.when(F.col("l_returnflag") == "A", "before").when(F.col("l_returnflag") == "N", "after").otherwise("unknown")
    raw = t.lineitem.where("l_linenumber <= 3").select(F.col("l_partkey").alias("k"), state.alias("state"))
    view = t.lineitem.where("l_linenumber <= 2").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return joins.multiset_provenance(view, raw, ["k"], "pos").select("k", "l_orderkey", "l_linenumber")


@query(f"WITH {QM}, x AS (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT o_orderkey FROM orders JOIN q USING (o_custkey) LEFT JOIN x ON l_orderkey = o_orderkey WHERE f IS NULL OR f <= cutoff")
def d10_order_anchors(t):
    rows = t.orders.join(customers(t), "o_custkey")
    anchors = t.lineitem.where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return joins.order_anchors(rows, anchors, "o_orderkey", "l_shipdate").select("o_orderkey")


@query(f"WITH {ENC}, {QM} SELECT e.o_orderkey, CASE WHEN stop <= cutoff THEN o_totalprice END AS o_totalprice FROM e JOIN q USING (o_custkey) JOIN orders o ON o.o_orderkey = e.o_orderkey")
def d11_restore_outcomes(t):
    stays = encounters(t).join(customers(t), "o_custkey").withColumn("o_totalprice", F.lit(None).cast("double"))
    raw = encounters(t).join(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    return joins.restore_outcomes(stays, raw, "o_orderkey", "stop", ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query(r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b), dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
s AS (SELECT item_id, doc_id, count(*)::DOUBLE / (bt.n + dt.n - count(*)) AS score FROM bt JOIN dt USING (t) GROUP BY item_id, doc_id, bt.n, dt.n),
k AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY score DESC) AS r FROM s),
o AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS c FROM k WHERE r = 1) SELECT item_id, doc_id, score FROM o WHERE c = 1""")
def d12_link_reports(t):
    tokens = linking.report_tokens(F.col("text"), None, "[a-z]+").alias("tokens")
    return linking.link_reports(t.benchmark.select("item_id", tokens), t.documents.select("doc_id", tokens), "item_id", "doc_id")


@query(f"""{BOTH}, d AS (SELECT subject_id, 86400 * (subject_id % 11 + CASE WHEN subject_id % 4 = 0 AND event_id % 50 = 0 THEN 1 ELSE 0 END) AS d FROM r)
SELECT subject_id, min(d) AS shift_seconds, count(*) AS witnesses FROM d GROUP BY 1 HAVING min(d) = max(d)""")
def d13_patient_offset(t):
    """Of every fourth subject some witnesses disagree; those of which all agree stay."""
    r = t.records
    extra = F.when((F.col("subject_id") % 4 == 0) & (F.col("event_id") % 50 == 0), 1).otherwise(0)
    moved = r.withColumn("event_time", F.col("event_time") + F.make_dt_interval((F.col("subject_id") % 11 + extra).cast("int")))
    return joins.patient_offset(r, moved, ["event_id"], "subject_id", "event_time")


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderpriority <> '1-URGENT')), ',') AS ids FROM orders GROUP BY 1")
def d14_filter_reports(t):
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    late = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    kept = joins.filter_reports(lists, late, "o_custkey", "ids", "id")
    return kept.select("o_custkey", F.when(F.size("ids") > 0, F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",")).alias("ids"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey AS own_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
gold AS (SELECT g.o_custkey, own_id, list_distinct(list(l_returnflag)) AS gold FROM g JOIN lineitem ON l_orderkey = own_id GROUP BY ALL),
s AS (SELECT o_custkey, o_orderkey, list_distinct(list(l_returnflag)) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'c' || gold.o_custkey AS qid, count(*) AS candidates, own_id AS target_id FROM gold JOIN s USING (o_custkey) WHERE len(list_filter(gold, lambda x: NOT list_contains(codes, x))) = 0 GROUP BY ALL""")
def d15_target_by_labels(t):
    codes = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("subject_id"), "o_orderkey", "l_returnflag")
    own = t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.min("o_orderkey").alias("own_id"))
    gold = own.join(codes, "subject_id").where("o_orderkey = own_id").groupBy("subject_id", "own_id").agg(F.collect_set("l_returnflag").alias("gold"))
    m = gold.withColumn("qid", F.concat(F.lit("c"), F.col("subject_id").cast("string")))
    return joins.target_by_labels(m, codes, "o_orderkey", "l_returnflag")


@query(f"""WITH {ENC}, q AS (SELECT 'c' || c_custkey AS qid, c_custkey AS o_custkey, TIMESTAMP '1998-01-01 00:00:01' + to_days((c_custkey % 500)::INTEGER) AS cutoff FROM customer),
x AS (SELECT qid, count(DISTINCT CASE WHEN stop = cutoff - INTERVAL 1 SECOND THEN o_orderkey END) AS en, min(CASE WHEN stop = cutoff - INTERVAL 1 SECOND THEN o_orderkey END) AS e,
  count(DISTINCT CASE WHEN start < cutoff AND cutoff <= stop THEN o_orderkey END) AS rn, min(CASE WHEN start < cutoff AND cutoff <= stop THEN o_orderkey END) AS r FROM q JOIN e USING (o_custkey) GROUP BY 1)
SELECT qid, coalesce(CASE WHEN en = 1 THEN e END, CASE WHEN rn = 1 THEN r END) AS target_id FROM x""")
def d16_target_by_interval(t):
    m = customers(t).select("qid", F.col("o_custkey").alias("subject_id"), (F.lit("1998-01-01 00:00:01").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_custkey") % 500).cast("int"))).alias("cutoff"))
    return joins.target_by_interval(m, encounters(t).withColumnRenamed("o_custkey", "subject_id"), "o_orderkey", "start", "stop")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM orders")
def d17_restore_fields(t):
    up = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return joins.restore_fields(t.orders, up, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "status")


@query(f"{BOTH}, j AS (SELECT qid, event_id, date_trunc('hour', event_time) AS h, cutoff FROM r JOIN m USING (subject_id) WHERE date_trunc('hour', event_time) BETWEEN cutoff - INTERVAL 3 DAY AND cutoff), k AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY h DESC) AS rk FROM j) SELECT m.qid, array_to_string(list_sort(list(event_id) FILTER (rk = 1)), ',') AS latest, strftime(max(h), '%Y-%m-%d %H:%M:%S') AS latest_time FROM m LEFT JOIN k USING (qid) GROUP BY 1")
def d18_latest_in_window(t):
    m = t.manifest.withColumn("start", F.col("cutoff") - F.expr("INTERVAL 3 DAYS"))
    s = t.records.withColumn("hour", F.date_trunc("hour", "event_time").cast("timestamp_ntz"))
    return joins.latest_in_window(m, s, "event_id", "hour").select("qid", F.array_join(F.transform("latest", lambda x: x.cast("string")), ",").alias("latest"), stamp("latest_time").alias("latest_time"))


@query("""WITH f AS (SELECT l_orderkey, (l_returnflag = 'A')::INT AS a, (l_linestatus = 'O')::INT AS o FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)
SELECT o_orderkey, CASE WHEN f.l_orderkey IS NULL THEN 'missing' WHEN a = 1 AND o = 0 THEN 'ok' ELSE 'different' END AS status FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def d19_verify_against_list(t):
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("rank")
    listing = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "A").cast("int").alias("is_a"), (F.col("l_linestatus") == "O").cast("int").alias("is_o"), rank)
    return joins.verify_against_list(t.orders.withColumn("labels", F.array(F.lit("is_a"))), listing, ["o_orderkey"], ["is_a", "is_o"], "rank").select("o_orderkey", "status")


@query("SELECT DISTINCT 'c' || o_custkey AS qid, o_orderkey AS study, 'p/' || o_orderkey AS path FROM orders")
def d20_d28_explode_linked(t):
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("s")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("qid"), "s", F.transform("s", lambda x: F.concat(F.lit("p/"), x.cast("string"))).alias("p"))
    return joins.explode_linked(lists, ["s", "p"], ["study", "path"])


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def d21_a2_filter_to_subjects(t):
    from ..sources.io import subset_by_subject

    stays = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return subset_by_subject({"events": t.events}, stays, "user_id")["events"].select("event_id", "user_id")


@query("SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 10 = 3 THEN 0 WHEN o_orderkey % 10 = 4 THEN 2 ELSE 1 END AS n, CASE WHEN o_orderkey % 10 = 3 THEN 'missing' WHEN o_orderkey % 10 = 4 THEN 'repeated' END AS problem FROM orders")
def d22_g3_combine_subsets(t):
    keys = t.orders.select(F.col("o_orderkey").alias("qid"))
    return joins.combine_subsets(keys, [keys.where("qid % 10 not in (3)"), keys.where("qid % 10 = 4")])


@query("SELECT 'c' || o_custkey AS qid, path, CASE WHEN path[1] = '/' THEN 'absolute' ELSE 'absent' END AS problem FROM (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN '/' ELSE '' END || 'img/' || o_orderkey AS path, o_orderkey AS k FROM orders) WHERE k % 9 = 0 OR k % 4 = 1")
def d23_asset_presence(t):
    path = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "/").otherwise(""), F.lit("img/"), F.col("o_orderkey").cast("string"))
    m = t.orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("qid")).agg(F.collect_list(path).alias("paths"))
    listing = t.orders.where("o_orderkey % 4 <> 1").select(F.concat(F.lit("img/"), F.col("o_orderkey").cast("string")).alias("path"))
    return joins.asset_presence(m, "paths", listing)


BLOCKS = f"""{BOTH}, h AS (SELECT DISTINCT qid, cutoff, date_trunc('day', event_time) AS start FROM r JOIN m USING (subject_id) WHERE event_time < cutoff),
b AS (SELECT *, lead(start) OVER (PARTITION BY qid ORDER BY start) AS stop FROM h)"""


def _blocks(t):
    pool = asof.as_of_event(t.records, t.manifest)
    heads = pool.select("qid", F.date_trunc("day", "event_time").cast("timestamp_ntz").alias("start")).distinct()
    return pool, joins.blocks(heads, ["qid"])


@query(f"{BLOCKS} SELECT qid, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stop FROM b")
def f8_block_intervals(t):
    return _blocks(t)[1].select("qid", stamp("start").alias("start"), stamp("stop").alias("stop"))


@query(f"{BLOCKS} SELECT b.qid, event_id FROM r JOIN m USING (subject_id) JOIN b ON b.qid = m.qid AND event_time >= start AND (CASE WHEN stop IS NULL THEN event_time <= m.cutoff ELSE event_time < stop END) WHERE event_time < m.cutoff AND day(start) % 2 = 0")
def d24_select_blocks(t):
    pool, blocks = _blocks(t)
    return joins.select_blocks(pool, blocks.where(F.dayofmonth("start") % 2 == 0), ["qid"], "event_time").select("qid", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def d25_children_follow_selected(t):
    return joins.visible_parent(t.lineitem, t.orders.where("o_totalprice > 300000").withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query(f"""{BOTH}, v AS (SELECT m.qid, m.cutoff, r.* FROM r JOIN m USING (subject_id) WHERE event_time < cutoff AND available_time < cutoff AND event_type IN ('purchase', 'signup')),
p AS (SELECT DISTINCT qid, cutoff, subject_id, max(event_time) OVER (PARTITION BY qid) AS t FROM v WHERE event_type = 'purchase')
SELECT 'visits' AS table_name, qid, count(*) AS n, round(sum(value), 2) AS total FROM v WHERE event_type = 'purchase' GROUP BY ALL
UNION ALL SELECT 'codes', v.qid, count(*), round(sum(r.value), 2) FROM (SELECT DISTINCT qid, cutoff, event_id, event_time FROM v WHERE event_type = 'purchase') v JOIN r ON r.event_id = v.event_id WHERE v.event_time + INTERVAL 1 DAY < v.cutoff GROUP BY v.qid""")
def c5_point_in_time_view(t):
    r = t.records.where("event_type = 'purchase'").select("subject_id", "event_id", "event_time", "available_time", "value")
    tables = {"visits": r, "codes": r.select("event_id", F.col("value").alias("code_value"))}
    rules = {"visits": pol.TablePolicy(("event_time",), ("available_time",)), "codes": pol.ChildPolicy("visits", ("event_id",), "event_time", 86400)}
    view = pol.point_in_time_view(tables, t.manifest, rules, {"visits": r.columns, "codes": ["event_id", "code_value"]})
    parts = [view["visits"].select(F.lit("visits").alias("table_name"), "qid", "value"), view["codes"].select(F.lit("codes").alias("table_name"), "qid", F.col("code_value").alias("value"))]
    return parts[0].unionByName(parts[1]).groupBy("table_name", "qid").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"{BOTH}, f AS (SELECT qid, event_id FROM r JOIN m USING (subject_id) WHERE event_time < cutoff), c AS (SELECT qid, event_id FROM f WHERE event_id % 2 = 0 UNION ALL SELECT qid, -1 FROM m WHERE task = 'first') SELECT qid, event_id FROM c EXCEPT SELECT qid, event_id FROM f")
def g1_not_in_full(t):
    from ..operators.sets import outside

    full = asof.as_of_event(t.records, t.manifest).select("qid", "event_id")
    recent = full.where("event_id % 2 = 0").unionByName(t.manifest.where("task = 'first'").select("qid", F.lit(-1).cast("bigint").alias("event_id")))
    return outside(recent, full)


@query(f"{BOTH} SELECT qid, event_id, value, NULL::VARCHAR AS note FROM r JOIN m USING (subject_id) WHERE event_time < cutoff AND event_type <> 'error' UNION ALL SELECT qid, event_id, NULL, 'late' FROM r JOIN m USING (subject_id) WHERE event_time < cutoff AND event_type = 'error'")
def g2_c12_union_restored(t):
    from ..operators.sets import restore

    view = asof.as_of_event(t.records, t.manifest)
    base = view.select("qid", "event_id", "value")
    notes = view.where("event_type = 'error'").select("qid", "event_id", F.lit("late").alias("note"))
    return restore(base, notes, ["qid", "event_id"])


@query(f"{BOTH}, u AS (SELECT DISTINCT event_type FROM r), x AS (SELECT DISTINCT qid, event_type FROM r JOIN m USING (subject_id) WHERE event_time >= cutoff) SELECT qid, event_type FROM x WHERE event_type IN ('click', 'view')")
def g4_changed_tables(t):
    from ..operators.sets import common

    flagged = asof.attach(t.records, t.manifest).where("event_time >= cutoff").select("qid", "event_type").distinct()
    used = t.manifest.select("qid", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("event_type"))
    return common(used, flagged, ["qid", "event_type"])


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber <= 2))) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(a = b, false) AS same, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))) = 0 AS contained FROM s""")
def g5_label_sets(t):
    from ..operators.sets import contained, same_set

    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_returnflag"))).alias("b"))
    return s.select("l_orderkey", same_set(F.col("a"), F.col("b")).alias("same"), contained(F.col("b"), F.col("a")).alias("contained"))


@query("SELECT o_orderstatus AS source, count(DISTINCT o_custkey) AS images FROM orders GROUP BY 1")
def g6_linked_per_source(t):
    lists = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.collect_list("o_custkey").alias("ids"))
    return lists.select(F.col("o_orderstatus").alias("source"), F.explode("ids").alias("id")).distinct().groupBy("source").agg(F.count("*").alias("images"))
