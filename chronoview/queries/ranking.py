"""Queries for ranking (F) and record queries and audits (E1 to E8, H1 to H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, balance, fuzzy, leakage as leak, ranking as rk, records as rec, retrieval as ret
from ..plans.registry import BOTH, query, stamp

SEEN = f"{BOTH}, v AS (SELECT m.qid, m.cutoff, r.* FROM r JOIN m USING (subject_id) WHERE event_time < cutoff)"
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def seen(t):
    return asof.as_of_event(t.records, t.manifest)


@query(f"{SEEN} SELECT qid, event_id FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY date_trunc('day', event_time) DESC) AS k FROM v) WHERE k = 1")
def f1_latest_records(t):
    return rk.latest_records(seen(t).withColumn("day", F.date_trunc("day", "event_time")), "day").select("qid", "event_id")


@query(f"{SEEN} SELECT qid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY greatest(event_time, available_time) DESC, event_id) AS k FROM v) WHERE k <= 5")
def f2_f3_recent_top_k(t):
    return rk.recent_top_k(seen(t), 5, ["event_time", "available_time"], "event_id").select("qid", "event_id")


@query(f"{SEEN} SELECT qid, event_id, least(8, total) AS shown, total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY event_time DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY qid) AS total FROM v) WHERE k <= 8")
def f4_latest_n(t):
    return rk.latest_n(seen(t), 8, "event_time", "event_id").select("qid", "event_id", F.col("shown").cast("bigint").alias("shown"), "total")


@query(f"{SEEN} SELECT qid, event_id FROM (SELECT *, sum(length(props) + length(event_type)) OVER (PARTITION BY qid ORDER BY event_time DESC RANGE UNBOUNDED PRECEDING) AS c FROM v) WHERE c <= 200")
def f5_fit_to_budget(t):
    return rk.fit_to_budget(seen(t), F.length("props") + F.length("event_type"), 200, "event_time").select("qid", "event_id")


@query(f"""{SEEN}, p AS (SELECT *, length(props) AS c FROM v), h AS (SELECT qid, event_type, max(event_time) AS t, 5 + length(event_type) AS c FROM p GROUP BY ALL),
x AS (SELECT qid, event_time AS t, c FROM p UNION ALL SELECT qid, t, c FROM h), s AS (SELECT qid, t, 20 + sum(sum(c)) OVER (PARTITION BY qid ORDER BY t DESC) AS through FROM x GROUP BY qid, t),
b AS (SELECT qid, min(t) AS start FROM s WHERE through <= 200 GROUP BY 1) SELECT p.qid, event_id FROM p JOIN b ON b.qid = p.qid WHERE event_time >= start""")
def f5_fit_to_budget_exact(t):
    view = seen(t).select("qid", "event_id", "event_time", "props", "event_type")
    return rk.fit_to_budget_exact(view, F.length("props"), 200, "event_time", "event_type", 5 + F.length("event_type"), 20).select("qid", "event_id")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT p_name AS candidate FROM part), k AS (SELECT unnest(['red widget', 'blue blot', 'ring']) AS keyword),
p AS (SELECT candidate, keyword, lower(candidate) AS x, lower(keyword) AS y FROM v CROSS JOIN k),
l AS (SELECT candidate, keyword, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda z: 0) AS row FROM p
  UNION ALL SELECT candidate, keyword, x, y, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(y) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, CASE WHEN y[j[1]] = x[i + 1] THEN row[j[1]] + 1 ELSE greatest(acc[-1], row[j[1] + 1]) END)) FROM l WHERE i < length(x)),
s AS (SELECT keyword, candidate, round(200.0 * row[-1] / (length(x) + length(y))) AS score FROM l WHERE i = length(x))
SELECT keyword, rank::INTEGER AS rank, candidate, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank <= 5""")
def f6_fuzzy_top_k(t):
    vocab = t.part.select(F.col("p_name").alias("candidate"))
    words = t.spark.createDataFrame([(x,) for x in ("red widget", "blue blot", "ring")], "keyword string")
    return fuzzy.fuzzy_top_k(vocab, words)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, floor(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) * 1000 + 0.5) / 1000 AS score FROM embeddings, q)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""")
def f7_semantic_top_k(t):
    e = t.embeddings
    return rk.semantic_top_k(e.select("vec_id", F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 0.2)


@query(f"{SEEN}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY qid ORDER BY event_time, event_id) THEN 0 ELSE 1 END AS c FROM v) SELECT qid, event_id, sum(c) OVER (PARTITION BY qid ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c")
def f9_runs(t):
    return rk.runs(seen(t), "event_type", ["event_time", "event_id"]).select("qid", "event_id", "run")


@query(f"SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format(chr(39) + '42:' + chr(39) + ' || c_custkey')}, c_custkey) AS k FROM customer) WHERE k <= 20")
def f10_stratified_sample(t):
    return rk.stratified_sample(t.customer, "c_mktsegment", 20, 42, "c_custkey").select("c_mktsegment", "c_custkey")


@query(f"""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {DRAW.format(chr(39) + '42:' + chr(39) + ' || o_custkey')}, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT o_custkey, count(*) AS n, CASE WHEN min(b) < (SELECT count(*) * 0.02 FROM orders) THEN 'val' ELSE 'train' END AS split FROM orders JOIN b USING (o_custkey) GROUP BY 1""")
def f11_train_val_split(t):
    return rk.train_val_split(t.orders, 0.02, 42, "o_custkey").groupBy("o_custkey", "split").agg(F.count("*").alias("n"))


@query(f"{SEEN} SELECT qid, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY qid, event_type ORDER BY event_id) AS k FROM v) WHERE k = 1")
def f12_dedupe_first(t):
    spaced = seen(t).withColumn("x", F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit("  ")))
    return rk.dedupe_first(spaced, "x", "event_id").select("qid", "event_id", "event_type")


_TOK = r"regexp_extract_all(lower(text), '[a-z]+')"


@query(f"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(w) AS term FROM (SELECT item_id, {_TOK} AS w FROM benchmark)),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 3""")
def f13_bm25(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    found = ret.bm25_top_k(t.documents.select("doc_id", words.alias("tokens")), ret.word_terms(t.benchmark, "item_id", words), 3)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) ** 2)), 5) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s) WHERE rank <= 10""")
def f13_dense_l2(t):
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return ret.dense_top_k(v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), v, 10, "l2", own=False, digits=5)


#: Both retrievers answer the same queries: texts and vectors of every id that is divisible by 100.
FUSED = f"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
q AS (SELECT DISTINCT doc_id AS query_id, unnest(w) AS term FROM d WHERE doc_id % 100 = 0),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), n WHERE doc_id <> query_id GROUP BY ALL),
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (
  SELECT x.vec_id AS query_id, c.vec_id AS doc_id, floor(list_dot_product(x.v, c.v) * 1000000 + 0.5) / 1000000 AS score FROM v x JOIN v c ON x.vec_id <> c.vec_id WHERE x.vec_id % 100 = 0)),
p AS (SELECT query_id, doc_id, 1.0::DOUBLE / (100 + r) AS p FROM a WHERE r <= 20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (100 + r) FROM b WHERE r <= 20),
f AS (SELECT query_id, doc_id, sum(p) AS s FROM p GROUP BY ALL)"""


@query(f"{FUSED} SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM f) WHERE rank <= 10")
def f13_fused_lists(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    asked = t.documents.where("doc_id % 100 = 0")
    lexical = ret.bm25_top_k(t.documents.select("doc_id", words.alias("tokens")), ret.word_terms(asked, "doc_id", words), 20, own=False)
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    dense = ret.dense_top_k(v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), v, 20, own=False)
    fused = rk.rrf_merge([lexical.withColumn("score", F.round("score", 9)), dense], 20)
    return fused.where("rank <= 10").select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query("""WITH a AS (SELECT l_orderkey AS q, l_partkey AS d, max(l_quantity) AS s FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS q, l_partkey AS d, min(l_discount) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT q, d, 1.0 / (100 + row_number() OVER (PARTITION BY q ORDER BY s DESC, d)) AS p FROM a UNION ALL SELECT q, d, 1.0 / (100 + row_number() OVER (PARTITION BY q ORDER BY s, d)) FROM b),
f AS (SELECT q, d, sum(p::DOUBLE) AS s FROM p GROUP BY ALL)
SELECT q AS query_id, rank::INTEGER AS rank, d AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, d) AS rank FROM f) WHERE rank <= 3""")
def f13_rrf_merge(t):
    key = [F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")]
    a = t.lineitem.groupBy(*key).agg(F.max("l_quantity").alias("score"))
    b = t.lineitem.groupBy(*key).agg(F.min("l_discount").alias("score"))
    wide = 1000
    fused = rk.rrf_merge([a, b], wide, ascending=[False, True])
    return fused.where("rank <= 3").select("query_id", "rank", "doc_id")


@query("""WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER w AND length(text) % 3 = lag(length(text) % 3) OVER w THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
i AS (SELECT conv_id, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT conv_id, max(n) AS streak FROM (SELECT conv_id, i, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1""")
def f14_streaks(t):
    c = t.conversations.select("conv_id", F.struct("turn", "text").alias("pos"), F.concat_ws(":", "role", (F.length("text") % 3).cast("string")).alias("sig"))
    return rk.streaks(c, "sig", "pos", "conv_id")


@query()
def f15_balance_by_length(t):
    """Differencing has no SQL; tests hold it against the plain form and the deal in turns."""
    return balance.balance_by_length(t.conversations.withColumn("len", F.length("text")), "len", 8, "conv_id")


@query("""WITH g AS (SELECT conv_id, sum(24576 * length(text)::DOUBLE + length(text)::DOUBLE ** 2) AS cost FROM conversations GROUP BY 1), d AS (SELECT conv_id % 8 AS bin, sum(cost) AS c, count(*) AS n FROM g GROUP BY 1)
SELECT count(*) AS bins, min(c) AS least, max(c) AS greatest, round(avg(c), 3) AS mean, max(c) - min(c) AS spread, round(max(c) / avg(c), 9) AS over_mean, min(n) AS fewest, max(n) AS most FROM d""")
def f15_imbalance(t):
    cost = t.conversations.groupBy("conv_id").agg(F.sum(balance.workload(F.length("text"))).alias("cost"))
    report = balance.imbalance(cost.withColumn("bin", F.col("conv_id") % 8))
    return report.withColumn("mean", F.round("mean", 3)).withColumn("over_mean", F.round("over_mean", 9))


@query("""SELECT conv_id, turn, text_len, coalesce(sum(text_len // 4) OVER (PARTITION BY conv_id ORDER BY turn, text_len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 300 AS omitted FROM (SELECT conv_id, turn, length(text) AS text_len FROM conversations)""")
def f16_evidence_budget(t):
    c = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("text_len")).withColumn("pos", F.struct("turn", "text_len"))
    return rk.evidence_budget(c, F.floor(F.col("text_len") / 4), 300, "pos", "conv_id").drop("pos")


@query(f"{SEEN} SELECT qid, 'events' AS table_name, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT qid, 'static', -1 FROM m")
def e1_event_counts(t):
    return rec.event_counts({"events": (t.records, "event_time"), "static": (t.customer, None)}, t.manifest)


@query("WITH v AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem) SELECT strftime(d, '%Y-%m-%d') AS value, (SELECT count(*) FROM v) AS n_values FROM v ORDER BY d LIMIT 10")
def e2_unique_values(t):
    days = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return rec.unique_values(days, "day").select("value", "n_values")


@query(f"{SEEN}, x AS (SELECT qid, max(greatest(event_time, available_time)) AS t FROM v GROUP BY 1) SELECT m.qid, strftime(coalesce(t + INTERVAL 1 SECOND, m.cutoff), '%Y-%m-%d %H:%M:%S') AS restated FROM m LEFT JOIN x USING (qid)")
def e3_latest_visible(t):
    return rec.latest_visible([(seen(t), ["event_time", "available_time"])], t.manifest).select("qid", stamp("restated").alias("restated"))


@query(f"{SEEN} SELECT qid, 'events' AS table_name, 'available_time' AS column_name, count(*) AS n FROM v WHERE available_time >= cutoff GROUP BY 1")
def e5_residual_future(t):
    return rec.residual_future(seen(t), ["event_time", "available_time"], "events")


@query(f"{SEEN} SELECT qid, 'late store' AS rule, count(*) AS n FROM v WHERE available_time >= cutoff GROUP BY 1 UNION ALL SELECT qid, 'error row', count(*) FROM v WHERE event_type = 'error' GROUP BY 1")
def e6_e7_e33_violations(t):
    rules = {"late store": F.col("available_time") >= F.col("cutoff"), "error row": F.col("event_type") == "error", "future row": F.col("event_time") >= F.col("cutoff")}
    return rec.violations(seen(t), rules)


#: Records as a run could read them, what of them came too late, and five calls of each question.
LEAK = f"""{SEEN}, w AS (SELECT v.*, available_time >= cutoff AS gone, event_type = 'purchase' AND event_time + INTERVAL 1 DAY >= cutoff AS late,
  event_type = 'signup' AND event_time + INTERVAL 7 DAY >= cutoff AS plan FROM v),
x AS (SELECT *, event_id || '|' || event_type || '|' || round(value * 100)::BIGINT || '|' || props AS ut,
  event_id || '|' || event_type || '|' || CASE WHEN late THEN '' ELSE (round(value * 100)::BIGINT)::VARCHAR END || '|' || props AS st FROM w),
c AS (SELECT qid, subject_id, cutoff - INTERVAL 3 DAY AS lo, cutoff - INTERVAL 1 DAY AS hi, k FROM m CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(k)),
z AS (SELECT qid, max(event_time) AS lu, max(event_time) FILTER (NOT gone) AS ls FROM x GROUP BY 1),
h AS (SELECT c.qid, k, ut, st, CASE k WHEN 1 THEN contains(lower(ut), 'view') WHEN 2 THEN event_type = 'click' WHEN 4 THEN event_time = lu ELSE event_time BETWEEN lo AND hi END AS hu,
  NOT gone AND CASE k WHEN 1 THEN contains(lower(st), 'view') WHEN 2 THEN event_type = 'click' WHEN 4 THEN event_time = ls ELSE event_time BETWEEN lo AND hi END AS hs FROM c JOIN x USING (qid) JOIN z USING (qid)),
g AS (SELECT qid, k, count(*) FILTER (hu) AS nu, count(*) FILTER (hs) AS ns, sum(('0x' || substr(md5(ut), 1, 8))::BIGINT) FILTER (hu) AS bu, sum(('0x' || substr(md5(st), 1, 8))::BIGINT) FILTER (hs) AS bs FROM h GROUP BY ALL),
f AS (SELECT c.qid, c.k, subject_id, coalesce(nu, 0) AS nu, coalesce(ns, 0) AS ns, coalesce(nu, 0) || CASE WHEN c.k = 5 THEN '' ELSE ':' || coalesce(bu, 0) END AS u, coalesce(ns, 0) || CASE WHEN c.k = 5 THEN '' ELSE ':' || coalesce(bs, 0) END AS s FROM c LEFT JOIN g USING (qid, k)),
o AS (SELECT *, CASE WHEN (subject_id + k) % 2 = 0 THEN u ELSE s END AS observed FROM f),
l AS (SELECT qid, count(*) FILTER (gone) AS a, count(*) FILTER (late) AS b, count(*) FILTER (plan) AS p FROM w GROUP BY 1),
e AS (SELECT o.*, coalesce(a + b, 0) > 0 AS touched, observed = u AND u <> s AS exposed FROM o LEFT JOIN l USING (qid))"""


def leaking(t):
    """Views, leaks and replayed calls, half of which observed the unsafe view."""
    view = seen(t).select("qid", "cutoff", "event_time", "available_time", "event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "props")
    ends = lambda days: F.col("event_time") + F.make_dt_interval(F.lit(days)) >= F.col("cutoff")
    rules = {
        "events": [
            leak.Leak("late_availability", "available_time", F.col("available_time") >= F.col("cutoff")),
            leak.Leak("future_outcome", "cents", (F.col("event_type") == "purchase") & ends(1), "cents"),
            leak.Leak("future_plan", "signup", (F.col("event_type") == "signup") & ends(7), confirmed=False),
        ]
    }
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("kind"), F.lit(c).alias("column_name"), F.lit(a).alias("argument")) for i, (n, c, a) in enumerate([("keyword", None, "VIEW"), ("value", "event_type", " click "), ("range", None, None), ("latest", None, None), ("count", None, None)], 1)])
    day = lambda n: F.col("cutoff") - F.make_dt_interval(F.lit(n))
    calls = t.manifest.select("qid", "subject_id", day(3).alias("start"), day(1).alias("stop"), F.lit("events").alias("table_name"), F.explode(kinds).alias("c"))
    calls = calls.select("*", "c.*").drop("c").withColumn("call_id", F.concat(F.lit("call"), F.col("k").cast("string")))
    replayed = leak.replay(calls, {"events": view}, rules, {"events": ["event_id", "event_type", "cents", "props"]}, {"events": "event_time"})
    observed = replayed.withColumn("observed", F.when((F.col("subject_id") + F.col("k")) % 2 == 0, F.col("unsafe")).otherwise(F.col("safe")))
    leaks = leak.confirmed_leaks({"events": view}, rules)
    return leaks, leak.call_levels(observed, leaks)


@query(f"{LEAK} SELECT qid, 'call' || k AS call_id, nu AS n_unsafe, ns AS n_safe, u AS unsafe, s AS safe, touched, exposed FROM e")
def e8_replay_calls(t):
    return leaking(t)[1].select("qid", "call_id", "n_unsafe", "n_safe", "unsafe", "safe", "touched", "exposed")


@query(f"{LEAK} SELECT qid, category, detail, confirmed, n FROM (SELECT qid, unnest([{{'category': 'late_availability', 'detail': 'available_time', 'confirmed': true, 'n': a}}, {{'category': 'future_outcome', 'detail': 'cents', 'confirmed': true, 'n': b}}, {{'category': 'future_plan', 'detail': 'signup', 'confirmed': false, 'n': p}}], recursive := true) FROM l) WHERE n > 0")
def e8_confirmed_leaks(t):
    return leaking(t)[0].drop("table_name")


@query(f"""{LEAK}, t AS (SELECT qid, count(*) FILTER (touched) AS l1_calls, count(*) FILTER (exposed) AS l2_calls, count(*) FILTER (observed <> u) AS mismatches FROM e GROUP BY 1)
SELECT m.qid, coalesce(a + b, 0) AS n_confirmed, coalesce(p, 0) AS n_other, l1_calls, l2_calls, mismatches, CASE WHEN l2_calls > 0 THEN 2 WHEN l1_calls > 0 THEN 1 WHEN coalesce(a + b, 0) > 0 THEN 0 END AS level
FROM m LEFT JOIN l USING (qid) LEFT JOIN t USING (qid)""")
def e8_leakage_levels(t):
    leaks, calls = leaking(t)
    return leak.leakage_levels(t.manifest, leaks, calls)


@query("SELECT count(*) AS n, min(x) AS min_len, avg(x) AS mean_len, quantile_cont(x, 0.5) AS median_len, quantile_cont(x, 0.9) AS p90_len, max(x) AS max_len, count(*) FILTER (x <= 500) AS within_500, count(*) FILTER (x <= 5000) AS within_5000 FROM (SELECT length(text)::BIGINT AS x FROM documents)")
def e19_length_report(t):
    return rec.length_report(t.documents.select(F.length("text").cast("bigint").alias("x")), "x", [500, 5000])


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders GROUP BY ALL) SELECT *, 1000 AS expected, n = 1000 AS as_expected FROM c")
def e32_release_counts(t):
    by = ["o_orderstatus", "o_orderpriority"]
    expected = t.orders.select(*by).distinct().withColumn("expected", F.lit(1000))
    return rec.release_counts(t.orders, by, {"subjects": "o_custkey"}, expected)


@query("SELECT 'len_' || k AS name, CASE k WHEN 'max' THEN max(l_quantity) WHEN 'min' THEN min(l_quantity) ELSE avg(l_quantity) END AS value FROM lineitem, (VALUES ('max'), ('min'), ('mean')) v(k) GROUP BY k")
def e30_reduce_named(t):
    return rec.reduce_named(t.lineitem.select(F.explode(F.array(*[F.lit(f"len_{x}") for x in ("max", "min", "mean")])).alias("name"), F.col("l_quantity").alias("value")))


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'red.*|ring$') OR regexp_matches(lower(p_type), 'red.*|ring$') OR regexp_matches(lower(p_brand), 'red.*|ring$')")
def h1_keyword_match(t):
    return rec.keyword_match(t.part, "Red.*|Ring$").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size::VARCHAR = '11'")
def h2_value_match(t):
    return rec.value_match(t.part, "p_size", " 11 ").select("p_partkey")


@query("SELECT p_name AS candidate, min(p_partkey) AS p_partkey FROM part WHERE regexp_matches(lower(p_name), 'b.l') GROUP BY 1")
def h3_candidate_keyword(t):
    return rec.candidate_keyword(t.part.withColumnRenamed("p_name", "candidate"), "B.l", "p_partkey")


@query(f"{SEEN} SELECT event_type, count(*) AS n FROM v GROUP BY 1")
def h4_sql_on_view(t):
    return rec.sql_on_view({"labs": seen(t)}, "SELECT event_type, count(*) AS n FROM {labs} GROUP BY 1")


@query(f"SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY {DRAW.format(chr(39) + '7:' + chr(39) + ' || c_custkey')}, c_custkey LIMIT 25")
def a9_subset_manifest(t):
    from ..sources.io import subset_manifest

    return subset_manifest(t.customer, F.col("c_mktsegment") == "MACHINERY", 25, 7, "c_custkey").select("c_custkey")
