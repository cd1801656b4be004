"""Queries for scoring (E9 to E18) and grouped scores (E11, E20 to E34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as gr, scoring as sc
from ..plans.registry import query

#: An order is a question; its parts are the gold items, those with a small line number the answer.
SETS = """WITH q AS (SELECT l_orderkey, list_distinct(list('P' || l_partkey)) AS gold, list_distinct(list('p' || CASE WHEN l_linenumber = 3 THEN l_suppkey ELSE l_partkey END) FILTER (l_linenumber <= 3 AND l_orderkey % 9 <> 0)) AS pred FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, list_transform(gold, lambda x: lower(x)) AS g, coalesce(pred, []) AS p FROM q),
c AS (SELECT l_orderkey, len(g) AS ng, len(p) AS np, len(list_intersect(g, p)) AS tp FROM g),
s AS (SELECT l_orderkey, tp, ng, np, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN np > 0 THEN tp / ng ELSE 0 END AS recall, CASE WHEN np > 0 THEN 2 * tp / (np + ng) ELSE 0 END AS f1,
  (np > 0 AND tp = np AND tp = ng)::INT AS exact, CASE WHEN np > 0 THEN tp / (np + ng - tp) ELSE 0 END AS jaccard, (np > 0 AND tp = np)::INT AS subset FROM c)"""


def answers(t):
    part = F.when(F.col("l_linenumber") == 3, F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("string")
    said = F.when((F.col("l_linenumber") <= 3) & (F.col("l_orderkey") % 9 != 0), F.concat(F.lit("p"), part))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("gold"), F.collect_set(said).alias("pred"))


@query(f"{SETS} SELECT l_orderkey, tp::INT AS tp, precision, recall, f1, exact, jaccard, subset FROM s")
def e9_e12_score_sets(t):
    return sc.score_sets(answers(t)).drop("gold", "pred")


def _questions(t):
    scored = sc.score_sets(answers(t))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("task_type"))
    return scored.join(o, "l_orderkey").select(F.col("l_orderkey").alias("qid"), "task", "task_type", "pred", "gold", "f1", (F.size("pred") > 0).alias("completed"))


QUESTIONS = f"{SETS}, k AS (SELECT l_orderkey AS qid, o_orderpriority AS task, o_orderstatus AS task_type, f1, np, ng FROM s JOIN orders ON o_orderkey = l_orderkey)"


@query(f"""{QUESTIONS} SELECT CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(task_type) = 0 THEN 'type' ELSE 'all' END AS level, task, task_type, count(*) AS questions, count(*) FILTER (np > 0) AS completed,
  round(avg(f1) FILTER (np > 0), 9) AS completed_mean, round(avg(f1), 9) AS all_mean FROM k GROUP BY GROUPING SETS ((task, task_type), (task_type), ())""")
def e10_score_report(t):
    out = sc.score_report(_questions(t))
    return out.select("level", "task", "task_type", "questions", F.col("completed").cast("bigint").alias("completed"), F.round("completed_mean", 9).alias("completed_mean"), F.round("all_mean", 9).alias("all_mean"))


_ROUTED = f"{QUESTIONS}, x AS (SELECT *, CASE WHEN np = 0 THEN 'incomplete' WHEN ng >= 2 THEN 'set' ELSE 'single' END AS route FROM k), z AS (SELECT *, CASE route WHEN 'incomplete' THEN 0.0 WHEN 'set' THEN f1 ELSE (qid % 2)::DOUBLE END AS score FROM x)"


def _routed(t):
    q = _questions(t)
    return sc.route_answers(q, q.select("qid", (F.col("qid") % 2 == 1).cast("int").alias("verdict")))


@query(f"{_ROUTED} SELECT qid, route, score::DOUBLE AS score FROM z")
def e13_route_answers(t):
    return _routed(t).select("qid", "route", "score")


@query(f"{_ROUTED} SELECT task, task_type AS category, count(*) AS n, round(avg(score), 9) AS mean_score FROM z GROUP BY GROUPING SETS ((task, task_type), (task_type), ())")
def e14_unified_report(t):
    out = sc.unified_report(_routed(t).withColumnRenamed("task_type", "category"))
    return out.select("task", "category", "n", F.round("mean_score", 9).alias("mean_score"))


@query("""WITH p AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0), u AS (SELECT vec_id, label, embedding FROM embeddings),
s AS (SELECT p.label AS task, p.vec_id AS name, u.vec_id AS entry, list_dot_product(p.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS s FROM p JOIN u ON p.label = u.label AND p.vec_id <> u.vec_id),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task, name ORDER BY s DESC, entry::VARCHAR) = 1)
SELECT label AS task, vec_id::VARCHAR AS name, CASE WHEN s >= 0.3 THEN entry::VARCHAR ELSE vec_id::VARCHAR END AS mapped FROM p LEFT JOIN b ON task = label AND name = vec_id""")
def e15_map_to_vocabulary(t):
    e = t.embeddings.select(F.col("label").alias("task"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("v"), "vec_id")
    return sc.map_to_vocabulary(e.where("vec_id % 100 = 0").drop("vec_id"), e.select("task", F.col("name").alias("entry"), F.col("v").alias("u")), 0.3, own=False)


@query(f"{QUESTIONS} SELECT coalesce(CASE WHEN qid % 4 = 0 THEN 'own' END, CASE WHEN task = '1-URGENT' THEN 'urgent' END, CASE WHEN qid % 3 = 0 THEN 'third' END, 'uncategorized') AS category, count(*) AS n, round(avg(f1), 9) AS mean_score FROM k GROUP BY 1")
def e16_category_rollup(t):
    q = _questions(t).withColumn("category", F.when(F.col("qid") % 4 == 0, "own")).withColumn("score", F.col("f1"))
    tasks = q.select("task").distinct().where("task = '1-URGENT'").withColumn("category", F.lit("urgent"))
    qids = q.select("qid").where("qid % 3 = 0").withColumn("category", F.lit("third"))
    return sc.category_rollup(q, tasks, qids).select("category", "n", F.round("mean_score", 9).alias("mean_score"))


@query("""WITH p AS (SELECT o_orderstatus AS category, o_custkey AS qid, (max(o_totalprice) - min(o_totalprice)) / 1000 AS d FROM orders GROUP BY ALL),
x AS (SELECT category, d, row_number() OVER (PARTITION BY category ORDER BY qid) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM p),
o AS (SELECT 'overall' AS category, d, row_number() OVER (ORDER BY ('0x' || substr(md5('5:{"qid":{"category":"' || category || '","k":' || qid || '}}'), 1, 8))::BIGINT DESC, category, qid) - 1 AS place, count(*) OVER () AS n FROM p),
a AS (SELECT * FROM x UNION ALL SELECT * FROM o),
w AS (SELECT category, rep, ('0x' || substr(md5('5:' || category || ':' || rep || ':' || place), 1, 8))::BIGINT % n AS place FROM a, range(4000) r(rep)),
m AS (SELECT category, rep, avg(d) AS m FROM w JOIN a USING (category, place) GROUP BY ALL),
b AS (SELECT category, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT category, count(*) AS n, round(avg(d), 6) AS difference, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, any_value(low > 0 OR high < 0) AS significant FROM a JOIN b USING (category) GROUP BY category""")
def e17_paired_compare(t):
    o = t.orders.groupBy(F.col("o_orderstatus").alias("category"), F.col("o_custkey").alias("qid")).agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    a = o.select(F.concat_ws("/", "category", "qid").alias("qid"), "category", (F.col("hi") / 1000).alias("score"), F.col("qid").alias("k"))
    b = o.select(F.concat_ws("/", "category", "qid").alias("qid"), (F.col("lo") / 1000).alias("score"))
    numbered = a.join(b.withColumnRenamed("score", "_b"), "qid")
    out = sc.paired_compare(numbered.select(F.struct("category", "k").alias("qid"), "category", "score"), numbered.select(F.struct("category", "k").alias("qid"), F.col("_b").alias("score")), 4000, 5)
    return out.select("category", "n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")], "significant")


@query("""WITH c AS (SELECT conv_id, list(text) AS t FROM conversations GROUP BY 1), x AS (SELECT count(*) AS rows, count(*) FILTER (conv_id % 5 > 1) AS ok, count(*) FILTER (conv_id % 5 = 1) AS incomplete, count(*) FILTER (conv_id % 5 = 0) AS errors FROM c WHERE conv_id % 11 <> 0),
y AS (SELECT count(*) AS tool_turns, count(*) FILTER (regexp_matches(text, 'tion')) AS tool_errors FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 0)
SELECT rows, ok, incomplete, errors, 0::BIGINT AS repeated, (SELECT count(*) FROM c WHERE conv_id % 11 = 0) AS missing, tool_turns, tool_errors, (SELECT count(*) FROM c) AS expected, 'fail' AS verdict FROM x, y""")
def e18_completeness_gate(t):
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    c = t.conversations.groupBy(F.col("conv_id").alias("qid")).agg(F.collect_list(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("messages"))
    status = F.when(F.col("qid") % 5 == 0, "error").when(F.col("qid") % 5 == 1, "incomplete").otherwise("ok")
    return sc.completeness_gate(c.withColumn("status", status).where("qid % 11 <> 0"), c.select("qid"), "tion")


#: Lines of an order are samples of one prompt; quantity is the score.
def samples(t):
    return t.lineitem.select(F.col("l_orderkey").alias("uid"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("i"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("score2"), F.col("l_suppkey").alias("len"))


G = "g AS (SELECT l_orderkey AS uid, (l_linenumber::BIGINT * 1000000 + l_partkey)::BIGINT AS i, l_quantity AS score, l_tax AS score2, l_suppkey AS len FROM lineitem)"
NORM = "CASE WHEN count(*) OVER w = 1 THEN {0} / (1 + 1e-6) ELSE ({0} - avg({0}) OVER w) / (stddev_samp({0}) OVER w + 1e-6) END"
OUT = "uid, i, round({}, 6) AS advantage"


def rounded(df, *more):
    return df.select("uid", "i", F.round("advantage", 6).alias("advantage"), *more)


@query(f"WITH {G} SELECT {OUT.format(NORM.format('score'))} FROM g WINDOW w AS (PARTITION BY uid)")
def e20_group_norm(t):
    return rounded(gr.group_norm(samples(t)))


@query(f"WITH {G} SELECT {OUT.format('CASE WHEN n > 1 THEN n / (n - 1) * (score - a) ELSE score END')} FROM (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS a FROM g WINDOW w AS (PARTITION BY uid))")
def e21_group_rloo(t):
    return rounded(gr.group_rloo(samples(t)))


@query(f"""WITH {G}, x AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER o AS k, score - lead(score) OVER o AS d, stddev_samp(score) OVER (PARTITION BY uid) AS s FROM g WINDOW o AS (PARTITION BY uid ORDER BY score DESC, i, len))
SELECT {OUT.format('CASE WHEN k = 1 THEN d / (s + 1e-6) ELSE 0 END')} FROM x WHERE n > 1""")
def e22_group_passk(t):
    s = samples(t)
    many = s.groupBy("uid").count().where("count > 1").select("uid")
    return rounded(gr.group_passk(s.join(many, "uid", "left_semi").withColumn("pos", F.struct("i", "len")), "pos"))


@query(f"WITH {G} SELECT {OUT.format('score - sum(score * (len + 1)) OVER (PARTITION BY uid) / sum(len + 1) OVER (PARTITION BY uid)')} FROM g")
def e23_group_len_weighted(t):
    return rounded(gr.group_len_weighted(samples(t).withColumn("len", F.col("len") + 1), "len"))


WHITE = "SELECT sum(v * l) / sum(l) AS m, (sum(v * v * l) - sum(v * l) * sum(v * l) / sum(l)) / (sum(l) - 1) AS s FROM x"


@query(f"WITH {G}, x AS (SELECT uid, i, len + 1 AS l, 0.7 * ({NORM.format('score')}) + 0.3 * ({NORM.format('score2')}) AS v FROM g WINDOW w AS (PARTITION BY uid)), s AS ({WHITE}) SELECT {OUT.format('(v - m) / sqrt(s + 1e-8)')} FROM x, s")
def e24_group_multi_reward(t):
    return rounded(gr.group_multi_reward(samples(t).withColumn("len", F.col("len") + 1), ["score", "score2"], [0.7, 0.3], "len"))


@query(f"WITH {G}, x AS (SELECT uid, i, len + 1 AS l, score - avg(score) OVER (PARTITION BY uid) AS v FROM g), s AS ({WHITE}) SELECT {OUT.format('(v - m) / sqrt(s + 1e-8)')} FROM x, s")
def e25_group_mean_baseline(t):
    return rounded(gr.group_mean_baseline(samples(t).withColumn("len", F.col("len") + 1), "len"))


@query(f"WITH {G}, x AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, avg(score2) OVER (PARTITION BY uid) AS a FROM g), k AS (SELECT count(*) / count(*) FILTER (score2 <> 0) AS k FROM g) SELECT {OUT.format('k * (score2 - CASE WHEN n = 1 THEN 0 ELSE a END)').replace('AS advantage', '+ 0 AS advantage')} FROM x, k")
def e34_group_gpg(t):
    return gr.group_gpg(samples(t), score="score2").select("uid", "i", (F.round("advantage", 6) + 0).alias("advantage"))


LR = "(l_tax - l_discount) * 10"


@query(f"WITH x AS (SELECT l_orderkey AS uid, l_linenumber, l_partkey, least(exp(greatest(least(sum({LR}) OVER (PARTITION BY l_orderkey), 20), -20)), 2.0) AS w FROM lineitem) SELECT uid, l_linenumber, l_partkey, round(w / (SELECT avg(w) FROM x), 6) AS weight FROM x")
def e26_importance_weights(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("uid"), "l_linenumber", "l_partkey", ((F.col("l_tax") - F.col("l_discount")) * 10).alias("lr"))
    return gr.importance_weights(x, "uid", "lr", normalise=True).select("uid", "l_linenumber", "l_partkey", F.round("weight", 6).alias("weight"))


@query(f"""WITH x AS (SELECT l_orderkey AS uid, sum(-({LR})) AS k1, avg(({LR}) ** 2 / 2) AS k2, max(exp({LR}) - 1 - ({LR})) AS k3 FROM lineitem GROUP BY 1)
SELECT uid, round(k1, 6) + 0 AS k1_sum, round(k2, 6) AS k2_mean, round(k3, 6) AS k3_max, round(k1, 9) BETWEEN -1.00005 AND 1.00005 AND k2 <= 0.1000005 AND k3 <= 0.2000005 AS kept FROM x""")
def e27_reject_by_divergence(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("uid"), ((F.col("l_tax") - F.col("l_discount")) * 10).alias("lr"))
    out = gr.reject_by_divergence(x, "uid", "lr", {"k1_sum": (-1.00005, 1.00005), "k2_mean": (float("-inf"), 0.1000005), "k3_max": (float("-inf"), 0.2000005)})
    return out.select("uid", *[(F.round(c, 6) + 0).alias(c) for c in ("k1_sum", "k2_mean", "k3_max")], "kept")


@query(f"""WITH {G}, k AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM g),
b AS (SELECT uid, sum(score * ((i / n) ** 4 - ((i - 1) / n) ** 4)) AS best, sum(score * (((n - i + 1) / n) ** 4 - ((n - i) / n) ** 4)) AS worst FROM k GROUP BY 1),
m AS (SELECT uid, avg(score) AS mean, stddev_samp(score) AS dev FROM g GROUP BY 1)
SELECT count(*) AS groups, round(avg(best), 6) AS best_4, round(avg(worst), 6) AS worst_4, round(avg(mean), 6) AS mean_n, round(avg(coalesce(dev, 0)), 6) AS std_n FROM b JOIN m USING (uid)""")
def e28_validation_metrics(t):
    s = samples(t)
    per = s.groupBy("uid").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("dev")).join(gr.order_statistics(s, 4, ["uid"]), "uid")
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.agg(F.count("*").alias("groups"), r("best", "best_4"), r("worst", "worst_4"), r("mean", "mean_n"), r(F.coalesce("dev", F.lit(0.0)), "std_n"))


@query(f"""WITH {G}, k AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS s FROM g),
e AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < s), s)) AS n FROM k WHERE s > 1)
SELECT uid, n::BIGINT AS n, round(sum(score * ((i / s::DOUBLE) ** n - ((i - 1) / s::DOUBLE) ** n)), 6) AS best, round(sum(score * (((s - i + 1) / s::DOUBLE) ** n - ((s - i) / s::DOUBLE) ** n)), 6) AS worst FROM e GROUP BY 1, 2""")
def e28_validation_all_n(t):
    return gr.order_statistics_of_all_sizes(samples(t), ["uid"]).select("uid", "n", F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"))


@query(f"""WITH {G}, m AS (SELECT uid, i, score, max(score) OVER (PARTITION BY uid) AS hi, min(score) OVER (PARTITION BY uid) AS lo FROM g)
SELECT uid, i, round(score * score + 1e-8, 9) AS pow, CASE WHEN score IN (hi, lo) THEN 1.0::DOUBLE ELSE 0 END + 1e-8 AS max_min, CASE WHEN score = hi THEN 0.4::DOUBLE ELSE 0.1 END + 1e-8 AS max_random FROM m""")
def e31_score_weights(t):
    s = samples(t).select("uid", "i", "score")
    for method in ("pow", "max_min", "max_random"):
        s = gr.score_weights(s, "score", method, ["uid"]).withColumnRenamed("weight", method)
    return s.select("uid", "i", F.round("pow", 9).alias("pow"), "max_min", "max_random")


@query("""WITH g AS (SELECT l_orderkey AS uid, l_returnflag AS pred, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
w AS (SELECT DISTINCT uid, n, d, j FROM g, range(1000) a(d), range(4) b(j)), p AS (SELECT uid, d, j, ('0x' || substr(md5('3:' || uid || ':' || d || ':' || j), 1, 8))::BIGINT % n AS i FROM w),
v AS (SELECT uid, d, pred, count(*) AS v, min(j) AS f, arg_min(score, j) AS s FROM p JOIN g USING (uid, i) GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY uid, d ORDER BY v DESC, f) = 1) SELECT uid, round(avg(s), 6) AS majority FROM b GROUP BY 1""")
def e28_majority(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("uid"), F.col("l_returnflag").alias("pred"), F.col("l_quantity").alias("score"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return gr.majority(s, ["uid"], "pred", "pos", "score", 4, 1000, 3).select("uid", F.round("majority", 6).alias("majority"))


@query(f"""WITH {G}, k AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM g)
SELECT uid, round(sum(CASE WHEN n = 1 THEN score ELSE score * (i - 1) * 2.0 / (n * (n - 1)) END), 6) AS best_at_k FROM k GROUP BY 1""")
def e11_expected_best_at_k(t):
    return gr.expected_best_at_k(samples(t), 2, ["uid"], "i").select("uid", F.round("best_at_k", 6).alias("best_at_k"))


@query("SELECT avg(l_quantity) AS q_mean, max(l_quantity) AS q_max, min(l_quantity) AS q_min, avg(l_suppkey) AS n_mean, max(l_suppkey) AS n_max, min(l_suppkey) AS n_min, avg((l_suppkey >= 50)::INT) AS clip_ratio, avg((l_suppkey = 0)::INT) AS aborted_ratio FROM lineitem")
def e29_batch_stats(t):
    return gr.batch_stats(t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("n")), "q", "n", 50)


@query("""WITH s AS (SELECT l_orderkey AS uid, l_linenumber, l_partkey, l_suppkey, floor(l_quantity) AS w, sum(floor(l_quantity)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS h, sum(floor(l_quantity)) OVER (PARTITION BY l_orderkey) AS a FROM lineitem),
p AS (SELECT DISTINCT uid, d, ('0x' || substr(md5('9:' || uid || ':' || d), 1, 8))::BIGINT / 4294967296.0 AS u FROM s, range(3) r(d))
SELECT uid, d::INT AS draw, l_linenumber, l_partkey FROM p JOIN s USING (uid) WHERE u * a >= h - w AND u * a < h""")
def e31_resample_by_score(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("uid"), "l_linenumber", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return gr.resample_by_score(s, F.floor("l_quantity").cast("double"), 3, 9, "pos", ["uid"]).select("uid", "draw", "l_linenumber", "l_partkey")
