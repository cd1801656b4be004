"""Queries for text, answers and messages (H5 to H35, D26, D27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import asof, names, render as rd
from ..plans.registry import BOTH, query, stamp


@query("""WITH d AS (SELECT user_id, event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type AS label, day AS at, n AS rows FROM d""")
def h5_parse_sections(t):
    """One text for each user and day, so that none holds all of a user."""
    e = t.events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("| "), F.col("event_id").cast("string"), F.lit(" |")).alias("row"))
    block = e.groupBy("user_id", "event_type", "day").agg(F.concat(F.lit("## "), F.first("event_type"), F.lit(" ["), F.first("day"), F.lit("]\n| id |\n| --- |\n"), F.array_join(F.collect_list("row"), "\n")).alias("b"))
    texts = block.groupBy(F.struct("user_id", "day").alias("part")).agg(F.array_join(F.collect_list("b"), "\n").alias("text"))
    return tx.parse_sections(texts, "part", "text").select("part.user_id", "label", "at", "rows")


#: Two tables with clocks and one without, as a question sees them.
TIMELINE = f"""{BOTH}, v AS (SELECT m.qid, r.* FROM r JOIN m USING (subject_id) WHERE event_time < cutoff),
a AS (SELECT qid, 'visits' AS t, event_time AS tm, event_id AS pos, [event_type, CASE WHEN event_id % 7 = 0 THEN 'a/b' ELSE '' END] AS c FROM v WHERE event_type IN ('view', 'click')
  UNION ALL SELECT qid, 'acts', event_time, event_id, [event_id::VARCHAR, props] FROM v WHERE event_type NOT IN ('view', 'click')
  UNION ALL SELECT qid, 'subjects', NULL, 0, [subject_id::VARCHAR] FROM m),
l AS (SELECT *, CASE WHEN tm IS NULL OR t = lag(t) OVER (PARTITION BY qid, tm IS NULL ORDER BY tm, t, pos) THEN 0 ELSE 1 END AS s FROM a),
n AS (SELECT *, CASE WHEN tm IS NULL THEN 0 ELSE sum(s) OVER (PARTITION BY qid, tm IS NULL ORDER BY tm, t, pos ROWS UNBOUNDED PRECEDING) END AS run FROM l),
b AS (SELECT qid, run, t, count(*) AS rows, min(tm) AS start, list(c ORDER BY tm, pos) AS r FROM n GROUP BY ALL),
k AS (SELECT *, CASE t WHEN 'visits' THEN ['What', 'Note'] WHEN 'acts' THEN ['Id', 'Props'] ELSE ['Subject'] END AS names FROM b),
p AS (SELECT *, list_filter(range(1, len(names) + 1), lambda i: len(list_filter(r, lambda c: c[i] <> '')) > 0) AS keep FROM k),
x AS (SELECT qid, run, t, rows, '## ' || CASE t WHEN 'visits' THEN 'Visits' WHEN 'acts' THEN 'Acts' ELSE 'Subject' END || ' [' || coalesce(strftime(start, '%Y-%m-%d %H:%M:%S'), 'None') || ']' || chr(10) ||
  CASE WHEN rows = 1 THEN array_to_string(list_transform(keep, lambda i: '- ' || names[i] || ': ' || r[1][i]), chr(10))
  ELSE '| ' || array_to_string(list_transform(keep, lambda i: names[i]), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(keep, lambda i: '---'), ' | ') || ' |' || chr(10) ||
    array_to_string(list_transform(r, lambda c: '| ' || array_to_string(list_transform(keep, lambda i: c[i]), ' | ') || ' |'), chr(10)) END AS text FROM p)"""


def shown_tables(t):
    v = asof.as_of_event(t.records, t.manifest)
    visits = v.where(F.col("event_type").isin("view", "click")).withColumn("note", F.when(F.col("event_id") % 7 == 0, " a|b\n").otherwise("nan"))
    subjects = t.manifest.select("qid", "subject_id", F.lit(0).alias("n"))
    return {
        "visits": (visits, rd.Shown("Visits", [("event_type", "What"), ("event_time", "When"), ("note", "Note")], "event_time", "event_id")),
        "acts": (v.where(~F.col("event_type").isin("view", "click")), rd.Shown("Acts", [("event_id", "Id"), ("props", "Props")], "event_time", "event_id")),
        "subjects": (subjects, rd.Shown("Subject", [("subject_id", "Subject")], None, "n")),
    }


@query(f"{TIMELINE} SELECT qid, run::BIGINT AS run, t AS table_name, rows, text FROM x")
def h6_timeline_blocks(t):
    return rd.timeline_blocks(shown_tables(t))


@query(f"{TIMELINE} SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY run, t) AS text FROM x GROUP BY 1")
def h6_render_timeline(t):
    return rd.render_timeline(shown_tables(t))


@query(f"""{BOTH}, v AS (SELECT m.qid, r.* FROM r JOIN m USING (subject_id) WHERE event_time < cutoff),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY event_time DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY qid) AS visible FROM v)
SELECT qid, 'acts' AS table_name, visible, '### acts' || chr(10) || 'Visible rows: ' || visible || CASE WHEN visible > 5 THEN ' (latest 5 of ' || visible || ')' ELSE '' END || chr(10) || 'event_id,event_type' || chr(10)
  || string_agg(event_id || ',' || event_type, chr(10) ORDER BY event_time, event_id) AS text FROM n WHERE k <= 5 GROUP BY qid, visible""")
def h8_render_context(t):
    v = asof.as_of_event(t.records, t.manifest)
    return rd.render_context({"acts": (v, rd.Shown("Acts", [("event_id", "Id"), ("event_type", "What")], "event_time", "event_id"))}, 5)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS body FROM events GROUP BY ALL")
def h6_h8_render_blocks(t):
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return tx.render_blocks(e, "user_id", "day", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), "event_id")


@query(f"{BOTH} SELECT event_id, strftime(CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN event_time + INTERVAL 1 MINUTE ELSE event_time END, '%Y-%m-%d %H:%M:%S') AS anchor FROM r")
def h7_c20_anchor_time(t):
    from ..operators.records import anchor_time

    rules = {"error": None, "purchase": ("event_time", 60), "*": ("event_time", 0)}
    return t.records.select("event_id", stamp(anchor_time(F.col("event_type"), rules)).alias("anchor"))


@query("SELECT c_custkey, 'Q: ' || replace(c_name, '#', 'No. ') || ' in ' || c_mktsegment AS text, contains(c_name, '#') AS found FROM customer")
def h9_h10_compose_question(t):
    q = F.concat(F.lit("Q: "), "c_name", F.lit(" in "), "c_mktsegment")
    return t.customer.select("c_custkey", tx.replace_block(q, F.lit("#"), F.lit("No. ")).alias("r")).select("c_custkey", "r.text", "r.found")


@query("SELECT doc_id, floor(length(text) / 1.6)::BIGINT AS tokens, (floor(CASE WHEN lang = 'en' THEN 32000 ELSE 100000 END * 0.95) - 100)::BIGINT AS budget FROM documents")
def h11_h25_token_budget(t):
    window = tx.model_window(F.col("lang"), [("en", 32000), ("de", 200000)], 128000)
    return t.documents.select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"), tx.history_budget(window, F.lit(100)).alias("budget"))


#: Turns of a conversation become messages; every second assistant turn calls a tool, the last one finishes.
def messages(t):
    call = F.when(F.col("role") == "assistant", F.array(F.struct(F.col("turn").cast("string").alias("id"), F.lit("function").alias("type"), F.struct(
        F.when(F.col("turn") >= 3, "finish").otherwise("ehr_search").alias("name"),
        F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('["'), F.substring("role", 1, 3), F.lit('"]'))).otherwise(F.col("role")).alias("response"))).alias("arguments")).alias("function"))))
    m = F.struct("role", F.col("text").alias("content"), call.alias("tool_calls"))
    return t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", m.alias("m")))), lambda s: s["m"]).alias("messages"))


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'assistant' AND turn >= 3) THEN CASE WHEN conv_id % 2 = 0 THEN '["ass"]' ELSE 'assistant' END END AS response,
  CASE WHEN NOT bool_or(role = 'assistant' AND turn >= 3) THEN 'none' WHEN conv_id % 2 = 0 THEN 'list' ELSE 'string' END AS source,
  count(*) FILTER (role = 'assistant') AS calls, count(*) FILTER (role = 'user') AS turns, NOT bool_or(role = 'assistant' AND turn >= 3) AS needs_round FROM conversations GROUP BY 1""")
def h12_h16_h19_h20_trajectory(t):
    m, r = messages(t), tx.finish_response(F.col("messages"))
    return m.select("conv_id", r.alias("response"), tx.response_source(r).alias("source"), tx.count_tool_calls(F.col("messages")).cast("bigint").alias("calls"), tx.count_turns(F.col("messages"), "user").cast("bigint").alias("turns"), tx.needs_final_round(F.lit("ok"), r).alias("needs_round"))


@query("SELECT l_orderkey, string_agg('P' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1")
def h13_parse_list(t):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: F.concat(F.lit("'P"), s["l_partkey"].cast("string"), F.lit("'")))
    said = F.concat(F.lit("The answer is ["), F.array_join(parts, ", "), F.when(F.col("l_orderkey") % 2 == 0, "]").otherwise(""))
    texts = t.lineitem.groupBy("l_orderkey").agg(said.alias("text"))
    return texts.select("l_orderkey", F.array_join(tx.parse_list("text"), ",").alias("items"))


@query("SELECT l_orderkey, string_agg('part ' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1")
def h14_answer_items(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: F.concat(F.lit("- **part "), s["l_partkey"].cast("string"), F.lit("**")))
    texts = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("<think>x</think><answer>old</answer> so <answer>\n"), F.array_join(lines, "\n"), F.lit("\n</answer>")).alias("text"))
    return texts.select("l_orderkey", F.array_join(tx.answer_items(F.col("text")), ",").alias("items"))


@query("SELECT l_orderkey, string_agg('P' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1")
def h14_embedded_response(t):
    """Answers that end whole, within their list, or within its last text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: F.concat(F.lit('"P'), s["l_partkey"].cast("string")))
    end = F.when(F.col("l_orderkey") % 3 == 0, '"]} and more').when(F.col("l_orderkey") % 3 == 1, '", ').otherwise("")
    said = F.concat(F.lit('{"response": ["old"]} so: {"note": 1} {"response": ['), F.array_join(parts, '", '), end)
    texts = t.lineitem.groupBy("l_orderkey").agg(said.alias("text"))
    return texts.select("l_orderkey", F.array_join(tx.embedded_response("text"), ",").alias("items"))


#: What lines say of their parts, a third of it not as the part list has it.
SAID = """v AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS position FROM part GROUP BY 1),
a AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN ' ' || upper(p_name) || '  ' || p_brand WHEN 1 THEN 'the ' || p_name || ' ' || p_brand || ' of' WHEN 2 THEN p_name ELSE 'nothing of ' || p_type END AS said FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT said, count(*) AS n, lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS t FROM a GROUP BY 1),
e AS (SELECT t, coalesce(arg_min(name, position) FILTER (lower(name) = t), arg_min(name, position)) AS m FROM (SELECT DISTINCT t FROM d) JOIN v ON contains(t, lower(name)) OR contains(lower(name), t) GROUP BY 1)"""


def said_of_parts(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", F.col("p_type").alias("p_type"))
    k, name = F.col("l_linenumber") % 4, F.concat_ws(" ", "p_name", "p_brand")
    said = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), F.col("p_brand"))).when(k == 1, F.concat(F.lit("the "), name, F.lit(" of"))).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("nothing of "), F.col("p_type")))
    vocabulary = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("position"))
    return t.lineitem.join(p, "l_partkey").select("l_orderkey", "l_linenumber", said.alias("said")), vocabulary


@query(f"WITH {SAID} SELECT said, n, coalesce(m, said) AS aligned FROM d LEFT JOIN e USING (t)")
def h15_align_to_official(t):
    said, vocabulary = said_of_parts(t)
    return names.align_to_official(said.groupBy("said").agg(F.count("*").alias("n")), "said", vocabulary, "name", "position")


@query(r"""WITH v AS (SELECT array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:3], ' ') AS name, min(item_id) AS p FROM benchmark GROUP BY 1),
d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, name, strpos(t, lower(name)) AS at, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(t, lower(name)), p) AS place FROM d JOIN v ON contains(t, lower(name))""")
def h13_mentions(t):
    first = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 3), " ")
    vocabulary = t.benchmark.groupBy(first.alias("name")).agg(F.min("item_id").alias("p"))
    return names.mentions(t.documents.select("doc_id", "text"), "doc_id", "text", vocabulary, "name", "p")


@query("""SELECT o_orderkey, lower(o_orderpriority) AS norm, 'ehr.get_' || o_orderstatus AS tool, CASE WHEN o_orderkey % 2 = 0 THEN 'q' || o_orderkey ELSE 'code_' || o_custkey || '_' || o_orderkey END AS qid,
  CASE WHEN o_orderkey % 2 = 0 THEN 'q' || o_orderkey ELSE 'code' END AS task FROM orders""")
def h17_h18_names_and_qids(t):
    explicit = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("q"), F.col("o_orderkey").cast("string")))
    qid = tx.build_qid(explicit, F.lit("code"), F.col("o_custkey"), F.col("o_orderkey"))
    return t.orders.select("o_orderkey", tx.normalize_text(F.concat(F.lit("  "), "o_orderpriority")).alias("norm"), tx.normalize_tool_name(F.concat(F.lit("ehr_get_"), "o_orderstatus")).alias("tool"), qid.alias("qid"), tx.task_of_qid(qid).alias("task"))


@query("SELECT conv_id, string_agg(upper(role) || ': ' || length(text), chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1")
def h21_h22_render_trajectory(t):
    m = messages(t)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(F.upper(x["role"]), F.lit(": "), F.length(x["content"]).cast("string"))), "\n").alias("body"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos FROM conversations), a AS (SELECT *, CASE WHEN role = 'assistant' THEN CASE WHEN pos % 4 = 2 THEN 'think' ELSE 'act' END ELSE 'other' END AS kind, last_value(CASE WHEN role = 'assistant' THEN pos % 4 = 2 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_think FROM k),
i AS (SELECT *, coalesce(sum((role = 'assistant' AND kind = 'act')::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM a),
g AS (SELECT conv_id, i, string_agg(length(text)::VARCHAR, chr(10) ORDER BY pos) AS reasoning FROM i WHERE kind = 'think' GROUP BY ALL)
SELECT i.conv_id, i.pos, i.role, length(text)::VARCHAR AS text, CASE WHEN role = 'assistant' THEN g.reasoning END AS reasoning FROM i LEFT JOIN g USING (conv_id, i) WHERE kind <> 'think' AND NOT (role = 'user' AND coalesce(after_think, false))""")
def h23_fold_think(t):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    c = t.conversations.withColumn("pos", pos)
    kind = F.when((F.col("role") == "assistant") & (F.col("pos") % 4 == 2), "think").when(F.col("role") == "assistant", "act").otherwise("other")
    turns = c.select("conv_id", "pos", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), kind.alias("kind"), F.length("text").cast("string").alias("text"))
    out = tx.fold_think(turns, "conv_id", "pos")
    return out.withColumn("role", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")))


@query("SELECT conv_id, 'You help.' || chr(10) || '## Tools' || chr(10) || conv_id AS system, string_agg((role = 'assistant')::INT::VARCHAR, '' ORDER BY turn, text) AS mask FROM conversations GROUP BY 1")
def h24_h26_protocol_and_mask(t):
    m = messages(t)
    system = F.concat(F.lit("You help.\n## Protocol\nask first\nthen act\n## Tools\n"), F.col("conv_id").cast("string"))
    mask = F.array_join(F.transform(tx.training_mask(F.col("messages")), lambda x: x.cast("string")), "")
    return m.select("conv_id", tx.strip_protocol(system).alias("system"), mask.alias("mask"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS em, replace(p_retailprice::DECIMAL(10,2)::VARCHAR, ',', '') AS number, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS layout,
  least(-(p_size - 20) / 10.0 * 0.5, 0.0)::DOUBLE AS penalty, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END END AS by_source FROM part""")
def h27_h28_h30_h31_h32_rewards(t):
    p = t.part
    answer = F.concat(F.lit("<think>x</think>"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("y"), F.lit("<answer>The "), F.upper("p_name"), F.when(F.col("p_partkey") % 3 == 0, ".").otherwise(" no"), F.lit("</answer>"))
    em = tx.score_exact_match(answer, F.array("p_name"))
    layout = tx.format_reward(answer)
    source = F.when(F.col("p_partkey") % 5 == 0, "qa").otherwise("layout")
    number = tx.last_number(F.concat(F.lit("about 7 is #### "), F.format_string("%.2f", "p_retailprice")), strict=True)
    return p.select("p_partkey", em.alias("em"), number.alias("number"), layout.alias("layout"), tx.overlong_penalty(F.col("p_size"), 20, 10, 0.5).alias("penalty"), tx.score_by_source(source, {"qa": em, "layout": layout}).alias("by_source"))


@query("""WITH x AS (SELECT l_orderkey, list(l_returnflag) AS g, coalesce(list(l_returnflag) FILTER (l_linenumber <= 3), []) AS p FROM lineitem GROUP BY 1),
y AS (SELECT *, list_sum(list_transform(['A', 'N', 'R'], lambda f: least(len(list_filter(p, lambda y: y = f)), len(list_filter(g, lambda y: y = f)))))::DOUBLE / list_sum(list_transform(['A', 'N', 'R'], lambda f: greatest(len(list_filter(p, lambda y: y = f)), len(list_filter(g, lambda y: y = f))))) AS names FROM x) SELECT l_orderkey, round(names, 9) AS names, round(CASE WHEN len(p) = len(g) THEN 3.0 ELSE 6 * (names + 3 * len(p)) / (1 + 3 * len(g)) - 3 END, 9) AS score FROM y""")
def h29_score_tool_calls(t):
    small = F.col("l_linenumber") <= 3
    call = F.struct(F.col("l_returnflag").alias("name"), F.struct(F.col("l_partkey").alias("k"), F.concat_ws("-", "l_linenumber", "l_suppkey").alias("line")).alias("arguments"))
    ordered = lambda c: F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias("c")))), lambda s: s["c"]))
    x = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("g"), F.collect_list(F.when(small, F.col("l_returnflag"))).alias("p"), F.to_json(ordered(call)).alias("gj"), F.to_json(ordered(F.when(small, call))).alias("pj"))
    return x.select("l_orderkey", F.round(tx.name_overlap(F.col("p"), F.col("g")), 9).alias("names"), F.round(tx.tool_call_score(F.col("pj"), F.col("gj")), 9).alias("score"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'prediction_time' END, CASE WHEN c_custkey % 3 = 0 THEN 'study_ids' END) AS problem FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0")
def h33_manifest_gate(t):
    m = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, "x").alias("prediction_time"), F.when(F.col("c_custkey") % 3 != 0, F.array(F.lit("s"))).alias("study_ids"))
    return tx.manifest_gate(m, ["prediction_time"], F.lit(True), "study_ids").select("c_custkey", "problem")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderkey END) AS target, 'Linked Report Count: ' || o_custkey || ' of 9' AS line, 'do ' || o_orderkey AS instruction FROM orders")
def h34_h35_target_and_counts(t):
    o = t.orders
    text = F.concat(F.lit("a<task_instruction> do "), F.col("o_orderkey").cast("string"), F.lit(" </task_instruction>b"))
    target = tx.target_fallback(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")), F.col("o_orderkey"), ["F", "O"])
    return o.select("o_orderkey", target.alias("target"), tx.rewrite_count(F.lit("Linked Report Count: 77 of 9"), F.col("o_custkey")).alias("line"), tx.extract_instruction(text).alias("instruction"))


CALLS = "k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos FROM conversations), c AS (SELECT conv_id, pos, 'c' || (pos // 2) % 2 AS id FROM k WHERE role = 'assistant'), o AS (SELECT conv_id, pos, 'c' || ((pos - 1) // 2) % 2 AS id FROM k WHERE role = 'user')"


def _turns(t):
    from pyspark.sql import Window

    k = t.conversations.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    half = F.when(F.col("role") == "assistant", F.floor(F.col("pos") / 2)).otherwise(F.floor((F.col("pos") - 1) / 2))
    return k.where("role <> 'system'").select("conv_id", "pos", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), F.concat(F.lit("c"), (half % 2).cast("string")).alias("call_id"), F.length("text").alias("text"))


@query(f"WITH {CALLS} SELECT o.conv_id, o.id AS call_id, o.pos AS tool_at, max(c.pos) AS call_at FROM o JOIN c ON c.conv_id = o.conv_id AND c.id = o.id AND c.pos < o.pos GROUP BY ALL")
def d26_pair_calls(t):
    return tx.pair_calls(_turns(t), "conv_id", "pos").select("conv_id", "call_id", "tool_at", "call_at")


@query(f"WITH {CALLS}, a AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM c), b AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM o) SELECT b.conv_id, b.n, a.pos AS tool_at, b.pos AS call_at FROM b JOIN a USING (conv_id, n) WHERE b.pos < a.pos")
def d27_pair_calls_fifo(t):
    swapped = _turns(t).withColumn("role", F.when(F.col("role") == "tool", "assistant").otherwise("tool"))
    return tx.pair_calls_fifo(swapped, "conv_id", "pos").select("conv_id", F.col("n").cast("bigint").alias("n"), "tool_at", "call_at")
