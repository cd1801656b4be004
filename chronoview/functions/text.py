"""Text, answer and message functions: column expressions, and Arrow functions where a scan needs code."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters per token, share of a window that history may fill, and the largest window.
CHARS_PER_TOKEN, HISTORY_SHARE, WINDOW_CAP = 1.6, 0.95, 100_000


def normalize_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_tool_name(c: Column, families: Sequence[str] = ("ehr",)) -> Column:
    return F.regexp_replace(c, rf"^({'|'.join(families)})_", "$1.")


def build_qid(explicit: Column, task: Column, subject: Column, encounter: Column) -> Column:
    return F.coalesce(explicit, F.concat_ws("_", task, subject.cast("string"), encounter.cast("string")))


def task_of_qid(qid: Column) -> Column:
    """What is left of a qid without its numeric suffixes."""
    return F.regexp_replace(qid, r"(_\d+)+$", "")


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN)


def model_window(name: Column, windows: Sequence[tuple[str, int]], default: int) -> Column:
    """The window of the first entry whose text the model's name holds, at most WINDOW_CAP."""
    out = F.lit(default)
    for part, size in reversed(windows):
        out = F.when(F.contains(F.lower(name), F.lit(part)), F.lit(size)).otherwise(out)
    return F.least(out, F.lit(WINDOW_CAP))


def history_budget(window: Column, reserved: Column) -> Column:
    left = F.floor(window * HISTORY_SHARE) - reserved
    return F.when(left <= 0, F.raise_error(F.lit("no room for history")).cast("bigint")).otherwise(left)


def extract_instruction(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?s)<task_instruction>(.*?)</task_instruction>", 1)), F.lit(""))


def rewrite_count(c: Column, n: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"Linked Report Count: \d+"), F.concat(F.lit("Linked Report Count: "), n.cast("string")))


def strip_protocol(c: Column, heading: str = "## Protocol") -> Column:
    """Without the section of that heading, up to the next heading of its level or the end."""
    return F.regexp_replace(c, rf"(?s){heading}\n.*?(?=\n## |$)\n?", "")


def last_answer(c: Column) -> Column:
    """The text in the last pair of answer tags."""
    return F.element_at(F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), -1)


def answer_items(c: Column) -> Column:
    """Items of an answer: one per line, less reasoning, bullets, numbers and markdown."""
    block = F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)), c), r"(?s)<think>.*?</think>", "")
    lines = F.transform(F.split(block, r"\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*([-*•]|\d+[.)])\s*", ""), r"[*_`]", "")))
    return F.filter(lines, lambda x: x != "")


def _loads(text: str | None) -> list[str] | None:
    """A list from JSON or a Python literal, also one cut off before its end; else null."""
    if not text or "[" not in text:
        return None
    start = text.index("[")
    for end in sorted({text.rfind("]") + 1, len(text)}):
        if end <= start:  # no bracket closes it: there is nothing to read yet
            continue
        piece = text[start:end]
        for close in ("", "]", '"]', "']"):
            for read in (json.loads, ast.literal_eval):
                try:
                    found = read(piece + close)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(found, list):
                    return [str(x) for x in found]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_list(texts: pd.Series) -> pd.Series:
    """Lists in JSON or Python form within texts, repaired at their end."""
    return texts.map(_loads)


_RESPONSE = re.compile(r"""\{\s*["']response["']\s*:""")


def _closed(text: str) -> list[str]:
    """An object from its first brace on as text that may be read: as far as its own end, or, where it is cut off, with what
    is open closed. Of a cut-off one also the form without what follows its last comma."""
    opened: list[str] = []
    quote, escaped, comma = "", False, None
    for i, c in enumerate(text):
        if quote:
            quote, escaped = ("" if c == quote and not escaped else quote), c == "\\" and not escaped
        elif c in "\"'":
            quote = c
        elif c in "[{":
            opened.append("]" if c == "[" else "}")
        elif c in "]}":
            if not opened or opened.pop() != c:
                return []
            if not opened:
                return [text[: i + 1]]
        elif c == ",":
            comma = (i, "".join(reversed(opened)))
    tail = text[:-1] if quote and escaped else text
    forms = [(tail + quote if quote else tail.rstrip().rstrip(",")) + "".join(reversed(opened))]
    return forms + ([text[: comma[0]] + comma[1]] if comma else [])


def _embedded(text: str | None) -> list[str] | None:
    for m in reversed(list(_RESPONSE.finditer(text or ""))):
        for form in _closed(text[m.start() :]):
            for read in (json.loads, ast.literal_eval):
                try:
                    found = read(form)["response"]
                except (ValueError, SyntaxError, MemoryError, RecursionError, KeyError, TypeError):
                    continue
                return [str(x) for x in found] if isinstance(found, list) else [str(found)]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def embedded_response(texts: pd.Series) -> pd.Series:
    """The response of the last object ``{"response": ...}`` within each text that can be read, as JSON or Python,
    also one cut off anywhere in its value; text that is no list counts as one item. Null without one."""
    return texts.map(_embedded)


def finish_response(messages: Column) -> Column:
    """The response argument of the last call named finish; null without one."""
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))))
    ends = F.filter(calls, lambda c: c["function"]["name"] == "finish")
    return F.get_json_object(F.try_element_at(ends, F.lit(-1))["function"]["arguments"], "$.response")


def response_source(response: Column) -> Column:
    """list, string or none, as the response is a JSON list, other text or missing."""
    parsed = F.from_json(response, "array<string>")
    return F.when(response.isNull(), "none").when(response.startswith("[") & parsed.isNotNull(), "list").otherwise("string")


def mentions(text: Column, official: Column) -> Column:
    """Official names that occur in a text, in the order of their first place."""
    low = F.lower(text)
    placed = F.transform(F.array_distinct(official), lambda n: F.struct(F.position(F.lower(n), low).alias("at"), n.alias("name")))
    return F.transform(F.array_sort(F.filter(placed, lambda s: s["at"] > 0)), lambda s: s["name"])


def align(pred: Column, vocabulary: Column) -> Column:
    """The official name that equals it after normalising, else the first that holds it or that it holds, else
    itself. A text that normalises to nothing matches no name, on either side."""
    norm = normalize_text
    vocabulary = F.filter(vocabulary, lambda v: norm(v) != "")
    same = F.filter(vocabulary, lambda v: norm(v) == norm(pred))
    near = F.filter(vocabulary, lambda v: F.contains(norm(v), norm(pred)) | F.contains(norm(pred), norm(v)))
    return F.when(norm(pred) == "", pred).otherwise(F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(near, F.lit(1)), pred))


def count_tool_calls(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.greatest(F.coalesce(F.size(m["tool_calls"]), F.lit(0)), F.lit(0)))


def count_turns(messages: Column, role: str = "assistant") -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == role))


def needs_final_round(status: Column, response: Column) -> Column:
    return (status != "error") & (response.isNull() | (F.trim(response) == ""))


def training_mask(messages: Column) -> Column:
    return F.transform(messages, lambda m: (m["role"] == "assistant").cast("int"))


def exact_match(answer: Column, golds: Column) -> Column:
    """1 for an equal text after lower case, without punctuation and articles; whole words only."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", ""), r"\b(a|an|the)\b", " "), r"\s+", " "))
    return F.exists(golds, lambda g: norm(g) == norm(answer)).cast("double")


def score_exact_match(text: Column, golds: Column) -> Column:
    """Of the last answer; a text with more than ten answer tags gets a quarter."""
    tags = F.regexp_count(text, F.lit("<answer>"))
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))
    score = F.coalesce(exact_match(found, golds), F.lit(0.0))
    return F.when(tags > 10, score / 4).otherwise(score)


def last_number(text: Column, strict: bool = False) -> Column:
    """The number after "####", or the last number of the last 300 characters."""
    tail = F.right(text, F.lit(300))
    pattern = r"####\s*(-?[0-9.,]+)" if strict else r"(-?[0-9.,]*[0-9])"
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(tail, F.lit(pattern), F.lit(1)), F.lit(-1)), r"[,$]", "")


def format_reward(text: Column, tags: Sequence[str] = ("think", "answer")) -> Column:
    """1 if the tags come once each, in order, around all of the text."""
    layout = r"(?s)^\s*" + r"\s*".join(rf"<{t}>.*</{t}>" for t in tags) + r"\s*$"
    once = F.lit(True)
    for t in tags:
        once = once & (F.regexp_count(text, F.lit(f"<{t}>")) == 1)
    return (text.rlike(layout) & once).cast("double")


def overlong_penalty(length: Column, expected: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - expected) / F.lit(float(buffer)) * factor, F.lit(0.0))


def score_by_source(source: Column, scorers: dict[str, Column]) -> Column:
    """The scorer of the row's data source; an unknown source is an error."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double")
    for name, value in scorers.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def name_overlap(pred: Column, gold: Column) -> Column:
    """Multiset Jaccard of two lists of names."""
    names = F.array_distinct(F.concat(pred, gold))
    n = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    total = lambda f: F.aggregate(F.transform(names, f), F.lit(0), lambda a, b: a + b)
    common, both = total(lambda x: F.least(n(pred, x), n(gold, x))), total(lambda x: F.greatest(n(pred, x), n(gold, x)))
    return F.when(both == 0, 1.0).otherwise(common / both)


def _agreement(one: list, two: list) -> float:
    """Multiset Jaccard of two lists of names; two empty ones agree."""
    a, b = Counter(one), Counter(two)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def _calls(text: str | None) -> list[tuple[str, dict]]:
    return [(c["name"], c.get("arguments", c.get("parameters")) or {}) for c in json.loads(text or "[]")]


def tool_call_score(pred: Column, gold: Column, low: float = -3.0, high: float = 3.0) -> Column:
    """How well calls agree with the gold ones, from low to high; both are JSON lists of {name, arguments}.

    Names count their multiset Jaccard. Each gold call in turn takes the unused call of its name that agrees best in argument
    names (multiset Jaccard) and equal values (one each). What is reached is divided by what can be: one, and one
    for each gold call and each of its arguments. Equal lists score high. Null counts as an empty list.
    """

    def one(p: str | None, g: str | None) -> float:
        said, wanted = _calls(p), _calls(g)
        if said == wanted:
            return high
        reached, most, free = _agreement([n for n, _ in said], [n for n, _ in wanted]), 1.0, list(said)
        for name, arguments in wanted:
            most += 1 + len(arguments)
            worth = [_agreement(list(a), list(arguments)) + sum(k in a and a[k] == v for k, v in arguments.items()) if n == name else 0.0 for n, a in free]
            if max(worth, default=0.0) > 0:
                reached += max(worth)
                del free[worth.index(max(worth))]
        return (high - low) * reached / most + low

    @F.pandas_udf(T.DoubleType())
    def scored(preds: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([one(p, g) for p, g in zip(preds, golds, strict=True)])

    return scored(pred, gold)


def parse_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks that begin with "## label [time]": label, time text, and rows (markdown rows after their two
    heading lines, or one for a list of fields)."""
    lines = df.select(key, F.posexplode(F.split(text, r"\n")).alias("pos", "line"))
    head = r"^## (.+?)(?: \[(.*)\])?$"
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("_h", F.col("line").rlike(head)).withColumn("block", F.sum(F.col("_h").cast("int")).over(w)).where("block > 0")
    rows = F.count_if(F.col("line").startswith("|"))
    return marked.groupBy(key, "block").agg(
        F.max(F.when(F.col("_h"), F.regexp_extract("line", head, 1))).alias("label"),
        F.max(F.when(F.col("_h"), F.regexp_extract("line", head, 2))).alias("at"),
        F.when(rows > 0, rows - 2).otherwise(F.lit(1)).alias("rows"),
    )


def render_blocks(df: DataFrame, key: str, block: str, line: Column, order: str) -> DataFrame:
    """The lines of each block, in order, as one text."""
    w = df.groupBy(key, block).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return w.select(key, block, F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("body"))


def replace_block(question: Column, old: Column, new: Column) -> Column:
    """The old block's literal text replaced, and whether it was there."""
    return F.struct(F.replace(question, old, new).alias("text"), F.contains(question, old).alias("found"))


def fold_think(turns: DataFrame, key: str, order: str) -> DataFrame:
    """turns (key, order, role, kind, text): turns of kind think and all tool replies to them vanish; their
    text moves to the reasoning of the next assistant turn that acts."""
    w = Window.partitionBy(key).orderBy(order)
    think = (F.col("role") == "assistant") & (F.col("kind") == "think")
    acts = (F.col("role") == "assistant") & (F.col("kind") != "think")
    asked = F.last(F.when(F.col("role") == "assistant", think), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = turns.withColumn("_think", think).withColumn("_reply", (F.col("role") == "tool") & asked)
    island = marked.withColumn("_i", F.coalesce(F.sum(acts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    thought = island.where("_think").groupBy(key, "_i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda s: s["text"]), "\n").alias("reasoning"))
    kept = island.where("not _think and not coalesce(_reply, false)").join(thought, [key, "_i"], "left")
    return kept.select(key, order, "role", "text", F.when(acts, F.col("reasoning")).alias("reasoning"))


def pair_calls(turns: DataFrame, key: str, order: str) -> DataFrame:
    """turns (key, order, role, call_id, text): each tool turn with the nearest call of its id before it."""
    calls = turns.where("role = 'assistant' and call_id is not null").select(key, "call_id", F.col(order).alias("call_at"))
    tools = turns.where("role = 'tool'").select(key, "call_id", F.col(order).alias("tool_at"), "text")
    j = tools.join(calls, [key, "call_id"]).where("call_at < tool_at")
    return j.groupBy(key, "call_id", "tool_at", "text").agg(F.max("call_at").alias("call_at"))


def pair_calls_fifo(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Without ids: the n-th tool turn answers the n-th call."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    calls = turns.where("role = 'assistant'").select(key, F.col(order).alias("call_at"), n.alias("n"))
    tools = turns.where("role = 'tool'").select(key, F.col(order).alias("tool_at"), n.alias("n"))
    return tools.join(calls, [key, "n"]).where("call_at < tool_at")


def manifest_gate(manifest: DataFrame, required: Sequence[str], image_scope: Column, ids: str) -> DataFrame:
    """Questions that may not run, with what is missing."""
    problem = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required], F.when(image_scope & (F.coalesce(F.size(ids), F.lit(0)) <= 0), F.lit(ids)))
    return manifest.withColumn("problem", problem).where("problem <> ''")


def target_fallback(task: Column, target: Column, encounter: Column, tasks: Sequence[str]) -> Column:
    return F.coalesce(target, F.when(task.isin(*tasks), encounter))
