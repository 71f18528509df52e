"""Sources: context blocks, chat requests of two providers, message lists, files and transcripts, as blocks of sessions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import token_count
from ..operators import codecs
from ..plans.segments import KINDS, ROLES, checked, positioned, ranked
from ..shared import unbounded, written

BLOCK = "role string, kind string, class string, path string, text string"
#: What stands for a dropped or a replaced tool output in a request.
DROPPED, REPLACED = "[tool output elided — {}]", "[delta vs an earlier read]\n"


def context_blocks(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """rows(session_id, value): a JSON array of blocks each -> blocks; bad JSON, roles or kinds are errors."""
    parsed = F.from_json(json_col, f"array<struct<{BLOCK.replace(' string', ': string')}>>", {"mode": "FAILFAST"})
    b = rows.select("session_id", F.posexplode(parsed).alias("position", "b"))
    return b.select("session_id", "position", checked(F.col("b.role"), ROLES, "role").alias("role"), checked(F.col("b.kind"), KINDS, "kind").alias("kind"), F.col("b.class").alias("tool_class"), F.col("b.path").alias("path"), F.col("b.text").alias("text"))


def message_blocks(messages: DataFrame) -> DataFrame:
    """messages(session_id, position, role, text[, name, tool_call_id]) -> blocks: system prompts, tool outputs and turns."""
    has = lambda n: F.col(n) if n in messages.columns else F.lit(None).cast("string")
    kind = F.when(F.col("role") == "system", "system_prompt").when(F.col("role") == "tool", "tool_output").otherwise("conversation_turn")
    return messages.select("session_id", "position", F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("user").alias("role"), kind.alias("kind"), F.when(F.col("role") == "tool", F.coalesce(has("name"), has("tool_call_id"), F.lit("tool"))).alias("tool_class"), F.lit(None).cast("string").alias("path"), "text")


def content_text(content: Column) -> Column:
    """The text of a message's content given as JSON: a string, or parts of which those without text stay JSON."""
    parts = F.from_json(content, "array<string>")
    plain = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]
    text = F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p))
    return F.when(F.ltrim(content).startswith("["), F.array_join(text, "\n")).otherwise(plain)


def last_user_text(messages: DataFrame) -> DataFrame:
    """session_id, task: the text of each session's last user message."""
    return messages.where("role = 'user'").groupBy("session_id").agg(F.coalesce(F.max_by("text", "position"), F.lit("")).alias("task"))


_PART = "type string, id string, name string, input string, tool_use_id string, text string, content variant, cache_control string"


def _is_text(value: Column) -> Column:
    """Whether a variant is a string: one that begins with a bracket is no array."""
    return F.schema_of_variant(value) == "STRING"


def _is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def anthropic_parts(requests: DataFrame) -> DataFrame:
    """requests(session_id, body) -> session_id, mi, bi, role, p: each content block of each message; string contents are text blocks."""
    messages = F.from_json(F.get_json_object("body", "$.messages"), "array<struct<role: string, content: variant, cache_control: string>>")
    m = requests.select("session_id", F.posexplode(messages).alias("mi", "m"))
    content = F.col("m.content")
    parts = F.when(_is_array(content), F.from_json(F.to_json(content), f"array<struct<{_PART.replace(' string', ': string').replace(' variant', ': variant')}>>"))
    whole = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), _text(content).alias("text"))), _PART))
    return m.select("session_id", "mi", F.col("m.role").alias("role"), F.col("m.cache_control").isNotNull().alias("marked"), F.posexplode(F.coalesce(parts, whole)).alias("bi", "p"))


def anthropic_tool_results(requests: DataFrame) -> DataFrame:
    """session_id, position, mi, bi, inner, role, kind, tool_class, path, text, cached of the tool results of each request.

    A result takes name and path from the last tool use of its id. A result of several parts gives a row for each text part.
    cached: at or before the last block that a cache mark covers. Requests are parsed once, into a written table of what
    uses, marks, results and their places need; texts meet the rest by key.
    """
    use, result = F.col("p.type") == "tool_use", F.col("p.type") == "tool_result"
    content = F.col("p.content")
    one = F.when(_is_text(content), F.array(F.struct(F.lit("text").alias("type"), _text(content).alias("text"))))
    inner = F.when(_is_array(content), F.from_json(F.to_json(content), "array<struct<type: string, text: string>>")).otherwise(one)
    path = F.coalesce(F.get_json_object("p.input", "$.path"), F.get_json_object("p.input", "$.file_path"))
    parts = anthropic_parts(requests).select(
        "session_id", "mi", "bi", use.alias("use"), F.when(use, F.col("p.id")).when(result, F.col("p.tool_use_id")).alias("use_id"), F.when(use, F.col("p.name")).alias("name"), F.when(use, path).alias("path"),
        F.when(result, inner).alias("texts"), F.when(F.col("marked"), F.lit(1 << 30)).when(F.col("p.cache_control").isNotNull(), F.col("bi")).alias("mark"),
    )
    parts = written(parts.where("use or texts is not null or mark is not null"))
    uses = parts.where("use").groupBy("session_id", "use_id").agg(F.max_by(F.struct("name", "path"), F.struct("mi", "bi")).alias("u"))
    marks = parts.where("mark is not null").groupBy("session_id").agg(F.max(F.struct("mi", F.col("mark").alias("bi"))).alias("mark"))
    rows = parts.where("texts is not null").select("session_id", "mi", "bi", "use_id", F.posexplode("texts").alias("inner", "t")).where("t.type = 'text'")
    place = ["session_id", "mi", "bi", "inner"]
    found = rows.select(*place, "use_id").join(unbounded(uses), ["session_id", "use_id"], "left").join(unbounded(marks), "session_id", "left")
    found = found.select(
        *place, F.lit("tool").alias("role"), F.when(F.col("u.path").isNotNull(), "file_read").otherwise("tool_output").alias("kind"), F.coalesce("u.name", F.lit("tool_result")).alias("tool_class"), F.col("u.path").alias("path"),
        F.coalesce(F.struct("mi", "bi") <= F.struct(F.col("mark.mi").alias("mi"), F.col("mark.bi").alias("bi")), F.lit(False)).alias("cached"),
    )
    return ranked(found, "mi", "bi", "inner").join(unbounded(rows.select(*place, F.col("t.text").alias("text"))), place)


def openai_tool_results(requests: DataFrame) -> DataFrame:
    """session_id, position, mi, role, kind, tool_class, path, text of the tool messages of each request; the last call of an id counts."""
    call = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
    messages = F.from_json(F.get_json_object("body", "$.messages"), f"array<struct<role: string, content: variant, tool_call_id: string, tool_calls: {call}>>")
    m = requests.select("session_id", F.posexplode(messages).alias("mi", "m"))
    calls = m.select("session_id", "mi", F.posexplode("m.tool_calls").alias("ci", "c")).groupBy("session_id", F.col("c.id").alias("call_id"))
    calls = calls.agg(F.max_by(F.struct(F.col("c.function.name").alias("name"), F.coalesce(F.get_json_object("c.function.arguments", "$.path"), F.get_json_object("c.function.arguments", "$.file_path")).alias("path")), F.struct("mi", "ci")).alias("u"))
    rows = m.where((F.col("m.role") == "tool") & _is_text(F.col("m.content"))).select("session_id", "mi", F.col("m.tool_call_id").alias("call_id"), _text(F.col("m.content")).alias("text")).join(calls, ["session_id", "call_id"], "left")
    rows = rows.select("session_id", "mi", F.lit("tool").alias("role"), F.when(F.col("u.path").isNotNull(), "file_read").otherwise("tool_output").alias("kind"), F.coalesce("u.name", F.lit("tool_result")).alias("tool_class"), F.col("u.path").alias("path"), "text")
    return positioned(rows, "mi")


def written_back(results: DataFrame, plan: DataFrame, least_savings: int = 0, lossy: DataFrame | None = None) -> DataFrame:
    """results with text as it goes back into the request: a stub for what is dropped, the delta for what is replaced.

    lossy(session_id, position, short): what stands for kept results instead. A session whose plan saves fewer than
    least_savings tokens stays as it was, and so does what the plan doesn't name, as the cached prefix.
    """
    tokens = F.expr("CASE action WHEN 'keep' THEN token_count WHEN 'replace' THEN new_tokens ELSE 0 END")
    worth = plan.groupBy("session_id").agg((F.sum("token_count") - F.sum(tokens)).alias("saved")).where(F.col("saved") >= least_savings).select("session_id", F.lit(True).alias("worth"))
    rows = results.join(unbounded(plan.select("session_id", F.col("seg_id").cast("int").alias("position"), "action", "reason", "rendered")), ["session_id", "position"], "left").join(unbounded(worth), "session_id", "left")
    short = F.lit(None).cast("string")
    if lossy is not None:
        rows, short = rows.join(unbounded(lossy.select("session_id", "position", "short")), ["session_id", "position"], "left"), F.col("short")
    stub = F.concat(F.lit(DROPPED.split("{}")[0]), F.coalesce("reason", F.lit("")), F.lit(DROPPED.split("{}")[1]))
    text = F.when(F.col("action") == "drop", stub).when(F.col("action") == "replace", F.concat(F.lit(REPLACED), "rendered")).when(F.col("action") == "keep", F.coalesce(short, "text")).otherwise(F.col("text"))
    return rows.withColumn("text", F.when(F.coalesce("worth", F.lit(False)), text).otherwise(F.col("text"))).drop("worth", "action", "reason", "rendered", "short")


@F.pandas_udf(T.StringType())
def _put_texts(bodies: pd.Series, changes: pd.Series) -> pd.Series:
    def put(body: str | None, new) -> str | None:
        if body is None or new is None or not len(new):
            return body
        request = codecs.parse_json(body)
        for c in new:
            message = request["messages"][c["mi"]]
            if c["bi"] is None:
                message["content"] = c["text"]
                continue
            block = message["content"][c["bi"]]
            if isinstance(block["content"], str):
                block["content"] = c["text"]
            else:
                block["content"][c["inner"]]["text"] = c["text"]
        return json.dumps(request, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([put(b, c) for b, c in zip(bodies, changes, strict=True)], dtype=object)


def rebuilt(requests: DataFrame, results: DataFrame, texts: DataFrame) -> DataFrame:
    """requests(session_id, body) with texts(session_id, position, text) where they differ from those of results.

    A request without changes keeps its body to the byte. The changes of one request meet as one array.
    """
    at = lambda n: F.col(n) if n in results.columns else F.lit(None).cast("int").alias(n)
    places = results.select("session_id", "position", "mi", at("bi"), at("inner"), F.col("text").alias("old"))
    changed = texts.select("session_id", "position", "text").join(unbounded(places), ["session_id", "position"]).where("text <> old")
    by = changed.groupBy("session_id").agg(F.collect_list(F.struct("mi", "bi", "inner", "text")).alias("changes"))
    return requests.join(unbounded(by), "session_id", "left").withColumn("body", F.when(F.col("changes").isNull(), F.col("body")).otherwise(_put_texts("body", "changes"))).drop("changes")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the non-empty files of a folder, not of folders in it."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(F.char_length("text") > 0)


def transcript_results(spark: SparkSession, path: str) -> DataFrame:
    """path, line, text of the tool results in transcripts of one JSON record a line; other lines are passed over."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("line"))
    parts = F.from_json(F.get_json_object("value", "$.message.content"), "array<struct<type: string, content: variant>>")
    rows = lines.where(F.try_parse_json("value").isNotNull()).select("path", "line", F.explode(parts).alias("p")).where("p.type = 'tool_result'")
    content = F.col("p.content")
    inner = F.from_json(F.to_json(content), "array<struct<type: string, text: string>>")
    text = F.when(_is_array(content), F.array_join(F.transform(F.filter(inner, lambda t: t["type"] == "text"), lambda t: t["text"]), "\n")).otherwise(_text(content))
    return rows.select("path", "line", text.alias("text")).where(F.char_length("text") > 0)


@F.pandas_udf(T.LongType())
def session_number(bodies: pd.Series) -> pd.Series:
    """A session's number, FNV-1a over the JSON of its system prompt and its first message; null for what isn't a JSON object.

    The number is unsigned; as a long it may be negative, share_of() takes its remainder as the unsigned one.
    """

    def number(body: str | None) -> int | None:
        try:
            request = codecs.parse_json(body or "")
        except (ValueError, RecursionError):
            return None
        if not isinstance(request, dict):
            return None
        messages = request.get("messages")
        first = messages[0] if isinstance(messages, list) and messages else None
        h = 0xCBF29CE484222325
        for part in ([request["system"]] if "system" in request else []) + ([first] if first is not None else []):
            for byte in codecs.dump_json(part).encode():
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([number(b) for b in bodies], dtype="Int64")


def unsigned_remainder(number: Column, n: int) -> Column:
    """The remainder of a long that stands for an unsigned number."""
    return F.pmod(F.pmod(number, F.lit(n)) + F.when(number < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))


def transcript_prompts(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """path, prompt: the first most characters of the last thing that a user typed in each transcript.

    A text part counts only before the first tool result of its transcript.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("line"))
    users = lines.where(F.try_parse_json("value").isNotNull()).where(F.get_json_object("value", "$.type") == "user").select("path", "line", F.get_json_object("value", "$.message.content").alias("content"))
    parts = F.from_json("content", "array<struct<type: string, text: string>>")
    listed = users.where(F.ltrim("content").startswith("[")).select("path", "line", F.posexplode(parts).alias("at", "p")).select("path", "line", "at", "p.type", F.trim("p.text").alias("text"))
    typed = users.where(~F.ltrim("content").startswith("[")).select("path", "line", F.lit(0).alias("at"), F.lit("typed").alias("type"), F.trim("content").alias("text"))
    rows = listed.union(typed)
    first = rows.where("type = 'tool_result'").groupBy("path").agg(F.min(F.struct("line", "at")).alias("first"))
    said = rows.where("type in ('text', 'typed') and text <> ''").join(first, "path", "left")
    said = said.where((F.col("type") == "typed") | F.col("first").isNull() | (F.struct("line", "at") < F.col("first")))
    return said.groupBy("path").agg(F.left(F.max_by("text", F.struct("line", "at")), F.lit(most)).alias("prompt"))


def with_prompts(results: DataFrame, prompts: DataFrame, most: int = 100) -> DataFrame:
    """results(path, ...) with task: the beginning of their transcript's prompt, empty without one."""
    return results.join(prompts, "path", "left").withColumn("task", F.coalesce(F.left("prompt", F.lit(most)), F.lit(""))).drop("prompt")


def largest_transcripts(results: DataFrame, n: int = 10) -> DataFrame:
    """path, tokens of the n transcripts with most tokens in their tool results."""
    return results.groupBy("path").agg(F.sum(token_count(F.col("text"))).alias("tokens")).orderBy(F.desc("tokens"), "path").limit(n)


def seeded_sample(rows: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if fewer, the same for the same rows and seed: those whose keys hash lowest."""
    return rows.orderBy(F.sha2(F.concat_ws("|", *key, F.lit(seed)), 256), *key).limit(n)


def json_rpc(lines: DataFrame) -> DataFrame:
    """lines(value) -> id, method, params, error of each call; a line that is no call has an error, an empty one is passed over."""
    call = F.try_parse_json("value")
    method = F.get_json_object("value", "$.method")
    error = F.when(call.isNull(), "parse error").when(method.isNull(), "invalid request")
    return lines.where(F.trim("value") != "").select(F.get_json_object("value", "$.id").alias("id"), method.alias("method"), F.get_json_object("value", "$.params").alias("params"), error.alias("error"))
