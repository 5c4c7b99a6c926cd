"""Queries of event streams: replies are cut into five-character deltas, then into chunks of 37 characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions.redact import masked_output
from gatewarden.operators import sse
from gatewarden.operators.tools import ToolGate
from gatewarden.plans.redaction import mask_sql
from gatewarden.plans.registry import TURNS, q, query, turns

END = "data: [DONE]"
#: The body of a reply in SQL, with plain line ends.
EMITTED = """': hello' || chr(10) || chr(10) || array_to_string(list_transform(range(1, CAST(ceil(length(text) / 5.0) AS BIGINT) + 1), lambda i: 'data: {"choices":[{"delta":{"content":' || CAST(to_json(substr(text, CAST((i - 1) * 5 + 1 AS BIGINT), 5)) AS VARCHAR) || '}}]}' || chr(10) || chr(10)), '')
|| 'data: {"usage":{"prompt_tokens":' || length(text) || ',"completion_tokens":' || CAST(ceil(length(text) / 5.0) AS BIGINT) || '},"model":"m1"}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) || CASE WHEN request_id % 7 = 0 THEN 'data: cut' ELSE '' END"""


def bodies(spark, folder):
    """request_id, body, text: one reply a turn of the assistant; every fifth has CRLF line ends, every seventh a broken tail."""
    rows = turns(spark, folder).where("role = 'assistant' and text is not null")
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text"))
    n = F.ceil(F.length("text") / 5).cast("int")
    literal = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    event = lambda t: F.concat(F.lit('data: {"choices":[{"delta":{"content":'), literal(t), F.lit("}}]}"))
    events = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,5}"), F.lit(0)), event)
    last = F.concat(F.lit('data: {"usage":{"prompt_tokens":'), F.length("text").cast("string"), F.lit(',"completion_tokens":'), n.cast("string"), F.lit('},"model":"m1"}'))
    events = F.concat(F.array(F.lit(": hello")), events, F.array(last, F.lit(END)))
    gap = F.when(F.col("request_id") % 5 == 0, "\r\n\r\n").otherwise("\n\n")
    body = F.concat(F.array_join(events, "\x00"), F.lit("\x00"), F.when(F.col("request_id") % 7 == 0, "data: cut").otherwise(""))
    return rows.select("request_id", "text", F.replace(body, F.lit("\x00"), gap).alias("body"))


def chunks(spark, folder):
    rows = bodies(spark, folder)
    return rows.select("request_id", F.posexplode(F.regexp_extract_all("body", F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "chunk")).repartition("seq")


REPLIES = f"(SELECT conv_id * 1000 + turn AS request_id, text FROM {TURNS} WHERE role = 'assistant' AND text IS NOT NULL)"
N = "CAST(ceil(length(text) / 5.0) AS BIGINT)"


@query("stream_reassembly", f"SELECT request_id, {N} + 3 AS n_events, CASE WHEN request_id % 7 = 0 THEN 'data: cut' ELSE '' END AS rest FROM {REPLIES} r")
def stream_reassembly(spark, folder):
    rows = sse.reassembled(chunks(spark, folder))
    return rows.select("request_id", F.size("events").cast("long").alias("n_events"), "rest")


@query("stream_content", f"SELECT request_id, text FROM {REPLIES} r")
def stream_content(spark, folder):
    return sse.content(sse.reassembled(chunks(spark, folder)))


@query("stream_usage", f"SELECT request_id, length(text) AS prompt_tokens, {N} AS completion_tokens, 'm1' AS model FROM {REPLIES} r")
def stream_usage(spark, folder):
    return sse.usage(sse.reassembled(chunks(spark, folder)))


@query("stream_spend", f"SELECT request_id % 10 AS api_key, CAST(sum(length(text) + {N}) AS BIGINT) AS tokens FROM {REPLIES} r GROUP BY 1")
def stream_spend(spark, folder):
    used = sse.spend(sse.usage(sse.reassembled(chunks(spark, folder))), F.col("request_id") % 10)
    return used.groupBy("api_key").agg(F.sum("tokens").alias("tokens"))


UPPER = "array_to_string(list_transform(range(1, {n} + 1), lambda i: {f}), '')".format(n=N, f=mask_sql("substr(text, CAST((i - 1) * 5 + 1 AS BIGINT), 5)"))


@query("stream_filtered", f"SELECT request_id, {UPPER} AS text FROM {REPLIES} r")
def stream_filtered(spark, folder):
    """Each delta masked on its own, as the stream does: a phrase cut by two deltas stays."""
    rows = sse.reassembled(chunks(spark, folder))
    rows = rows.withColumn("events", F.transform("events", lambda e: sse.filtered(e, masked_output)))
    return sse.content(rows)


@query("stream_emitted", f"SELECT request_id, sha256({EMITTED}) AS digest FROM {REPLIES} r")
def stream_emitted(spark, folder):
    """Events that no filter changes go out as they came, with plain line ends between them."""
    rows = sse.reassembled(chunks(spark, folder))
    out = sse.emitted(F.transform("events", lambda e: sse.filtered(e, lambda t: t)), F.col("rest"))
    return rows.select("request_id", F.sha2(out, 256).alias("digest"))


def multi(spark, folder):
    """Replies whose events have a comment, several data lines and two choices; usage stands in a second data line."""
    rows = turns(spark, folder).where("role = 'assistant' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    literal = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    delta = F.concat(F.lit(': note\nevent: m\ndata: {"choices":[{"delta":{}},{"delta":{"content":'), literal, F.lit('}}]}\ndata: {"choices":[{"delta":{"content":"my password"}}],"usage":{"prompt_tokens":'), F.length("text").cast("string"), F.lit(',"completion_tokens":7}}'))
    other = F.lit('data: not json\ndata: {"usage":{"prompt_tokens":"x"}}')
    last = F.lit('data: {"usage":{"prompt_tokens":1,"completion_tokens":2}}\ndata: [DONE]')
    return rows.select("request_id", F.concat(F.array(delta, other), F.when(F.col("request_id") % 3 == 0, F.array(last)).otherwise(F.array().cast("array<string>"))).alias("events"))


@query("stream_usage_lines", f"SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 1 ELSE length(text) END AS prompt_tokens, CASE WHEN request_id % 3 = 0 THEN 2 ELSE 7 END AS completion_tokens, 'unknown' AS model FROM {REPLIES} r")
def stream_usage_lines(spark, folder):
    return sse.usage(multi(spark, folder))


@query("stream_filtered_choices", f"SELECT request_id, {mask_sql('text')} AS second, {mask_sql(q('my password'))} AS later FROM {REPLIES} r")
def stream_filtered_choices(spark, folder):
    """Deltas are masked in every choice and every data line."""
    out = multi(spark, folder).select("request_id", sse.payloads(sse.filtered(F.get("events", 0), masked_output)).alias("p"))
    return out.select("request_id", F.get_json_object(F.get("p", 0), "$.choices[1].delta.content").alias("second"), F.get_json_object(F.get("p", 1), "$.choices[0].delta.content").alias("later"))


@query("stream_restored", f"SELECT request_id, text || ' mail a@b.io ' || '[{'x' * 70}] [none] a@b.io' AS text FROM {REPLIES} r")
def stream_restored(spark, folder):
    vault = F.array(F.struct(F.lit("[EMAIL_1]").alias("placeholder"), F.lit("a@b.io").alias("original")))
    text = F.concat("text", F.lit(f" mail [EMAIL_1] [{'x' * 70}] [none] [EMAIL_1]"))
    return bodies(spark, folder).select("request_id", sse.restored_stream(text, vault).alias("text"))


GATE = ToolGate(deny=("delete_*",))


def call_streams(spark, folder):
    """Two calls a reply: the first in three deltas, the second in one; of odd replies the second is denied."""
    rows = bodies(spark, folder).select("request_id")
    second = F.when(F.col("request_id") % 2 == 1, "delete_user").otherwise("search")
    delta = lambda inner: F.concat(F.lit('data: {"choices":[{"delta":{"tool_calls":['), inner, F.lit("]}}]}"))
    events = F.array(
        delta(F.lit('{"index":0,"id":"a","function":{"name":"look"}}')), delta(F.lit('{"index":0,"function":{"arguments":"{\\"id"}}')),
        delta(F.concat(F.lit('{"index":1,"id":"b","function":{"name":"'), second, F.lit('","arguments":"{}"}}'))), delta(F.lit('{"index":0,"function":{"arguments":"\\":1}"}}')),
        F.lit('data: {"choices":[{"delta":{},"finish_reason":"tool_calls"}]}'), F.lit(END),
    )
    return rows.select("request_id", events.alias("events"))


@query("stream_tool_calls", f"SELECT request_id, 0 AS index, 'a' AS id, 'look' AS name, '{{\"id\":1}}' AS arguments FROM {REPLIES} r UNION ALL SELECT request_id, 1, 'b', CASE WHEN request_id % 2 = 1 THEN 'delete_user' ELSE 'search' END, '{{}}' FROM {REPLIES} s")
def stream_tool_calls(spark, folder):
    return sse.tool_calls(call_streams(spark, folder)).select("request_id", F.col("index").cast("int").alias("index"), "id", "name", "arguments")


DENIAL = '{"error":{"type":"tool_call_denied","message":"the tool gate denied one or more tool calls","reasons":["tool `delete_user` is on the deny list"]}}'


@query("stream_tool_denials", f"SELECT request_id, 'data: ' || {q(DENIAL)} || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS event FROM {REPLIES} r WHERE request_id % 2 = 1")
def stream_tool_denials(spark, folder):
    rows = sse.denied(sse.tool_calls(call_streams(spark, folder)), GATE)
    return rows.select("request_id", sse.deny_event(F.col("reasons")).alias("event"))


_DELTAS = """['data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"a","function":{"name":"look"}}]}}]}', 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"{\\"id"}}]}}]}',
'data: {"choices":[{"delta":{"tool_calls":[{"index":1,"id":"b","function":{"name":"' || CASE WHEN request_id % 2 = 1 THEN 'delete_user' ELSE 'search' END || '","arguments":"{}"}}]}}]}', 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"\\":1}"}}]}}]}']"""
_AFTER = """['data: {"choices":[{"delta":{},"finish_reason":"tool_calls"}]}', 'data: [DONE]']"""
_DENIED = f"['data: ' || {q(DENIAL)} || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)]"


@query("stream_gated", f"SELECT request_id, request_id % 2 = 1 AS denied, array_to_string({_DELTAS} || CASE WHEN request_id % 2 = 1 THEN {_DENIED} ELSE {_AFTER} END, chr(10)) AS events FROM {REPLIES} r")
def stream_gated(spark, folder):
    """What goes out of a reply whose calls are gated: all of it, or up to the finish of denied calls and the event that ends it."""
    rows = sse.gated(call_streams(spark, folder).withColumn("rest", F.lit("")), GATE)
    return rows.select("request_id", "denied", F.array_join("events", "\n").alias("events"))
