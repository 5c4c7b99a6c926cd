"""Event streams of chat replies, in batch: reassembly, filters, usage, tool calls, restoring.

Chunks (request_id, seq, chunk) of a reply are cut anywhere. A reply is gathered by its request, which bounds
a group by the length of one reply; everything after that is by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.functions.jsonshape import decoded, encoded
from gatewarden.functions.normalize import interleaved
from gatewarden.functions.redact import let, restored
from gatewarden.operators.tools import ToolGate

WINDOW = 64  # bytes after which an open bracket is no placeholder
PLACEHOLDER = r"\[[^\]]{0,62}\]|\[[^\]]{63}"
DELTAS = "choices array<struct<delta: struct<content: string>>>"
CONTENT = r'"content"\s*+:\s*+"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def reassembled(chunks: DataFrame, key: str = "request_id") -> DataFrame:
    """key, events (without the blank lines that end them), rest (what no blank line ended)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("_t"))
    parts = F.split("_t", r"\r\n\r\n|\n\n", -1)
    return whole.select(key, F.slice(parts, F.lit(1), F.size(parts) - 1).alias("events"), F.element_at(parts, -1).alias("rest"))


def payloads(event: Column) -> Column:
    """The data of all data lines of an event, in order; the end mark, comments and empty data are left out."""
    return F.regexp_extract_all(event, F.lit(r"(?m)^data:[ \t]*+(?!\[DONE\]\r?$)([^\r\n]+)"), F.lit(1))


def filtered(event: Column, change: Callable[[Column], Column]) -> Column:
    """An event with the texts of its deltas changed, in all choices and data lines.

    All else, events that do not change, and events that name the end mark stay as they are.
    """
    def new(m: Column) -> Column:
        old = decoded(F.regexp_replace(m, r'^"content"\s*:\s*', ""))
        return let(old, lambda x: let(change(x), lambda y: F.when(y == x, m).otherwise(F.concat(F.lit('"content":'), encoded(y)))))

    text = lambda p: F.exists(F.from_json(p, DELTAS)["choices"], lambda c: c["delta"]["content"].isNotNull())
    mine = ~F.contains(event, F.lit("[DONE]")) & F.contains(event, F.lit("data:")) & F.exists(payloads(event), lambda p: F.coalesce(text(p), F.lit(False)))
    return F.when(mine, interleaved(event, CONTENT, new)).otherwise(event)


def emitted(events: Column, rest: Column) -> Column:
    """The stream that goes out: every event with its blank line, then the rest as it came."""
    return F.concat(F.array_join(F.transform(events, lambda e: F.concat(e, F.lit("\n\n"))), ""), rest)


def usage(replies: DataFrame, key: str = "request_id") -> DataFrame:
    """key, prompt_tokens, completion_tokens, model of the last event that carries both counts.

    Of an event's data lines the first that carries both counts.
    """
    rows = replies.select(key, F.posexplode("events").alias("i", "event")).where(F.contains("event", F.lit('"usage"')))
    rows = rows.select(key, "i", F.posexplode(payloads(F.col("event"))).alias("k", "p")).select(key, "i", "k", F.from_json("p", "usage struct<prompt_tokens: string, completion_tokens: string>, model string").alias("u"))
    count = lambda n: F.col(f"u.usage.{n}").try_cast("long").alias(n)
    rows = rows.select(key, (-F.col("k")).alias("k"), "i", count("prompt_tokens"), count("completion_tokens"), F.coalesce("u.model", F.lit("unknown")).alias("model"))
    rows = rows.where("prompt_tokens >= 0 and completion_tokens >= 0")
    last = rows.groupBy(key).agg(F.max_by(F.struct("prompt_tokens", "completion_tokens", "model"), F.struct("i", "k")).alias("u"))
    return last.select(key, "u.*")


def content(replies: DataFrame, key: str = "request_id") -> DataFrame:
    """key, text: the texts of the first choice's deltas joined. Each event is parsed once."""
    text = lambda p: F.get(F.from_json(p, DELTAS)["choices"], 0)["delta"]["content"]
    return replies.select(key, F.array_join(F.transform(F.flatten(F.transform("events", payloads)), text), "").alias("text"))


def restored_stream(text: Column, vault: Column, strategy: str = "exact") -> Column:
    """Placeholders restored as the stream does: only whole brackets, of at most WINDOW bytes, are looked up."""
    return interleaved(text, PLACEHOLDER, lambda m: F.when(F.endswith(m, F.lit("]")), restored(m, vault, strategy)).otherwise(m))


DELTA = "struct<choices: array<struct<delta: struct<tool_calls: array<struct<index: bigint, id: string, function: struct<name: string, arguments: string>>>>, finish_reason: string>>>"


def tool_calls(replies: DataFrame, key: str = "request_id", rounds: bool = False) -> DataFrame:
    """key, index, id, name, arguments: deltas merged by index; ids and names overwrite, arguments append.

    Only what came before a finish of the calls; calls that never got a name are left out. A reply may finish calls several times: with ``rounds`` each
    round is merged by itself and round and ``end`` (the event that finishes it) are added, else only the first counts.
    """
    rows = replies.select(key, F.posexplode("events").alias("i", "event")).select(key, "i", F.posexplode(payloads(F.col("event"))).alias("d", "p")).select(key, "i", "d", F.from_json("p", DELTA).alias("e"))
    rows = rows.select(key, "i", "d", F.posexplode("e.choices").alias("c", "choice"))
    before = W.partitionBy(key).orderBy("i", "d", "c").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("done", F.coalesce((F.col("choice.finish_reason") == "tool_calls").cast("int"), F.lit(0)))
    rows = rows.withColumn("round", F.coalesce(F.sum("done").over(before), F.lit(0)))
    # the rows of a round, with the event that ends it, if any does
    rows = rows.withColumn("end", F.max(F.when(F.col("done") == 1, F.col("i"))).over(W.partitionBy(key, "round"))).where("end is not null")
    parts = (rows if rounds else rows.where("round = 0")).select(key, "i", "d", "c", "round", "end", F.posexplode("choice.delta.tool_calls").alias("k", "t"))
    parts = parts.select(key, "round", "end", F.struct("i", "d", "c", "k").alias("at"), F.coalesce("t.index", F.lit(0)).alias("index"), F.col("t.id").alias("id"), F.col("t.function.name").alias("name"), F.col("t.function.arguments").alias("arguments"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("arguments").isNotNull(), F.struct("at", "arguments")))), lambda a: a["arguments"]), "")
    merged = parts.groupBy(key, *["round", "end"] * rounds, "index").agg(last("id"), last("name"), joined.alias("arguments")).where("name is not null")
    return merged.withColumn("id", F.coalesce("id", F.lit(""))).withColumn("arguments", F.when(F.col("arguments") == "", "{}").otherwise(F.col("arguments")))


def gated(replies: DataFrame, gate: ToolGate, key: str = "request_id") -> DataFrame:
    """key, events, denied: events up to the first that finishes calls which the gate denies, then the event that ends the stream.

    What comes after is dropped, and so is the rest that no blank line ended. Replies without denied calls keep all events, the rest among them if it holds anything.
    """
    calls = tool_calls(replies, key, rounds=True).withColumn("d", gate.decision(F.col("name"), F.col("arguments"))).where("d.decision = 'deny'")
    by_round = calls.groupBy(key, "end").agg(F.array_sort(F.collect_list(F.struct("round", "index", "d.reason"))).alias("r"))
    first = by_round.groupBy(key).agg(F.min("end").alias("_end"), F.min_by("r", "end").alias("r"))
    rows = replies.join(first, key, "left")
    whole = F.concat("events", F.when(F.coalesce("rest", F.lit("")) != "", F.array("rest")).otherwise(F.array().cast("array<string>")))
    cut = F.concat(F.slice("events", F.lit(1), F.col("_end")), F.array(deny_event(F.transform("r", lambda x: x["reason"]))))
    return rows.select(key, F.when(F.col("_end").isNull(), whole).otherwise(cut).alias("events"), F.col("_end").isNotNull().alias("denied"))


def denied(calls: DataFrame, gate: ToolGate, key: str = "request_id") -> DataFrame:
    """key, reasons: of replies with any denied call, in the order of their index. Sanitizing counts as allowed here."""
    rows = calls.withColumn("d", gate.decision(F.col("name"), F.col("arguments"))).where("d.decision = 'deny'")
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("index", "d.reason"))), lambda r: r["reason"])
    return rows.groupBy(key).agg(reasons.alias("reasons"))


def deny_event(reasons: Column, kind: str = "tool_call_denied", message: str = "the tool gate denied one or more tool calls") -> Column:
    """The event that ends a stream whose calls were denied."""
    body = F.to_json(F.struct(F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"), reasons.alias("reasons")).alias("error")))
    return F.concat(F.lit("data: "), body, F.lit("\n\ndata: [DONE]\n\n"))


def spend(used: DataFrame, api_key: Column, key: str = "request_id") -> DataFrame:
    """One ledger row a reply whose usage was seen."""
    return used.select(key, api_key.alias("api_key"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), "model")


