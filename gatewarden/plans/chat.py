"""Queries of whole flows: requests through the engine and back, and the shapes of the two chat interfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions import jsonshape
from gatewarden.plans.engine import Engine
from gatewarden.plans.redaction import bare_sql
from gatewarden.plans.registry import MODELS, TURNS, chats, flat_messages, pick, q, query, sql_list, table
from gatewarden.plans.text import TEXT, message_text, verdict_sql
from gatewarden.plans.tools import ARGS, NAMES
from gatewarden.rules import ENTITY_PATTERNS, EntityRule
from gatewarden.sources.config import config

CONFIG = """
[backends.alpha]
provider = "a"
endpoint = "http://a"
[backends.beta]
provider = "b"
endpoint = "http://b"
[routing]
default = "alpha"
[[routing.rules]]
model = "fast-*"
backend = "beta"
fallback = ["alpha"]
[input]
enabled = true
[input.pii]
action = "mask"
[input.pii.entities]
SSN = "reject"
"""
SSN = q(dict(ENTITY_PATTERNS)["SSN"])
MASK = [EntityRule(e, p) for e, p in ENTITY_PATTERNS if e != "SSN"]
OUTCOME = f"""(SELECT v.conv_id, level, rule, CASE WHEN level = 'block' THEN 'blocked' WHEN regexp_matches(text, {SSN}) THEN 'rejected' ELSE 'passed' END AS outcome FROM ({verdict_sql(f"(SELECT conv_id, coalesce({TEXT}, '') AS text FROM {TURNS} GROUP BY conv_id)", False, 'conv_id')}) v
JOIN (SELECT conv_id, coalesce({TEXT}, '') AS text FROM {TURNS} GROUP BY conv_id) t USING (conv_id))"""


@query("chat_flow_verdicts", f"SELECT conv_id, level, rule, outcome, CASE WHEN starts_with({sql_list(MODELS)}[1 + conv_id % {len(MODELS)}], 'fast-') THEN 'beta' ELSE 'alpha' END AS backend FROM {OUTCOME} o")
def chat_flow_verdicts(spark, folder):
    engine = Engine.build(config(CONFIG))
    rows = engine.routed(engine.guarded(chats(spark, folder), message_text))
    return rows.select("conv_id", "level", "rule", "outcome", "backend")


PARTED = "(conv_id + turn) % 4 = 0"
CHANGED = f"CASE WHEN outcome = 'passed' THEN {bare_sql('text', MASK)} ELSE text END"


@query("chat_flow_messages", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, CASE WHEN NOT {PARTED} THEN {CHANGED} END AS content, CASE WHEN {PARTED} THEN {CHANGED} END AS part_text FROM {TURNS} t JOIN {OUTCOME} o USING (conv_id)")
def chat_flow_messages(spark, folder):
    return flat_messages(Engine.build(config(CONFIG)).guarded(chats(spark, folder), message_text), "conv_id")


@query("chat_flow_reversible", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text FROM {TURNS}")
def chat_flow_reversible(spark, folder):
    """With placeholders that can be undone, restoring what was sent gives the texts back."""
    from gatewarden.functions.redact import restored

    engine = Engine.build(config(CONFIG.replace("enabled = true", "enabled = false").replace('SSN = "reject"', 'SSN = "mask"').replace('action = "mask"', 'action = "mask"\nreversible = true')))
    rows = engine.guarded(chats(spark, folder), message_text)
    rows = rows.select("conv_id", F.posexplode("messages").alias("place", "m"), "vault")
    text = F.coalesce("m.content", F.try_element_at("m.parts", F.lit(1))["text"])
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), restored(text, F.reverse("vault")).alias("text"))


@query("messages_to_chat", f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, content, CASE WHEN conv_id % 3 = 0 THEN CAST(100 + conv_id AS INTEGER) ELSE 1024 END AS max_tokens FROM (SELECT conv_id, turn, role, text AS content FROM {TURNS} WHERE role <> 'system'
UNION ALL SELECT conv_id, -1, 'system', 'Be brief.' FROM (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system') c WHERE conv_id % 2 = 0) x""")
def messages_to_chat(spark, folder):
    rows = chats(spark, folder).withColumn("messages", F.filter("messages", lambda m: m["role"] != "system")).where(F.size("messages") > 0)
    system = F.when(F.col("conv_id") % 2 == 0, F.lit("Be brief."))
    found = rows.select("conv_id", F.posexplode(jsonshape.to_chat_messages(system, F.col("messages"))).alias("place", "m"))
    return found.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content", jsonshape.max_tokens(F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") + 100)).alias("max_tokens"))


@query("chat_usage", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS input_tokens, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 100 END AS output_tokens FROM documents")
def chat_usage(spark, folder):
    """Usage of replies, as the interface of blocks names it; some replies lack one count or both."""
    d = F.col("doc_id")
    used = jsonshape.usage_of_blocks(F.when(d % 3 != 0, F.col("n_chars").cast("long")), F.when(d % 4 != 0, d % 100))
    return table(spark, folder, "documents").select("doc_id", used.alias("u")).select("doc_id", "u.*")


CALL = f"{sql_list(NAMES)}[1 + doc_id % {len(NAMES)}]"
ARG = f"{sql_list(ARGS)}[1 + doc_id % {len(ARGS)}]"


def _blocks(rows, content):
    d = F.col("doc_id")
    call = F.array(F.struct(F.lit("c1").alias("id"), pick(NAMES, d % len(NAMES)).alias("name"), pick(ARGS, d % len(ARGS)).alias("arguments")))
    denied = F.when(d % 5 == 0, F.array(F.struct(F.lit("x").alias("name"), F.lit("r").alias("reason"))))
    rows = rows.select("doc_id", F.when(d % 3 == 0, "").otherwise(content).alias("content"), F.when(d % 4 != 0, call).alias("calls"), denied.alias("denied"))
    rows = rows.select("doc_id", jsonshape.stop_reason(F.col("calls")).alias("stop_reason"), F.posexplode(jsonshape.to_blocks(F.col("content"), F.col("calls"), F.col("denied"))).alias("place", "b"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "b.type", "b.text", "b.name", "b.input", "stop_reason")


@query("chat_to_messages", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(text, '') END AS content, doc_id % 4 <> 0 AS called FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, type, text, name, input, stop_reason FROM (
SELECT doc_id, 0 AS k, 'text' AS type, content AS text, NULL AS name, NULL AS input, CASE WHEN called THEN 'tool_use' ELSE 'end_turn' END AS stop_reason FROM d WHERE content <> '' OR NOT called AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, 1, 'tool_use', NULL, {CALL}, CASE WHEN json_valid({ARG}) THEN {ARG} ELSE '{{}}' END, 'tool_use' FROM d WHERE called
UNION ALL SELECT doc_id, 2, 'denied_tools', '[{{"name":"x","reason":"r"}}]', NULL, NULL, CASE WHEN called THEN 'tool_use' ELSE 'end_turn' END FROM d WHERE doc_id % 5 = 0) x""")
def chat_to_messages(spark, folder):
    return _blocks(table(spark, folder, "documents"), F.col("text"))
