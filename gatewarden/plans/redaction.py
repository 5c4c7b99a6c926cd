"""Queries of redaction: placeholders, spans, vaults, restoring, output masks, spotlighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions import match, redact, spotlight
from gatewarden.plans.registry import PROMPTS, TURNS, chats, flat_messages, prompts, q, query, table
from gatewarden.rules import ENTITY_PATTERNS, INDEXED, LLM_GUARD, OUTPUT_PHRASES, EntityRule, default_entities

RULES = default_entities()
SOME = tuple(r for r in RULES if r.entity in ("EMAIL", "CARD", "SSN", "TOKEN"))


def bare_sql(x: str, rules=RULES) -> str:
    for r in rules:
        x = f"regexp_replace({x}, {q(r.pattern)}, '[{r.entity}]', 'g')"
    return x


def numbered_sql(x: str, r: EntityRule, style: str) -> str:
    head, tail = redact.affixes(r.entity, style)
    p, m = f"string_split_regex({x}, {q(r.pattern)})", f"regexp_extract_all({x}, {q(r.pattern)})"
    values = f"list_filter(list_reverse({m}), lambda y, j: list_position(list_reverse({m}), y) = j)"
    one = f"({p})[i] || CASE WHEN i <= len({m}) THEN {q(head)} || list_position({values}, ({m})[i]) || {q(tail)} ELSE '' END"
    return f"CASE WHEN regexp_matches({x}, {q(r.pattern)}) THEN array_to_string(list_transform(range(1, len({p}) + 1), lambda i: {one}), '') ELSE {x} END"


def staged_sql(source: str, column: str, rules, style: str, keys: str) -> str:
    for r in rules:
        source = f"(SELECT {keys}, {numbered_sql(column, r, style)} AS {column} FROM {source} s)"
    return source


@query("redact_bare", f"SELECT doc_id, {bare_sql('text')} AS text FROM {PROMPTS}")
def redact_bare(spark, folder):
    return redact.with_redacted(prompts(spark, folder).select("doc_id", "text"), "text", RULES)


@query("redact_some", f"SELECT doc_id, {bare_sql('text', [r for r in RULES if r.entity in ('EMAIL', 'SSN')])} AS text FROM {PROMPTS}")
def redact_some(spark, folder):
    return redact.with_redacted(prompts(spark, folder).select("doc_id", "text"), "text", RULES, entities={"EMAIL", "SSN"})


@query("redact_indexed", f"SELECT * FROM {staged_sql(PROMPTS, 'text', SOME, INDEXED, 'doc_id')}")
def redact_indexed(spark, folder):
    return redact.with_redacted(prompts(spark, folder).select("doc_id", "text"), "text", SOME, INDEXED)


@query("redact_llm_guard", f"SELECT * FROM {staged_sql(PROMPTS, 'text', SOME, LLM_GUARD, 'doc_id')}")
def redact_llm_guard(spark, folder):
    return redact.with_redacted(prompts(spark, folder).select("doc_id", "text"), "text", SOME, LLM_GUARD)


@query("redact_pages", f"SELECT page_id, {bare_sql('html')} AS html FROM pages")
def redact_pages(spark, folder):
    return redact.with_redacted(table(spark, folder, "pages").select("page_id", "html"), "html", RULES)


PARTED = "(conv_id + turn) % 4 = 0"


def flat_sql(change) -> str:
    return f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, CASE WHEN NOT {PARTED} THEN {change} END AS content, CASE WHEN {PARTED} THEN {change} END AS part_text"""


@query("redact_messages", flat_sql(bare_sql("text")) + f", bool_or({bare_sql('text')} <> text) OVER (PARTITION BY conv_id) AS changed FROM {TURNS}")
def redact_messages(spark, folder):
    return flat_messages(redact.with_redacted_messages(chats(spark, folder), "messages", RULES, changed="changed"), "conv_id", "changed")


@query("redact_messages_indexed", flat_sql("t") + f" FROM (SELECT conv_id, turn, role, text AS t FROM {staged_sql(TURNS, 'text', SOME[:2], INDEXED, 'conv_id, turn, role')}) z")
def redact_messages_indexed(spark, folder):
    return flat_messages(redact.with_redacted_messages(chats(spark, folder), "messages", SOME[:2], INDEXED), "conv_id")


def spans_sql(rules) -> str:
    parts = []
    for k, r in enumerate(rules):
        p, m = f"string_split_regex(text, {q(r.pattern)})", f"regexp_extract_all(text, {q(r.pattern)})"
        parts.append(f"SELECT doc_id, {q(r.entity)} AS entity, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS BIGINT) AS start_byte, m[i] AS match_text FROM (SELECT doc_id, {p} AS p, {m} AS m, unnest(range(1, len({m}) + 1)) AS i FROM {PROMPTS}) s{k}")
    return "SELECT doc_id, entity, start_byte, start_byte + strlen(match_text) AS end_byte, match_text FROM (" + " UNION ALL ".join(parts) + ") u"


@query("find_spans", spans_sql(RULES))
def find_spans(spark, folder):
    found = prompts(spark, folder).select("doc_id", F.explode(redact.spans(F.col("text"), RULES)).alias("s"))
    return found.select("doc_id", "s.entity", F.col("s.start").cast("long").alias("start_byte"), F.col("s.end").cast("long").alias("end_byte"), F.col("s.text").alias("match_text"))


def vaulted(spark, folder):
    rows = chats(spark, folder).select("conv_id", F.transform("messages", lambda m: F.coalesce(m["content"], F.try_element_at(m["parts"], F.lit(1))["text"])).alias("texts"))
    return redact.with_vault(rows, "texts", (SOME[0],))


EMAIL = ENTITY_PATTERNS[0][1]
VAULT = f"""(SELECT conv_id, list_filter(m, lambda y, j: list_position(m, y) = j) AS known FROM
(SELECT conv_id, flatten(list(list_reverse(regexp_extract_all(text, {q(EMAIL)})) ORDER BY turn)) AS m FROM {TURNS} GROUP BY conv_id) a)"""


@query("vault_entries", f"SELECT conv_id, '[EMAIL_' || i || ']' AS placeholder, known[i] AS original FROM (SELECT conv_id, known, unnest(range(1, len(known) + 1)) AS i FROM {VAULT} v) w")
def vault_entries(spark, folder):
    return vaulted(spark, folder).select("conv_id", F.explode("vault").alias("v")).select("conv_id", "v.placeholder", "v.original")


_P, _M = f"string_split_regex(text, {q(EMAIL)})", f"regexp_extract_all(text, {q(EMAIL)})"
VAULTED = f"""(SELECT conv_id, turn, text AS original, array_to_string(list_transform(range(1, len({_P}) + 1), lambda i: ({_P})[i] || CASE WHEN i <= len({_M}) THEN '[EMAIL_' || list_position(known, ({_M})[i]) || ']' ELSE '' END), '') AS text FROM {TURNS} t JOIN {VAULT} k USING (conv_id))"""


@query("vault_texts", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text FROM {VAULTED}")
def vault_texts(spark, folder):
    return vaulted(spark, folder).select("conv_id", F.posexplode("texts").alias("place", "text")).select("conv_id", F.col("place").cast("long").alias("place"), "text")


@query("restore_exact", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, original AS text FROM {VAULTED}")
def restore_exact(spark, folder):
    rows = vaulted(spark, folder).select("conv_id", F.posexplode("texts").alias("place", "text"), "vault")
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), redact.restored(F.col("text"), F.col("vault")).alias("text"))


@query("restore_ignoring_case", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, original AS text FROM {VAULTED}")
def restore_ignoring_case(spark, folder):
    rows = vaulted(spark, folder).select("conv_id", F.posexplode("texts").alias("place", "text"), "vault")
    small = F.regexp_replace("text", r"\[EMAIL_(\d+)\]", "[email_$1]")
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), redact.restored(small, F.col("vault"), "case_insensitive").alias("text"))


ACTIONS = redact.partition_by_action(RULES, {"SSN": "reject", "CARD": "log", "AWS_ACCESS_KEY_ID": "reject"})
PATTERN = dict(ENTITY_PATTERNS)


def _any(entities) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {q(r.pattern)})" for r in RULES if r.entity in entities) + ")"


@query("pii_stage", f"""SELECT doc_id, CASE WHEN {_any(ACTIONS['reject'])} THEN 'block' WHEN masked <> text THEN 'mask' ELSE 'clean' END AS outcome,
CASE WHEN {_any(ACTIONS['reject'])} THEN text ELSE masked END AS text, NOT {_any(ACTIONS['reject'])} AND regexp_matches(masked, {q(PATTERN['CARD'])}) AS logged
FROM (SELECT doc_id, text, {bare_sql('text', [r for r in RULES if r.entity in ACTIONS['mask']])} AS masked FROM {PROMPTS}) x""")
def pii_stage(spark, folder):
    return pii_staged(prompts(spark, folder).select("doc_id", "text"), "text", RULES, ACTIONS)


def pii_staged(df, text, rules, actions):
    """Rejecting comes first and ends the stage; then masking; then what is only logged."""
    reject = match.contains_entity(F.col(text), rules, set(actions["reject"]))
    found = df.withColumn("_masked", redact.redacted(F.col(text), rules, set(actions["mask"]))).withColumn("_reject", reject)
    outcome = F.when(F.col("_reject"), "block").when(F.col("_masked") != F.col(text), "mask").otherwise("clean")
    found = found.withColumn("outcome", outcome).withColumn("logged", ~F.col("_reject") & match.contains_entity(F.col("_masked"), rules, set(actions["log"])))
    return found.withColumn(text, F.when(F.col("_reject"), F.col(text)).otherwise(F.col("_masked"))).drop("_masked", "_reject")


def mask_sql(x: str) -> str:
    stars = "s"
    for p in OUTPUT_PHRASES:
        stars = f"regexp_replace({stars}, {q('(?i)' + p)}, '{'*' * len(p)}', 'g')"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(\\[[^\\[\\]]*|\\]?[^\\[\\]]+|\\])'), lambda s: CASE WHEN starts_with(s, '[') THEN s ELSE {stars} END), '')"


@query("mask_output", f"SELECT doc_id, {mask_sql('text')} AS text FROM {PROMPTS}")
def mask_output(spark, folder):
    return prompts(spark, folder).select("doc_id", redact.masked_output(F.col("text")).alias("text"))


@query("spotlight_delimiting", f"SELECT doc_id, '<<UNTRUSTED>>' || chr(10) || text || chr(10) || '<</UNTRUSTED>>' AS text FROM {PROMPTS}")
def spotlight_delimiting(spark, folder):
    return prompts(spark, folder).select("doc_id", spotlight.spotlighted(F.col("text"), spotlight.Spotlight(spotlight.DELIMIT)).alias("text"))


@query("spotlight_marking", f"SELECT doc_id, translate(text, ' ' || chr(9), '^^') AS text FROM {PROMPTS}")
def spotlight_marking(spark, folder):
    return prompts(spark, folder).select("doc_id", spotlight.spotlighted(F.col("text")).alias("text"))


@query("spotlight_encoding", f"SELECT doc_id, '<<B64>>' || to_base64(encode(text)) || '<</B64>>' AS text FROM {PROMPTS}")
def spotlight_encoding(spark, folder):
    return prompts(spark, folder).select("doc_id", spotlight.spotlighted(F.col("text"), spotlight.Spotlight(spotlight.ENCODE)).alias("text"))


HOW = spotlight.Spotlight(roles=("assistant",))
RIDER = q(HOW.told)


@query("spotlight_messages", f"""
WITH m AS (SELECT conv_id, turn, role, NOT {PARTED} AS plain, CASE role WHEN 'assistant' THEN translate(text, ' ' || chr(9), '^^') ELSE text END AS text FROM {TURNS}),
c AS (SELECT conv_id, bool_or(role = 'assistant') AS any_marked, min(turn) FILTER (WHERE role = 'system') AS sys FROM m GROUP BY conv_id),
r AS (SELECT m.conv_id, turn, role, CASE WHEN plain THEN text || CASE WHEN any_marked AND turn = sys THEN chr(10) || chr(10) || {RIDER} ELSE '' END END AS content, CASE WHEN NOT plain THEN text END AS part_text,
  CASE WHEN plain THEN 0 ELSE 2 + CASE WHEN any_marked AND turn = sys THEN 1 ELSE 0 END END AS n_parts FROM m JOIN c USING (conv_id)
  UNION ALL SELECT conv_id, -1, 'system', {RIDER}, NULL, 0 FROM c WHERE any_marked AND sys IS NULL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, content, part_text, CAST(n_parts AS INTEGER) AS n_parts FROM r""")
def spotlight_messages(spark, folder):
    rows = chats(spark, folder).withColumn("messages", spotlight.spotlighted_messages(F.col("messages"), HOW))
    rows = rows.select("conv_id", F.posexplode("messages").alias("place", "m"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content", F.try_element_at("m.parts", F.lit(1))["text"].alias("part_text"), F.greatest(F.coalesce(F.size("m.parts"), F.lit(0)), F.lit(0)).alias("n_parts"))


