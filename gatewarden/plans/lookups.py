"""Queries of lookups: policy metadata, routes, failover, client tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.functions import match
from gatewarden.operators import lookups
from gatewarden.plans.registry import MODELS, PROMPTS, pick, prompts, q, query, sql_list, table
from gatewarden.plans.text import verdict_sql

#: id, category, severity, pattern, regex, placeholder, compliance
POLICY = (
    ("PI-001", "prompt_injection", "high", "ignore previous instructions", False, None, ""),
    ("PI-003", "prompt_injection", "high", "jailbreak", False, None, ""),
    ("SEC-009", "secrets", "low", "Password", False, None, ""),
    ("SEC-010", "secrets", "medium", "password", False, None, "SOC2"),
    ("OFF-001", "off_topic", "low", "bitcoin", False, None, ""),
    ("PII-001", "pii", "medium", r"\b\d{3}-\d{2}-\d{4}\b", True, "SSN", "HIPAA,PCI-DSS"),
    ("PII-002", "pii", "high", r"[a-z]+@[a-z]+", True, "EMAIL", "GDPR,HIPAA"),
)


def policy(spark):
    rows = [(i, *p) for i, p in enumerate(POLICY)]
    df = spark.createDataFrame(rows, "ord int, rule_id string, category string, severity string, pattern string, regex boolean, placeholder string, compliance string")
    return df


POLICY_SQL = "(VALUES " + ", ".join("(" + ", ".join([str(i), q(a), q(b), q(c), q(d), str(e).lower(), q(f) if f else "NULL", q(g)]) + ")" for i, (a, b, c, d, e, f, g) in enumerate(POLICY)) + ") p(ord, rule_id, category, severity, pattern, regex, placeholder, compliance)"
META = "struct_pack(rule_id := rule_id, category := category, severity := severity, compliance := compliance)"


@query("policy_enrichment", f"""
WITH d AS (SELECT doc_id, CASE level WHEN 'block' THEN 'flag' ELSE level END AS level, CASE level WHEN 'block' THEN 'shadow_block:' || rule ELSE rule END AS rule FROM ({verdict_sql(PROMPTS, False, 'doc_id')}) v),
lit AS (SELECT lower(pattern) AS k, arg_max({META}, ord) AS m FROM {POLICY_SQL} WHERE NOT regex GROUP BY 1),
pl AS (SELECT placeholder AS k, arg_max({META}, ord) AS m FROM {POLICY_SQL} WHERE placeholder IS NOT NULL GROUP BY 1)
SELECT doc_id, level, rule, coalesce(lit.m, pl.m).rule_id AS rule_id, coalesce(lit.m, pl.m).category AS category, coalesce(lit.m, pl.m).severity AS severity, coalesce(lit.m, pl.m).compliance AS compliance
FROM d LEFT JOIN lit ON lower(regexp_replace(rule, '^shadow_block:', '')) = lit.k LEFT JOIN pl ON regexp_replace(rule, '^shadow_block:', '') = pl.k""")
def policy_enrichment(spark, folder):
    from gatewarden.rules import RuleSet, default_keywords

    found = match.classified(prompts(spark, folder), "text", RuleSet(default_keywords()), shadow=True).select("doc_id", "verdict.level", "verdict.rule")
    return lookups.enriched(found, policy(spark))


ROUTES = ((0, "fast-*", "beta", ("alpha",)), (1, "premium", "alpha", ("beta", "gamma")), (2, "fast-1", "gamma", ()))


def routes(spark):
    return spark.createDataFrame([(o, p, b, list(f)) for o, p, b, f in ROUTES], "ord int, pattern string, backend string, fallback array<string>")


ROUTED = f"""(SELECT conv_id, model, coalesce(r.backend, 'alpha') AS backend, list_concat([coalesce(r.backend, 'alpha')], coalesce(r.fallback, [])) AS chain
FROM (SELECT DISTINCT conv_id, {sql_list(MODELS)}[1 + conv_id % {len(MODELS)}] AS model FROM conversations) c
LEFT JOIN (VALUES {', '.join(f"({o}, {q(p)}, {q(b)}, CAST({sql_list(f)} AS VARCHAR[]))" for o, p, b, f in ROUTES)}) r(ord, pattern, backend, fallback)
ON r.ord = (SELECT min(s.ord) FROM (VALUES {', '.join(f"({o}, {q(p)})" for o, p, _, _ in ROUTES)}) s(ord, pattern) WHERE CASE WHEN ends_with(s.pattern, '*') THEN starts_with(c.model, s.pattern[:-2]) ELSE c.model = s.pattern END))"""


def routed(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id").distinct().withColumn("model", pick(MODELS, F.col("conv_id") % len(MODELS)))
    return lookups.routed(rows, routes(spark), "alpha")


@query("route_models", f"SELECT conv_id, model, backend, array_to_string(chain, '>') AS chain FROM {ROUTED}")
def route_models(spark, folder):
    return routed(spark, folder).withColumn("chain", F.array_join("chain", ">"))


STATUS = (200, 503, None, 429, 500)


def status_sql(backend: str) -> str:
    return f"[200, 503, NULL, 429, 500][1 + (conv_id + len({backend}) + ascii({backend})) % 5]"


@query("failover_outcome", f"""
WITH t AS (SELECT conv_id, chain, unnest(range(1, len(chain) + 1)) AS i FROM {ROUTED}), s AS (SELECT conv_id, i, chain[i] AS b, {status_sql('chain[i]')} AS st, len(chain) AS n FROM t)
SELECT conv_id, CASE WHEN bool_or(coalesce(st < 500, false)) THEN 'served' WHEN bool_or(coalesce(st >= 500, false)) THEN 'server_error' ELSE 'all_backends_failed' END AS outcome,
coalesce(arg_min(b, i) FILTER (WHERE st < 500), arg_max(b, i) FILTER (WHERE st >= 500)) AS backend,
coalesce(arg_min(st, i) FILTER (WHERE st < 500), arg_max(st, i) FILTER (WHERE st >= 500), 0) AS status,
CAST(coalesce(min(i) FILTER (WHERE st < 500), max(n)) AS INTEGER) AS attempts FROM s GROUP BY conv_id""")
def failover_outcome(spark, folder):
    def status(b):
        return F.try_element_at(F.array(*[F.lit(x).cast("int") for x in STATUS]), ((F.col("conv_id") + F.length(b) + F.ascii(b)) % 5 + 1).cast("int"))

    names = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    by = F.map_from_arrays(names, F.transform(names, status))
    rows = routed(spark, folder).select("conv_id", lookups.failover(F.col("chain"), by).alias("o"))
    return rows.select("conv_id", "o.outcome", "o.backend", F.coalesce("o.status", F.lit(0)).alias("status"), "o.attempts")


@query("unknown_backends", f"SELECT DISTINCT b AS backend FROM (SELECT unnest(['m' || conv_id % 7, 'm' || turn % 5, 'alpha']) AS b FROM conversations) x WHERE b NOT IN (SELECT 'm' || turn % 4 FROM conversations) AND b <> 'alpha'")
def unknown_backends(spark, folder):
    """Routes and fallbacks named by turns of conversations, against the backends that turns know."""
    rows = table(spark, folder, "conversations")
    name = lambda c, n: F.concat(F.lit("m"), (F.col(c) % n).cast("string"))
    named = rows.select(name("conv_id", 7).alias("backend"), F.array(name("turn", 5), F.lit("alpha")).alias("fallback"))
    there = rows.select(name("turn", 4).alias("backend")).distinct().unionByName(spark.range(1).select(F.lit("alpha").alias("backend")))
    return lookups.unknown_backends(named, there)


def tokens_of(spark, folder):
    """Tokens made from user ids: 24 hexadecimal digits; some revoked, expired or with another's hash."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("id")).distinct()
    raw = F.concat(F.lit("ng_t_"), F.left(F.md5(F.concat(F.lit("t"), F.col("id").cast("string"))), F.lit(24)))
    hashed = F.sha2(F.when(F.col("id") % 11 == 0, F.lit("other")).otherwise(raw), 256)
    expires = F.when(F.col("id") % 5 == 0, "2024-01-05 00:00:00").when(F.col("id") % 5 == 1, "not a time").when(F.col("id") % 5 == 2, "2030-01-01 00:00:00")
    return users.where("id % 13 <> 0").select("id", F.left(raw, F.lit(10)).alias("prefix"), hashed.alias("hash"), expires.alias("expires_at"), F.when(F.col("id") % 7 == 0, "2024-01-02 00:00:00").alias("revoked_at"), (F.col("id") % 9).alias("user_id"))


RAW = "'ng_t_' || left(md5('t' || {0}), 24)"
TOKENS = f"""(SELECT id, left({RAW.format('id')}, 10) AS prefix, sha256(CASE WHEN id % 11 = 0 THEN 'other' ELSE {RAW.format('id')} END) AS hash,
CASE id % 5 WHEN 0 THEN '2024-01-05 00:00:00' WHEN 1 THEN 'not a time' WHEN 2 THEN '2030-01-01 00:00:00' END AS expires_at, CASE WHEN id % 7 = 0 THEN '2024-01-02 00:00:00' END AS revoked_at, id % 9 AS user_id
FROM (SELECT DISTINCT user_id AS id FROM events) u WHERE id % 13 <> 0)"""
SHOWN = f"CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ng_bad' ELSE {RAW.format('user_id')} END"


def shown(spark, folder):
    raw = F.concat(F.lit("ng_t_"), F.left(F.md5(F.concat(F.lit("t"), F.col("user_id").cast("string"))), F.lit(24)))
    return table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, "ng_bad").when(F.col("event_id") % 4 > 1, raw).alias("token"))


@query("token_parts", f"SELECT event_id, coalesce(regexp_matches(token, '{lookups.TOKEN}'), false) AS valid, CASE WHEN regexp_matches(token, '{lookups.TOKEN}') THEN left(token, 10) END AS prefix, CASE WHEN regexp_matches(token, '{lookups.TOKEN}') THEN sha256(token) END AS hash FROM (SELECT event_id, {SHOWN} AS token FROM events) t")
def token_parts(spark, folder):
    return shown(spark, folder).select("event_id", lookups.token_parts(F.col("token")).alias("t")).select("event_id", "t.valid", "t.prefix", "t.hash")


@query("token_verification", f"""SELECT event_id, result, CASE WHEN result = 'ok' THEN 'token:' || id END AS budget_key FROM (SELECT event_id, k.id,
CASE WHEN token IS NULL THEN 'missing' WHEN NOT regexp_matches(token, '{lookups.TOKEN}') THEN 'malformed' WHEN k.id IS NULL THEN 'unknown' WHEN k.hash <> sha256(token) THEN 'mismatch'
WHEN k.revoked_at IS NOT NULL THEN 'revoked' WHEN coalesce(TRY_CAST(k.expires_at AS TIMESTAMP) <= TIMESTAMP '2024-01-15 00:00:00', false) THEN 'expired' ELSE 'ok' END AS result
FROM (SELECT event_id, {SHOWN} AS token FROM events) t LEFT JOIN {TOKENS} k ON regexp_matches(token, '{lookups.TOKEN}') AND k.prefix = left(token, 10)) r""")
def token_verification(spark, folder):
    return lookups.verified(shown(spark, folder), tokens_of(spark, folder), F.expr("TIMESTAMP '2024-01-15 00:00:00'")).select("event_id", "result", "budget_key")


@query("tokens_revoked", f"SELECT id, CASE WHEN user_id = 3 THEN coalesce(revoked_at, '2024-02-01 00:00:00') ELSE revoked_at END AS revoked_at FROM {TOKENS}")
def tokens_revoked(spark, folder):
    return lookups.revoked(tokens_of(spark, folder), F.col("user_id") == 3, F.lit("2024-02-01 00:00:00")).select("id", "revoked_at")


@query("tokens_of_user", f"SELECT id, prefix, row_number() OVER (ORDER BY id DESC) AS place FROM {TOKENS} WHERE user_id = 4")
def tokens_of_user(spark, folder):
    from pyspark.sql import Window as W

    return tokens_of(spark, folder).where("user_id = 4").select("id", "prefix", F.row_number().over(W.orderBy(F.desc("id"))).cast("long").alias("place"))


@query("tokens_live", f"SELECT count(*) FILTER (WHERE revoked_at IS NULL) AS live, count(*) = 0 AS needs_bootstrap FROM {TOKENS}")
def tokens_live(spark, folder):
    return tokens_of(spark, folder).agg(F.count_if(F.col("revoked_at").isNull()).alias("live"), (F.count("*") == 0).alias("needs_bootstrap"))


@query("request_ids", "SELECT event_id, lower(lpad(printf('%x', epoch_us(ts) * 1000), 32, '0') || lpad(printf('%x', event_id), 16, '0')) AS request_id FROM events")
def request_ids(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", lookups.request_id(F.unix_micros(F.col("ts").cast("timestamp")) * 1000, F.col("event_id")).alias("request_id"))


@query("prompt_hashes", f"SELECT doc_id, sha256(text) AS prompt_hash FROM {PROMPTS}")
def prompt_hashes(spark, folder):
    return prompts(spark, folder).select("doc_id", F.sha2("text", 256).alias("prompt_hash"))


LISTS = "(SELECT 'b' || user_id % 6 AS backend, CASE WHEN user_id % 6 < 4 THEN event_type || '-' || event_id % 11 END AS model, CASE WHEN user_id % 6 >= 4 THEN 'refused ' || user_id % 6 END AS error FROM events)"


def lists_of(spark, folder):
    """Model lists of six backends; two of them cannot be reached."""
    b = F.col("user_id") % 6
    rows = table(spark, folder, "events").select(F.concat(F.lit("b"), b.cast("string")).alias("backend"), F.when(b < 4, F.concat("event_type", F.lit("-"), (F.col("event_id") % 11).cast("string"))).alias("model"), F.when(b >= 4, F.concat(F.lit("refused "), b.cast("string"))).alias("error"))
    return rows.distinct()


@query("model_lists", f"SELECT DISTINCT model AS id, backend AS owned_by FROM {LISTS} l WHERE error IS NULL")
def model_lists(spark, folder):
    return lookups.merged_models(lists_of(spark, folder))


FAILED = "SELECT bool_and(e IS NOT NULL) AS failed, coalesce(string_agg(backend || ': ' || e, '; ' ORDER BY backend), '') AS errors FROM (SELECT backend, max(error) AS e FROM {0} l GROUP BY backend) b"


@query("model_lists_failed", FAILED.format(LISTS) + " UNION ALL " + FAILED.format(f"(SELECT * FROM {LISTS} m WHERE error IS NOT NULL)"))
def model_lists_failed(spark, folder):
    """All backends, and only those that cannot be reached."""
    lists = lists_of(spark, folder)
    return lookups.listing_failed(lists).unionByName(lookups.listing_failed(lists.where("error is not null")))


@query("token_line_ends", f"SELECT event_id, coalesce(regexp_matches(token, '{lookups.TOKEN}'), false) AS valid FROM (SELECT event_id, {SHOWN} || CASE event_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN '' ELSE chr(13) || chr(10) END AS token FROM events) t")
def token_line_ends(spark, folder):
    """A line end after a token makes it malformed."""
    end = F.when(F.col("event_id") % 3 == 0, "\n").when(F.col("event_id") % 3 == 1, "").otherwise("\r\n")
    return shown(spark, folder).select("event_id", lookups.token_parts(F.concat("token", end))["valid"].alias("valid"))


USERS = "(SELECT user_id AS id, 'user' || user_id AS username, min(ts) AS created_at, max(ts) AS last_login_at FROM events GROUP BY user_id)"


def users_of(spark, folder):
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_login_at")).withColumn("username", F.concat(F.lit("user"), F.col("id").cast("string")))


@query("users_listed", f"SELECT id, username, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM {USERS} u")
def users_listed(spark, folder):
    """Newest first."""
    return lookups.listed(users_of(spark, folder), "created_at", "id").select("id", "username", "place")


@query("user_by_id_or_name", f"SELECT e.event_id, coalesce(a.username, b.username) AS username FROM events e LEFT JOIN {USERS} a ON e.event_id % 2 = 0 AND a.id = e.event_id % 90 LEFT JOIN {USERS} b ON e.event_id % 2 = 1 AND b.username = 'user' || e.event_id % 90")
def user_by_id_or_name(spark, folder):
    """Even events ask by id, odd ones by name; nobody found is null."""
    e = F.col("event_id")
    asked = table(spark, folder, "events").select("event_id", F.when(e % 2 == 0, e % 90).alias("by_id"), F.when(e % 2 == 1, F.concat(F.lit("user"), (e % 90).cast("string"))).alias("by_name"))
    return lookups.found_users(asked, users_of(spark, folder), "by_id", "by_name").select("event_id", "username")


@query("sessions_listed", "SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS place FROM (SELECT user_id, CAST(date_part('day', ts) AS BIGINT) AS day, max(ts) AS seen FROM events GROUP BY ALL) s")
def sessions_listed(spark, folder):
    """A user's sessions, the one seen last first; a session is a user's day here."""
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = rows.groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.max("ts").alias("seen"))
    return lookups.listed(sessions, "seen", "day", "user_id").select("user_id", "day", "place")


@query("cache_outcomes")
def cache_outcomes(spark, folder):
    """Lookups of sixteen caches of 20 entries that live two hours."""
    rows = table(spark, folder, "events").select("event_id", (F.col("event_id") % 16).alias("cache"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return lookups.cache_outcomes(rows, "cache", "key", "at", "event_id", 20, 7200.0).select("event_id", "hit")
