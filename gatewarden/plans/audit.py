"""Queries of audit logs, on entries derived from events and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.operators import audit
from gatewarden.plans.registry import PROMPTS, pick, prompts, query, shared, sql_list, table
from gatewarden.plans.text import verdict_sql

VERDICTS = ("allow", "allow", "allow", "block", "reload_ok", "reload_failed")


def entries(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("user_id").alias("api_key"), pick(VERDICTS, (F.col("event_id") * 7 + F.col("user_id")) % len(VERDICTS)).alias("verdict"), (F.col("event_id") * 7919 % 5003).alias("latency_us"), F.col("ts").cast("timestamp").alias("ts"))


ENTRIES = f"(SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, user_id AS api_key, {sql_list(VERDICTS)}[1 + (event_id * 7 + user_id) % {len(VERDICTS)}] AS verdict, event_id * 7919 % 5003 AS latency_us, ts FROM events)"


@query("audit_tail", f"SELECT event_id, verdict FROM (SELECT * FROM (SELECT * FROM {ENTRIES} ORDER BY timestamp DESC, event_id DESC LIMIT 100) t WHERE verdict = 'block' ORDER BY timestamp DESC, event_id DESC LIMIT 50) u")
def audit_tail(spark, folder):
    return audit.tail(entries(spark, folder), ["timestamp", "event_id"], 50, "block").select("event_id", "verdict")


@query("audit_tail_all", f"SELECT event_id, verdict FROM {ENTRIES} ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def audit_tail_all(spark, folder):
    return audit.tail(entries(spark, folder), ["timestamp", "event_id"]).select("event_id", "verdict")


ACTORS, ACTIONS = ("ann", "bob", "cyd"), ("edit", "token.create", "user.delete")


def console(spark, folder):
    rows = table(spark, folder, "events")
    edit = F.col("event_id") % 3 == 0
    base = [F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), pick(ACTORS, F.col("user_id") % 3).alias("actor"), pick(ACTIONS, F.col("event_id") % 3).alias("action")]
    name = F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"))
    return audit.union_shapes(rows.where(edit).select(*base, name.alias("file")), rows.where(~edit).select(*base, name.alias("target")))


CONSOLE = f"(SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, {sql_list(ACTORS)}[1 + user_id % 3] AS actor, {sql_list(ACTIONS)}[1 + event_id % 3] AS action, CASE WHEN event_id % 3 = 0 THEN 'f' || user_id % 5 END AS file, CASE WHEN event_id % 3 <> 0 THEN 'f' || user_id % 5 END AS target FROM events)"


@query("console_log", f"SELECT * FROM {CONSOLE}")
def console_log(spark, folder):
    return console(spark, folder)


@query("console_tail", f"SELECT event_id, actor, action FROM {CONSOLE} WHERE actor = 'bob' AND (target = 'f2' OR file = 'f2') ORDER BY timestamp DESC, event_id DESC LIMIT 40")
def console_tail(spark, folder):
    return audit.console_tail(console(spark, folder), ["timestamp", "event_id"], 40, actor="bob", target="f2").select("event_id", "actor", "action")


@query("console_tail_action", f"SELECT event_id, actor, action FROM {CONSOLE} WHERE actor = 'ann' AND action = 'edit' ORDER BY timestamp DESC, event_id DESC LIMIT 100")
def console_tail_action(spark, folder):
    return audit.console_tail(console(spark, folder), ["timestamp", "event_id"], actor="ann", action="edit").select("event_id", "actor", "action")


@query("reload_status", f"SELECT arg_max(verdict, (timestamp, event_id)) AS verdict FROM (SELECT * FROM {ENTRIES} ORDER BY timestamp DESC, event_id DESC LIMIT 200) t WHERE verdict IN ('reload_ok', 'reload_failed') AND timestamp > '2024-01-05T00:00:00Z'")
def reload_status(spark, folder):
    return audit.reload_status(entries(spark, folder), "2024-01-05T00:00:00Z", ["timestamp", "event_id"])


POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("latency_percentiles", f"SELECT {', '.join(f'list(latency_us ORDER BY latency_us)[1 + CAST(floor(count(*) * {p}) AS BIGINT)] AS {n}' for n, p in POINTS.items())} FROM {ENTRIES} WHERE verdict IN ('allow', 'block')")
def latency_percentiles(spark, folder):
    return audit.rank_percentiles(entries(spark, folder).where("verdict in ('allow', 'block')"), "latency_us", POINTS)


@query("latency_by_verdict", f"SELECT verdict, {', '.join(f'list(latency_us ORDER BY latency_us)[1 + CAST(floor(count(*) * {p}) AS BIGINT)] AS {n}' for n, p in POINTS.items())} FROM {ENTRIES} GROUP BY verdict")
def latency_by_verdict(spark, folder):
    return audit.rank_percentiles(entries(spark, folder), "latency_us", POINTS, ["verdict"])


@query("block_rate", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (WHERE verdict = 'block') AS hits, count(*) FILTER (WHERE verdict = 'block') / count(*) AS rate FROM {ENTRIES} GROUP BY 1")
def block_rate(spark, folder):
    return audit.verdict_rates(entries(spark, folder), "ts", "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("request_log", f"""SELECT d.doc_id, sha256(p.text) AS prompt_hash, CASE level WHEN 'block' THEN 'block' ELSE 'allow' END AS verdict, CASE level WHEN 'block' THEN rule END AS matched_rule
FROM ({verdict_sql(PROMPTS, False, 'doc_id')}) d JOIN {PROMPTS} p USING (doc_id)""")
def request_log(spark, folder):
    from gatewarden.functions import match
    from gatewarden.rules import RuleSet, default_keywords

    rows = match.classified(prompts(spark, folder), "text", RuleSet(default_keywords()))
    none = F.lit(None).cast("string")
    rows = rows.select("doc_id", "text", F.col("doc_id").cast("string").alias("request_id"), none.alias("timestamp"), "verdict.level", "verdict.rule", none.alias("rule_id"), none.alias("category"), none.alias("severity"), F.lit(0).alias("latency_us"))
    found = audit.request_entries(rows, F.col("text"), none, none)
    return found.select(F.col("request_id").cast("long").alias("doc_id"), "prompt_hash", "verdict", "matched_rule")


BAD = ("", "   ", "{bad json", "[1, 2]", '{"request_id": "x", "verdict": ')


@query("audit_lines_tolerant", "SELECT event_id, CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 2 = 0 THEN 'block' ELSE 'allow' END AS verdict FROM events WHERE event_id % 6 <> 0")
def audit_lines_tolerant(spark, folder):
    rows = table(spark, folder, "events")
    entry = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.when(F.col("event_id") % 2 == 0, "block").otherwise("allow").alias("verdict")))
    line = F.when(F.col("event_id") % 6 == 0, pick(BAD, F.col("event_id") % len(BAD))).otherwise(entry)
    return audit.parsed_entries(rows.select("event_id", line.alias("line"))).select("event_id", "request_id", "verdict")


def _log_folder(spark, name):
    import uuid

    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


@query("audit_log_round_trip", "SELECT CAST(event_id AS VARCHAR) AS request_id, 'allow' AS verdict FROM events")
def audit_log_round_trip(spark, folder):
    """Every event written as a JSON line to the shared folder, appended to once, read again."""
    path = _log_folder(spark, "audit")
    rows = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("request_id"), F.lit("allow").alias("verdict"), "event_id")
    audit.write_entries(rows.where("event_id % 2 = 0").drop("event_id"), path)
    audit.write_entries(rows.where("event_id % 2 <> 0").drop("event_id"), path)
    return audit.read_entries(spark, path).select("request_id", "verdict")


@query("reload_log", "SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 4 <> 0 THEN 'allow' WHEN user_id % 3 = 0 THEN 'reload_failed' ELSE 'reload_ok' END AS verdict, CASE WHEN event_id % 4 = 0 AND user_id % 3 = 0 THEN left(repeat('bad rule ', 30), 200) END AS error, CASE WHEN event_id % 4 <> 0 THEN 'k' || user_id END AS api_key, event_id % 97 AS latency_us FROM events")
def reload_log(spark, folder):
    """Reloads and requests in one log: both shapes written, then read as one."""
    path = _log_folder(spark, "reloads")
    rows = table(spark, folder, "events").select("event_id", "user_id", F.col("event_id").cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), (F.col("event_id") % 97).alias("latency_us"))
    requests = rows.where("event_id % 4 <> 0").select("request_id", "timestamp", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"), F.lit("allow").alias("verdict"), "latency_us")
    builds = audit.reload_entries(rows.where("event_id % 4 = 0"), F.col("user_id") % 3 != 0, F.repeat(F.lit("bad rule "), 30)).select("request_id", "timestamp", "verdict", "error", "latency_us")
    audit.write_entries(requests, path)
    audit.write_entries(builds, path)
    return audit.read_entries(spark, path).select("request_id", "verdict", "error", "api_key", "latency_us")


@query("console_log_round_trip", f"SELECT CAST(event_id AS VARCHAR) AS request_id, timestamp, actor, action, target, file FROM {CONSOLE}")
def console_log_round_trip(spark, folder):
    """Edits and other changes of the console written to its log, each in its own shape, and read as one."""
    path = _log_folder(spark, "console")
    rows = console(spark, folder).withColumn("request_id", F.col("event_id").cast("string"))
    audit.write_entries(audit.console_entries(rows.where("file is not null").drop("target", "event_id")), path)
    audit.write_entries(audit.console_entries(rows.where("target is not null").drop("file", "event_id")), path)
    return audit.read_entries(spark, path, audit.CONSOLE).select("request_id", "timestamp", "actor", "action", "target", "file")
