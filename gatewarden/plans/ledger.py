"""Queries of budgets and logins, on a ledger derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.operators import ledger
from gatewarden.plans.registry import query, table


def spend(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.col("user_id").alias("api_key"), "ts", F.floor(F.col("value") * 100).cast("long").alias("tokens"))


SPEND = "(SELECT event_id, user_id AS api_key, ts, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events)"


def limits(spark, folder):
    keys = table(spark, folder, "events").select(F.col("user_id").alias("api_key")).distinct()
    return keys.where("api_key % 7 <> 0").select("api_key", (F.col("api_key") % 50 * 1000 + 5000).cast("long").alias("token_limit"))


LIMITS = "(SELECT DISTINCT user_id AS api_key, CAST(user_id % 50 * 1000 + 5000 AS BIGINT) AS token_limit FROM events WHERE user_id % 7 <> 0)"


def day():
    return F.date_trunc("day", F.col("ts"))



@query("usage_total", f"SELECT api_key, CAST(sum(tokens) AS BIGINT) AS total FROM {SPEND} GROUP BY api_key")
def usage_total(spark, folder):
    return ledger.usage(spend(spark, folder))


def resets(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'signup'")
    return rows.select(F.col("user_id").alias("api_key"), F.col("ts").alias("reset_at"))


RESETS = "(SELECT user_id AS api_key, ts AS reset_at FROM events WHERE event_type = 'signup')"


@query("usage_since_reset", f"SELECT s.api_key, CAST(sum(tokens) AS BIGINT) AS total FROM {SPEND} s LEFT JOIN (SELECT api_key, max(reset_at) AS r FROM {RESETS} x GROUP BY api_key) l ON s.api_key = l.api_key WHERE r IS NULL OR ts > r GROUP BY s.api_key")
def usage_since_reset(spark, folder):
    return ledger.usage(spend(spark, folder), resets(spark, folder))


@query("quota_status", f"SELECT u.api_key, total, coalesce(token_limit, -1) AS token_limit, CASE WHEN l.token_limit IS NULL THEN 'unlimited' WHEN total >= l.token_limit THEN 'exceeded' ELSE 'ok' END AS status FROM (SELECT api_key, CAST(sum(tokens) AS BIGINT) AS total FROM {SPEND} GROUP BY api_key) u LEFT JOIN {LIMITS} l USING (api_key)")
def quota_status(spark, folder):
    both = ledger.usage(spend(spark, folder)).join(limits(spark, folder), "api_key", "left")
    return both.select("api_key", "total", F.coalesce("token_limit", F.lit(-1)).alias("token_limit"), ledger.quota(F.col("total"), F.col("token_limit")).alias("status"))


BEFORE = "CAST(coalesce(sum(tokens) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query("quota_admission", f"SELECT event_id, api_key, spent_before, token_limit IS NULL OR spent_before < token_limit AS admitted FROM (SELECT *, {BEFORE.format(keys='api_key')} AS spent_before FROM {SPEND} s LEFT JOIN {LIMITS} l USING (api_key)) x")
def quota_admission(spark, folder):
    rows = ledger.admitted(spend(spark, folder), limits(spark, folder), day(), ["ts", "event_id"])
    return rows.select("event_id", "api_key", "spent_before", "admitted")




@query("quota_admission_resets", f"""SELECT event_id, api_key, epoch, token_limit IS NULL OR spent < token_limit AS admitted FROM
(SELECT *, {BEFORE.format(keys='api_key, epoch')} AS spent FROM
(SELECT event_id, user_id AS api_key, ts, CAST(floor(value * 100) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS epoch FROM events) e
LEFT JOIN {LIMITS} l USING (api_key)) x""")
def quota_admission_resets(spark, folder):
    """A signup resets the key: the number of resets so far is part of the key."""
    rows = spend(spark, folder).join(table(spark, folder, "events").select("event_id", (F.col("event_type") == "signup").cast("long").alias("reset")), "event_id")
    rows = ledger.running_total(rows, ["api_key"], ["ts", "event_id"], "reset", day(), "epoch")
    rows = ledger.admitted(rows, limits(spark, folder), day(), ["ts", "event_id"], ["api_key", "epoch"])
    return rows.select("event_id", "api_key", "epoch", "admitted")


@query("limit_changes", "SELECT api_key, l AS token_limit FROM (SELECT user_id AS api_key, arg_max_null(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id * 10 END, (ts, event_id)) AS l FROM events WHERE event_type = 'purchase' GROUP BY user_id) x WHERE l IS NOT NULL")
def limit_changes(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'purchase'")
    changes = rows.select(F.col("user_id").alias("api_key"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 10).alias("token_limit"), "ts", F.col("event_id").alias("seq"))
    return ledger.current_limits(changes)


@query("usage_with_limits", f"SELECT api_key, total, coalesce(token_limit, -1) AS token_limit, row_number() OVER (ORDER BY total DESC, api_key) AS place FROM (SELECT api_key, CAST(sum(tokens) AS BIGINT) AS total FROM {SPEND} GROUP BY api_key) u LEFT JOIN {LIMITS} l USING (api_key) ORDER BY place LIMIT 100")
def usage_with_limits(spark, folder):
    """The console's report: the hundred largest users with their limits."""
    from pyspark.sql import Window as W

    both = ledger.usage(spend(spark, folder)).join(limits(spark, folder), "api_key", "left").orderBy(F.desc("total"), "api_key").limit(100)
    return both.withColumn("token_limit", F.coalesce("token_limit", F.lit(-1))).withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), "api_key")).cast("long"))


def attempts(spark, folder):
    rows = table(spark, folder, "events").where("event_type in ('error', 'signup')")
    return rows.select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 20).alias("username"), (F.col("user_id") % 7).alias("ip"), F.col("ts").alias("attempted_at"), (F.col("event_type") == "signup").alias("success"))


ATTEMPTS = "(SELECT event_id AS attempt_id, user_id % 20 AS username, user_id % 7 AS ip, ts AS attempted_at, event_type = 'signup' AS success FROM events WHERE event_type IN ('error', 'signup'))"
RECENT = "count(*) OVER (PARTITION BY {by} ORDER BY attempted_at RANGE BETWEEN INTERVAL '{m} minutes' - INTERVAL '1 microsecond' PRECEDING AND CURRENT ROW)"


@query("login_attempts_recent", f"SELECT attempt_id, {RECENT.format(by='username', m=60)} AS by_user, {RECENT.format(by='ip', m=60)} AS by_ip FROM {ATTEMPTS}")
def login_attempts_recent(spark, folder):
    rows = ledger.recent_counts(attempts(spark, folder), "username", 60, "by_user")
    return ledger.recent_counts(rows, "ip", 60, "by_ip").select("attempt_id", "by_user", "by_ip")


@query("login_lockouts", f"""SELECT attempt_id, username, recent, recent >= 3 AS locked FROM (SELECT *, {RECENT.format(by='username, epoch', m=600)} AS recent FROM
(SELECT *, coalesce(sum(success::INT) OVER (PARTITION BY username ORDER BY attempted_at, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM {ATTEMPTS}) a WHERE NOT success) b""")
def login_lockouts(spark, folder):
    return ledger.lockouts(attempts(spark, folder), 3, 600).select("attempt_id", "username", "recent", "locked")




@query("attempts_pruned", f"SELECT attempt_id, attempted_at FROM {ATTEMPTS} WHERE attempted_at >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL '4320 minutes'")
def attempts_pruned(spark, folder):
    return ledger.pruned(attempts(spark, folder), "attempted_at", F.expr("TIMESTAMP '2024-01-10 00:00:00'"), 4320).select("attempt_id", "attempted_at")


@query("sessions_live", "SELECT event_id AS session_id, last_seen_at, expires_at FROM (SELECT event_id, ts AS last_seen_at, ts + to_minutes(CAST(user_id % 5000 AS INT)) AS expires_at FROM events WHERE event_type = 'view') s WHERE expires_at >= TIMESTAMP '2024-01-10 00:00:00' AND last_seen_at >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL '4320 minutes'")
def sessions_live(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'view'")
    sessions = rows.select(F.col("event_id").alias("session_id"), F.col("ts").alias("last_seen_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 5000).cast("int"))).alias("expires_at"))
    return ledger.live_sessions(sessions, F.expr("TIMESTAMP '2024-01-10 00:00:00'"), 4320)
