"""Queries of rule files, on lines and paths derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewarden.plans.registry import pick, query, shared, sql_list, table
from gatewarden.sources import files

LINES = ("developer mode\t0\t8.0", "# comment", "   ", "casino\t2\t1.0", "/\\bSEC-\\d{6}\\b/\t1", "no key", "bad key\tx", "too big\t7", "plain\t1\tnot a number", "//\t2")
CLEAN = "trim(line, E' \\t\\n\\r')"


def lines(spark, folder, items):
    return table(spark, folder, "events").select("event_id", pick(items, F.col("event_id") % len(items)).alias("line"))


@query("dictionary_lines", f"""SELECT event_id, CASE WHEN key IS NULL THEN 'missing key' WHEN num IS NULL THEN 'invalid key `' || key || '`' WHEN num > 2 THEN 'unsupported key `' || key || '`' END AS error,
CASE WHEN body = '' THEN 'literal' ELSE 'regex' END AS kind, CASE WHEN body = '' THEN pattern ELSE body END AS pattern, ['block', 'alert', 'flag'][1 + num] AS tier, coalesce(TRY_CAST(weight AS DOUBLE), 1.0) AS weight
FROM (SELECT *, regexp_extract(pattern, '^/(.+)/$', 1) AS body, CASE WHEN regexp_matches(key, '^\\+?[0-9]+$') THEN TRY_CAST(key AS BIGINT) END AS num FROM
(SELECT event_id, t, string_split(t, chr(9))[1] AS pattern, string_split(t, chr(9))[2] AS key, string_split(t, chr(9))[3] AS weight FROM (SELECT event_id, {CLEAN} AS t FROM (SELECT event_id, {sql_list(LINES)}[1 + event_id % {len(LINES)}] AS line FROM events) a) b WHERE t <> '' AND NOT starts_with(t, '#')) c) d""")
def dictionary_lines(spark, folder):
    return lines(spark, folder, LINES).select("event_id", files.keyword_lines(F.col("line")).alias("r")).where("r is not null").select("event_id", "r.*")


ENTITY_LINES = ("/\\bSEC-\\d{6}\\b/\tinternal_ticket", "/a/b/c/\t0", "/x+/", "plain\tNAME", "# /no/\tNO", "//\tEMPTY", "/[0-9]{4}/\t pin ")


@query("entity_lines", f"""SELECT event_id, CASE WHEN label = '' OR regexp_matches(label, '^[0-9]+$') THEN 'PII_' || event_id ELSE upper(label) END AS entity, pattern FROM (SELECT event_id, regexp_extract(string_split(t, chr(9))[1], '^/(.*)/[^/]*$', 1) AS pattern, trim(coalesce(string_split(t, chr(9))[2], '')) AS label, t
FROM (SELECT event_id, {CLEAN} AS t FROM (SELECT event_id, {sql_list(ENTITY_LINES)}[1 + event_id % {len(ENTITY_LINES)}] AS line FROM events) a) b) c WHERE pattern <> '' AND NOT starts_with(t, '#')""")
def entity_lines(spark, folder):
    rows = lines(spark, folder, ENTITY_LINES).select("event_id", files.entity_lines(F.col("line"), F.col("event_id")).alias("r"))
    return rows.where("r is not null").select("event_id", "r.*")


@query("pattern_literals", f"SELECT event_id, nullif(regexp_extract(split_part(line, chr(9), 1), '^/(.+)/$', 1), '') AS body FROM (SELECT event_id, {sql_list(LINES)}[1 + event_id % {len(LINES)}] AS line FROM events) a")
def pattern_literals(spark, folder):
    rows = lines(spark, folder, LINES)
    return rows.select("event_id", F.nullif(F.regexp_extract(F.get(F.split("line", "\t", -1), 0), r"^/(.+)/$", 1), F.lit("")).alias("body"))


@query("policy_errors", """WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'R-' || CASE WHEN event_id % 30 = 1 THEN event_id - 1 ELSE event_id END END AS rule_id, CASE WHEN event_id % 40 = 3 THEN '' ELSE 'p' END AS pattern, CASE WHEN event_id % 3 = 0 THEN 'redact' ELSE 'block' END AS action, CASE WHEN event_id % 6 = 0 THEN 'X' END AS placeholder FROM events)
SELECT rule_id, 'rule has empty id' AS error FROM r WHERE rule_id = '' UNION ALL SELECT rule_id, 'empty pattern' FROM r WHERE pattern = ''
UNION ALL SELECT rule_id, 'redact requires placeholder' FROM r WHERE action = 'redact' AND placeholder IS NULL UNION ALL SELECT rule_id, 'duplicate rule id' FROM r WHERE rule_id <> '' GROUP BY rule_id HAVING count(*) > 1""")
def policy_errors(spark, folder):
    e = F.col("event_id")
    number = F.when(e % 30 == 1, e - 1).otherwise(e).cast("string")
    rows = table(spark, folder, "events").select(F.when(e % 50 == 0, "").otherwise(F.concat(F.lit("R-"), number)).alias("rule_id"), F.when(e % 40 == 3, "").otherwise("p").alias("pattern"), F.when(e % 3 == 0, "redact").otherwise("block").alias("action"), F.when(e % 6 == 0, "X").alias("placeholder"))
    return files.policy_errors(rows)


@query("content_hashes", "SELECT page_id, sha256(html) AS hash FROM pages")
def content_hashes(spark, folder):
    return table(spark, folder, "pages").select("page_id", files.content_hash(F.col("html")).alias("hash"))


@query("backups_kept", "SELECT * FROM (SELECT user_id AS stem, event_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) x WHERE rank <= 3")
def backups_kept(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("stem"), F.col("event_id").alias("path"), F.col("ts").alias("mtime"))
    return files.kept_backups(rows, 3).select("stem", "path", F.col("rank").cast("long").alias("rank"))


PATHS = ("a/POLICY.yaml", "b.yml", "c.toml", "my-pii-regex.txt", "words.txt", "x.json")


@query("file_kinds", f"SELECT event_id, CASE WHEN p LIKE '%.yaml' OR p LIKE '%.yml' THEN 'policy' WHEN p LIKE '%.toml' THEN 'config' WHEN p LIKE '%.txt' AND p LIKE '%pii%' THEN 'entities' WHEN p LIKE '%.txt' THEN 'keywords' ELSE 'unknown' END AS kind FROM (SELECT event_id, lower({sql_list(PATHS)}[1 + event_id % {len(PATHS)}]) AS p FROM events) x")
def file_kinds(spark, folder):
    return table(spark, folder, "events").select("event_id", files.file_kind(pick(PATHS, F.col("event_id") % len(PATHS))).alias("kind"))




@query("gold_corpus", "SELECT 'd' || doc_id AS id, sha256(text) AS digest, 'EMAIL' AS type, 0 AS start, CAST(doc_id % 9 AS INTEGER) AS stop FROM documents WHERE text IS NOT NULL")
def gold_corpus(spark, folder):
    """A corpus written as JSON lines to the shared folder and read by the strict reader."""
    import uuid

    path = f"{shared(spark)}/gold-{uuid.uuid4().hex}"
    span = F.struct(F.lit("EMAIL").alias("type"), F.lit(0).alias("start"), (F.col("doc_id") % 9).cast("int").alias("end"))
    table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.array(span).alias("annotations")).write.json(path)
    return files.gold_corpus(spark, path).select("id", F.sha2("text", 256).alias("digest"), F.explode("annotations").alias("a")).select("id", "digest", "a.type", "a.start", F.col("a.end").alias("stop"))


