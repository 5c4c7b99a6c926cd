"""URL filters by a temporal list join.

A list is a log of dated entries: a domain is added under a category, or removed. Ordered by
date, the entries of a domain become validity intervals, and these become turns: stretches of time, apart from each
other, in which one interval decides. Every capture is judged by the turn that was running when it was fetched: an
as-of join on its host and the host's parent domains, where the longest listed domain decides.

The as-of join is a merge: turns and questions (distinct pairs of domain and time) of one domain and day are
ordered by time, and each question takes the last turn before it; the turn that a day begins with comes
from a table of one row a domain and day. So a question costs the same however many entries its domain has, and
a domain with a third of all captures or entries is spread over its days. A host with very many captures at one
time costs one question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.store import clear, written

START = "2024-01-01 00:00:00"
DAY = "unix_seconds(cast({} as timestamp)) div 86400"
#: The end of an interval that is still active.
NEVER = "TIMESTAMP '9999-12-31 00:00:00'"
HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def intervals(entries: DataFrame) -> DataFrame:
    """domain, category, since, until (null: still active) of a log (domain, category, action add/remove, at).

    Domains count in lower case: a removal of ``b.org`` ends ``B.org``.
    An addition to what is listed already, and a removal of what is not, change nothing of the
    verdict; of entries of one domain, category and time the removal is the later. Rows that lack a value or have another action are left out.
    """
    log = clear(entries, "domain", "category", "action", "at").where("domain is not null and category is not null and at is not null and action in ('add', 'remove')")
    log = log.withColumn("domain", F.lower("domain")).dropDuplicates()
    log = written(log.withColumn("day", F.expr(DAY.format("at"))), "url-log")
    # the next entry is one of the same day, or the first of the next day that has any
    days = log.groupBy("domain", "category", "day").agg(F.min("at").alias("first"))
    later = days.withColumn("later", F.lead("first").over(W.partitionBy("domain", "category").orderBy("day"))).drop("first")
    order = W.partitionBy("domain", "category", "day").orderBy("at", "action")
    spans = log.join(later, ["domain", "category", "day"]).withColumn("until", F.coalesce(F.lead("at").over(order), "later"))
    return spans.where("action = 'add' and (until is null or until > at)").select("domain", "category", F.col("at").alias("since"), "until")


def turns(spans: DataFrame) -> DataFrame:
    """domain, from, until, category, since: the stretches in which an interval decides, which never overlap within a domain.

    Of the intervals that are active the earliest decides, then the first by category. So one that comes later begins
    to decide when all before it have ended, and never does if that is not before its own end.
    """
    spans = written(spans.withColumn("day", F.expr(DAY.format("since"))).withColumn("ends", F.expr(f"coalesce(until, {NEVER})")), "url-intervals")
    days = spans.groupBy("domain", "day").agg(F.max("ends").alias("most"))
    upto = W.partitionBy("domain").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    before = days.withColumn("ended", F.max("most").over(upto)).drop("most")
    own = W.partitionBy("domain", "day").orderBy("since", "category").rowsBetween(W.unboundedPreceding, -1)
    found = spans.join(before, ["domain", "day"]).withColumn("from", F.greatest("since", "ended", F.max("ends").over(own)))
    return found.where("`from` < ends").select("domain", "from", "until", "category", "since")


def running(questions: DataFrame, spells: DataFrame) -> DataFrame:
    """domain, at, category, since for each question (domain, at, distinct) whose time falls into a turn of its domain."""
    turn = F.struct(F.col("from"), "until", "category", "since")
    asked = questions.join(spells.select("domain").distinct(), "domain", "left_semi").select("domain", "at", F.lit(None).cast(spells.select(turn.alias("t")).schema[0].dataType).alias("turn"))
    began = spells.select("domain", F.col("from").cast("timestamp").alias("at"), turn.alias("turn"))
    both = written(began.unionByName(asked).withColumn("day", F.expr(DAY.format("at"))), "url-questions")
    days = both.groupBy("domain", "day").agg(F.max("turn").alias("last"))
    upto = W.partitionBy("domain").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.withColumn("carried", F.last("last", ignorenulls=True).over(upto)).drop("last")
    order = W.partitionBy("domain", "day").orderBy("at", F.col("turn").isNull()).rowsBetween(W.unboundedPreceding, 0)
    latest = both.join(carried, ["domain", "day"]).withColumn("now", F.coalesce(F.last("turn", ignorenulls=True).over(order), "carried"))
    return latest.where("turn is null and now is not null and (now.until is null or at < now.until)").select("domain", "at", "now.category", "now.since")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (page_id, host, fetched_at) with blocked, domain, category and since of the deciding entry.

    Hosts are in lower case. An entry covers its domain and what lies below; one without a dot covers that very host
    alone. A null or unreadable URL has an empty host and is never blocked; a null time neither. Ties between
    categories of one domain go to the earliest, then the first by name. Repeated rows stay. An empty list blocks nothing,
    empty captures give no rows.
    """
    spans = intervals(entries)
    captures = clear(captures, "page_id", "host", "fetched_at")
    pairs = captures.select("host", "fetched_at").where("host <> '' and fetched_at is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = pairs.select("host", "fetched_at", F.col("fetched_at").cast("timestamp").alias("at"), F.explode(suffixes).alias("domain"))
    spells = written(turns(spans), "url-turns")
    active = keyed.join(running(keyed.select("domain", "at").distinct(), spells), ["domain", "at"])
    first = F.struct((-F.length("domain")).alias("k"), "since", "category", "domain")
    verdict = active.groupBy("host", "fetched_at").agg(F.min(first).alias("v"))
    # written, so that very many captures of one host and time can be split in the join
    rows = captures.join(written(verdict, "url-verdicts"), ["host", "fetched_at"], "left")
    return rows.select("page_id", "host", "fetched_at", F.col("v").isNotNull().alias("blocked"), F.col("v.domain").alias("domain"), F.col("v.category").alias("category"), F.col("v.since").alias("since"))


# The tables hold no list and no fetch times; both are made from what they hold, by SQL that Spark and DuckDB share.
DIGIT = "(instr('0123456789abcdef', substr(md5({}), {}, 1)) - 1)"


def _entries_sql(hosts: str) -> str:
    d = [DIGIT.format("domain", i + 1) for i in range(6)]
    day = f"10 * {d[0]}"
    gone = f"{day} + 5 + 10 * {d[3]}"
    kind = f"CASE {d[1]} % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'malware' ELSE 'spam' END"
    listed = f"SELECT domain, {kind} AS category, {day} AS d, {gone} AS g, {d[2]} AS k FROM ({hosts}) h WHERE domain <> '' AND {d[4]} < 10"
    return f"""SELECT domain, category, 'add' AS action, d FROM ({listed}) a
UNION ALL SELECT domain, category, 'remove' AS action, g AS d FROM ({listed}) b WHERE k >= 6
UNION ALL SELECT domain, category, 'add' AS action, g + 30 AS d FROM ({listed}) c WHERE k >= 11"""


HOSTS = "SELECT DISTINCT host AS domain FROM captures UNION SELECT DISTINCT regexp_replace(host, '^[^.]+[.]', '') AS domain FROM captures WHERE host LIKE '%.%.%'"


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = clear(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    time = F.expr(f"TIMESTAMP '{START}' + make_dt_interval(cast(page_id % 365 as int), cast(page_id % 24 as int))")
    # written, as the list is made from them too: pages are read once
    captures = written(pages.select("page_id", F.expr(HOST.replace("\\", "\\\\")).alias("host"), time.alias("fetched_at")), "captures")
    hosts = spark.sql(_entries_sql(HOSTS).replace("FROM captures", "FROM {captures}"), captures=captures)
    entries = hosts.select("domain", "category", "action", F.expr(f"TIMESTAMP '{START}' + make_dt_interval(cast(d as int))").alias("at"))
    return judged(captures, entries)


SQL = f"""
WITH captures AS (SELECT page_id, {HOST} AS host, TIMESTAMP '{START}' + to_days(CAST(page_id % 365 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at FROM pages),
entries AS ({_entries_sql(HOSTS)}),
log AS (SELECT DISTINCT lower(domain) AS domain, category, action, TIMESTAMP '{START}' + to_days(CAST(d AS INTEGER)) AS ts FROM entries),
nxt AS (SELECT *, lead(ts) OVER (PARTITION BY domain, category ORDER BY ts, action) AS until FROM log),
spans AS (SELECT domain, category, ts AS since, until FROM nxt WHERE action = 'add' AND (until IS NULL OR until > ts)),
hit AS (SELECT c.page_id, s.domain, s.category, s.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, s.since, s.category) AS k
  FROM captures c JOIN spans s ON (c.host = s.domain OR (s.domain LIKE '%.%' AND ends_with(c.host, '.' || s.domain))) AND s.since <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until))
SELECT c.page_id, c.host, c.fetched_at, h.page_id IS NOT NULL AS blocked, h.domain, h.category, h.since FROM captures c LEFT JOIN hit h ON h.page_id = c.page_id AND h.k = 1
"""
