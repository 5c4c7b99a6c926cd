"""Audit logs: writing decisions, reading tolerantly, tail queries, latencies and rates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.functions.jsonshape import strict_json

REQUEST = "request_id string, timestamp string, api_key string, model string, prompt_hash string, verdict string, matched_rule string, rule_id string, category string, severity string, compliance array<string>, latency_us long, error string"
CONSOLE = "request_id string, timestamp string, actor string, actor_id long, action string, target string, before string, after string, summary string, file string, before_hash string, after_hash string"
RELOADS = ("reload_ok", "reload_failed")


def write_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines; null fields are left out."""
    entries.write.mode(mode).option("ignoreNullFields", "true").json(path)


def read_entries(spark: SparkSession, path: str, schema: str = REQUEST) -> DataFrame:
    """Entries of a log; blank lines and lines that are no JSON are passed over."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def parsed_entries(lines: DataFrame, schema: str = REQUEST) -> DataFrame:
    """Entries of a column ``line`` with others kept; tolerant as ``read_entries``."""
    # a line must be an object as a whole; JSON cut short would otherwise give half an entry
    good = lines.where(strict_json(F.col("line")).isNotNull() & F.startswith(F.ltrim(F.col("line")), F.lit("{")))
    return good.withColumn("e", F.from_json("line", schema)).select(*[c for c in lines.columns if c != "line"], "e.*")


def union_shapes(*shapes: DataFrame) -> DataFrame:
    """Entries of different shapes as one log: what a shape lacks is null."""
    out = shapes[0]
    for s in shapes[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


RELOAD = ("request_id", "timestamp", "verdict", "error", "latency_us")
#: Labels of reload errors have at most so many characters.
LABEL = 200


def reload_entries(builds: DataFrame, ok: Column, error: Column) -> DataFrame:
    """Builds (request_id, timestamp, latency_us) in the slim shape of reloads; they go to the log of requests."""
    verdict = F.when(ok, RELOADS[0]).otherwise(RELOADS[1])
    return builds.select("request_id", "timestamp", verdict.alias("verdict"), F.when(~ok, F.left(error, F.lit(LABEL))).alias("error"), "latency_us")


def console_entries(records: DataFrame) -> DataFrame:
    """Records of the console (edits with a file, other changes with a target) in the shape of its log; what one lacks is null."""
    fields = [x.split() for x in CONSOLE.split(", ")]
    return records.select(*[(F.col(n) if n in records.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows; each task keeps n, which are merged."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def tail(entries: DataFrame, order: list[str], limit: int = 100, verdict: str | None = None) -> DataFrame:
    """Newest first. The filter sees the newest 2 x limit entries only, as the console's query does."""
    seen = newest(entries, order, 2 * limit)
    return newest(seen.where(F.col("verdict") == verdict) if verdict else seen, order, limit)


def console_tail(entries: DataFrame, order: list[str], limit: int = 100, action: str | None = None, actor: str | None = None, target: str | None = None) -> DataFrame:
    """Newest first; with any filter the whole log is read, else the newest 2 x limit. A target is also sought as a file."""
    rows = entries if action or actor or target else newest(entries, order, 2 * limit)
    if action:
        rows = rows.where(F.col("action") == action)
    if actor:
        rows = rows.where(F.col("actor") == actor)
    if target:
        rows = rows.where((F.col("target") == target) | (F.col("file") == target))
    return newest(rows, order, limit)


def reload_status(entries: DataFrame, after: str, order: list[str], lines: int = 200) -> DataFrame:
    """One row: the newest reload verdict later than a time, among the newest lines (null: none yet)."""
    seen = newest(entries, order, lines).where(F.col("verdict").isin(*RELOADS) & (F.try_to_timestamp("timestamp") > F.to_timestamp(F.lit(after))))
    return seen.agg(F.max_by("verdict", F.struct(*order)).alias("verdict"))


#: Ranges of values that exact percentiles are sought in, and distinct values of a range that are sampled for its bounds, about.
RANGES, SAMPLED = 64, 16


def _range_bounds(counts: DataFrame, own: list[str], ranges: int) -> DataFrame:
    """_b by key: upper bounds of ranges with about as many distinct values each; keys with few values need not have any.

    The sample is chosen by the values' hashes. It is the same whenever it is worked out and in whatever order parts of it arrive,
    as bounds that are read twice must be; those of percentile_approx change with the order in which its parts are merged.
    """
    sample = ranges * SAMPLED
    many = counts.groupBy(*own).agg(F.count("*").alias("_d")).where(F.col("_d") > sample)
    taken = _with_key(counts, many, own).where(F.pmod(F.xxhash64("_v"), F.lit(1 << 32)) / F.lit(1 << 32) < F.lit(sample) / F.col("_d"))
    return taken.groupBy(*own).agg(F.filter(F.sort_array(F.collect_list("_v")), lambda v, i: i % SAMPLED == SAMPLED - 1).alias("_b"))


def _with_key(rows: DataFrame, other: DataFrame, own: list[str], how: str = "inner") -> DataFrame:
    """Rows with what another table has for their key, which may be null; without a key, with its only row."""
    named = other.withColumnsRenamed({n: f"{n}b" for n in own})
    return rows.join(named, [F.col(n).eqNullSafe(F.col(f"{n}b")) for n in own] or F.lit(True), how).drop(*[f"{n}b" for n in own])


def rank_percentiles(rows: DataFrame, value: str, points: dict[str, float], keys: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """The value at floor(n p) of the ascending order (from 0), exactly; null values are left out.

    Rows are counted by ranges of the value first, whose bounds come from a sample; the counts tell which range holds a rank, and only
    the distinct values of those ranges are ordered, each range by itself, with their counts. A key with all rows takes no more.
    """
    keys = keys or []
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in names.items()], F.col(value).alias("_v"))
    own = list(names.values())
    counts = rows.groupBy(*own, "_v").agg(F.count("*").alias("_c"))
    counts = _with_key(counts, _range_bounds(counts, own, ranges), own, "left")
    counts = counts.withColumn("_range", F.coalesce(F.array_size(F.filter("_b", lambda b: b < F.col("_v"))), F.lit(0))).drop("_b")
    sizes = counts.groupBy(*own, "_range").agg(F.sum("_c").alias("_s"))
    ordered = W.partitionBy(*own).orderBy("_range")
    sizes = sizes.withColumn("_hi", F.sum("_s").over(ordered)).withColumn("_n", F.sum("_s").over(W.partitionBy(*own))).withColumn("_lo", F.col("_hi") - F.col("_s"))
    at = lambda p: F.floor(F.col("_n") * F.lit(p))
    held = functools.reduce(lambda x, y: x | y, [(F.col("_hi") > at(p)) & (F.col("_lo") <= at(p)) for p in points.values()])
    few = sizes.where(held).select(*[F.col(n).alias(f"{n}s") for n in own], F.col("_range").alias("_r"), "_lo", "_n")
    near = counts.join(few, [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in own] + [F.col("_range") == F.col("_r")])
    upto = near.withColumn("_hi", F.col("_lo") + F.sum("_c").over(W.partitionBy(*own, "_range").orderBy("_v")))
    hit = lambda p: (F.col("_hi") > at(p)) & (F.col("_hi") - F.col("_c") <= at(p))
    found = upto.groupBy(*own).agg(*[F.max(F.when(hit(p), F.col("_v"))).alias(name) for name, p in points.items()])
    return found.select(*[F.col(n).alias(k) for k, n in names.items()], *points)


def verdict_rates(entries: DataFrame, at: str, width: str, verdict: str = "block") -> DataFrame:
    """start, n, hits, rate by windows of time; works on streams with a watermark too."""
    by = entries.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == verdict).alias("hits"))
    return by.select(F.col("w.start").alias("start"), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def request_entries(decisions: DataFrame, text: Column, api_key: Column, model: Column) -> DataFrame:
    """Decisions (request_id, timestamp, level, rule and metadata, latency_us) in the shape of the log.

    Only blocks name their rule; alerts and flags are logged as allowed, without it.
    """
    block = F.col("level") == "block"
    own = [F.when(block, F.col(c)).alias(n) for c, n in (("rule", "matched_rule"), ("rule_id", "rule_id"), ("category", "category"), ("severity", "severity"))]
    return decisions.select("request_id", "timestamp", api_key.alias("api_key"), model.alias("model"), F.sha2(text, 256).alias("prompt_hash"), F.when(block, "block").otherwise("allow").alias("verdict"), *own, "latency_us")
