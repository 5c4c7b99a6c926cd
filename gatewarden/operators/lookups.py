"""Joins against small reference tables: policies, tokens, routes, backends."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Reference tables of at most so many rows and bytes (as JSON) are sent to all tasks; larger ones are joined by shuffling.
SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """The table marked for broadcasting, if it is counted and small: few rows, and few bytes in them."""
    held = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("rows"), held.alias("held")).first()
    return F.broadcast(df) if found.rows <= rows and found.held <= size else df


def enriched(decisions: DataFrame, policy: DataFrame, rule: str = "rule") -> DataFrame:
    """Decisions with rule_id, category, severity and compliance of the policy rule that decided.

    Looked up by the literal (in lower case), then by the placeholder; of several rules with one key the last
    declared counts. What a shadow verdict puts before the rule is not part of it.
    """
    meta = F.struct("rule_id", "category", "severity", "compliance")
    literal = policy.where("not regex").groupBy(F.lower("pattern").alias("_key")).agg(F.max_by(meta, "ord").alias("_l"))
    named = policy.where("placeholder is not null").groupBy(F.col("placeholder").alias("_key")).agg(F.max_by(meta, "ord").alias("_p"))
    bare = F.regexp_replace(rule, "^shadow_block:", "")
    rows = decisions.withColumn("_bare", bare)
    rows = rows.join(small(literal), F.lower("_bare") == F.col("_key"), "left").drop("_key")
    rows = rows.join(small(named), F.col("_bare") == F.col("_key"), "left").drop("_key")
    found = F.coalesce("_l", "_p")
    return rows.select(*decisions.columns, *[found[c].alias(c) for c in ("rule_id", "category", "severity", "compliance")])


def routed(requests: DataFrame, routes: DataFrame, default: str, model: str = "model") -> DataFrame:
    """Requests with backend and chain: the first route whose pattern fits the model, else the default without fallbacks.

    Models are few beside requests: each distinct model is joined once, on its name and all its beginnings, with the
    routes by what they ask for, so a table of many routes is never compared with all models.
    """
    models = requests.select(F.col(model).alias("_model")).where(F.col(model).isNotNull()).distinct()
    # a model is fitted by its own name and by its beginnings, so routes are joined on those
    star = F.endswith("pattern", F.lit("*"))
    keyed = routes.where("pattern is not null").withColumn("_key", F.struct(star.alias("star"), F.when(star, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")).alias("text")))
    least = keyed.groupBy("_key").agg(F.min_by(F.struct("ord", "backend", "fallback"), "ord").alias("_r"))
    starts = F.transform(F.sequence(F.lit(0), F.length("_model")), lambda n: F.struct(F.lit(True).alias("star"), F.left("_model", n).alias("text")))
    keys = models.select("_model", F.explode(F.array_append(starts, F.struct(F.lit(False).alias("star"), F.col("_model").alias("text")))).alias("_key"))
    hit = keys.join(least, "_key").select("_model", "_r.*")
    first = hit.groupBy("_model").agg(F.min_by(F.struct("backend", "fallback"), "ord").alias("_r"))
    rows = requests.join(small(first), requests[model] == F.col("_model"), "left")
    backend = F.coalesce("_r.backend", F.lit(default))
    chain = F.concat(F.array(backend), F.coalesce("_r.fallback", F.array().cast("array<string>")))
    return rows.select(*requests.columns, backend.alias("backend"), chain.alias("chain"))


def failover(chain: Column, status: Column) -> Column:
    """Outcome of trying a chain in order: ``status`` maps backend to its status, null where it cannot be reached.

    The first answer below 500 serves, as does the answer of the last backend whatever it is; else the last answer of 500 or more, else an error.
    """
    tried = F.transform(chain, lambda b: F.struct(b.alias("backend"), F.try_element_at(status, b).alias("status")))
    good = F.filter(tried, lambda t: t["status"] < 500)
    bad = F.filter(tried, lambda t: t["status"] >= 500)
    pick = F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(bad, F.lit(-1)))
    outcome = F.when(F.size(good) > 0, "served").when(F.size(bad) > 0, "server_error").otherwise("all_backends_failed")
    attempts = F.when(F.size(good) > 0, F.array_position(chain, pick["backend"]).cast("int")).otherwise(F.size(chain))
    return F.struct(outcome.alias("outcome"), pick["backend"].alias("backend"), pick["status"].alias("status"), attempts.alias("attempts"))


def unknown_backends(routes: DataFrame, backends: DataFrame) -> DataFrame:
    """Backends that a route or a fallback names but no backend is called."""
    named = routes.select(F.explode(F.concat(F.array("backend"), F.coalesce("fallback", F.array().cast("array<string>")))).alias("backend"))
    return named.distinct().join(backends.select("backend"), "backend", "left_anti")


TOKEN = r"^ng_[A-Za-z0-9]_[A-Za-z0-9]{24}\z"


def token_parts(token: Column) -> Column:
    """valid, prefix (10 characters) and hash (SHA-256 in hex) of a client token."""
    valid = F.coalesce(F.regexp_like(token, F.lit(TOKEN)), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, F.left(token, F.lit(10))).alias("prefix"), F.when(valid, F.sha2(token, 256)).alias("hash"))


def verified(requests: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Requests (token) with result and budget_key.

    missing, malformed, unknown, mismatch, revoked, expired or ok, whichever is first. An expiry that is
    no time does not expire.
    """
    rows = requests.withColumn("_t", token_parts(F.col("token")))
    known = tokens.select(F.col("prefix").alias("_prefix"), F.lower("hash").alias("_hash"), F.col("id").alias("_id"), F.col("expires_at").alias("_expires"), F.col("revoked_at").alias("_revoked"))
    rows = rows.join(small(known), rows["_t.prefix"] == F.col("_prefix"), "left")
    expires = F.try_to_timestamp(F.col("_expires").cast("string"))
    result = (
        F.when(F.coalesce("token", F.lit("")) == "", "missing").when(~F.col("_t.valid"), "malformed").when(F.col("_id").isNull(), "unknown")
        .when(F.col("_hash") != F.col("_t.hash"), "mismatch").when(F.col("_revoked").isNotNull(), "revoked").when(F.coalesce(expires <= now, F.lit(False)), "expired").otherwise("ok")
    )
    return rows.select(*requests.columns, result.alias("result"), F.when(result == "ok", F.concat(F.lit("token:"), F.col("_id").cast("string"))).alias("budget_key"))


def revoked(tokens: DataFrame, which: Column, now: Column) -> DataFrame:
    """Tokens with the live ones among ``which`` revoked now; revoking twice changes nothing."""
    return tokens.withColumn("revoked_at", F.when(which, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def request_id(nanos: Column, seq: Column) -> Column:
    """48 hexadecimal digits: the time in nanoseconds, then a counter."""
    return F.lower(F.concat(F.lpad(F.hex(nanos), 32, "0"), F.lpad(F.hex(seq), 16, "0")))


def merged_models(lists: DataFrame) -> DataFrame:
    """Model lists of several backends (backend, model, error) as one, each owned by its backend."""
    return lists.where("error is null and model is not null").select(F.col("model").alias("id"), F.col("backend").alias("owned_by"))


def listing_failed(lists: DataFrame) -> DataFrame:
    """One row: whether every backend failed, and the errors of those that did, in order."""
    by = lists.groupBy("backend").agg(F.max("error").alias("error"))
    return by.agg(F.bool_and(F.col("error").isNotNull()).alias("failed"), F.array_join(F.sort_array(F.collect_list(F.concat("backend", F.lit(": "), "error"))), "; ").alias("errors"))


def listed(rows: DataFrame, at: str, tie: str, *keys: str) -> DataFrame:
    """Rows with place: 1 for the latest, by keys if there are any; equal times go by the smaller ``tie``.

    Rows without a time come last. Without keys the last places need all rows in order; they are ranked by ranges of time that tasks
    hold, and the ranges' sizes.
    """
    if keys:
        return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(at), tie)).cast("long"))
    block = F.date_trunc("day", at)
    inside = F.row_number().over(W.partitionBy("_block").orderBy(F.desc_nulls_last(at), tie))
    sizes = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))  # one row a day
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(W.orderBy(F.desc_nulls_last("_block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = before.withColumnRenamed("_block", "_day")
    ranked = rows.withColumn("_block", block).withColumn("_inside", inside).join(small(before), F.col("_block").eqNullSafe(F.col("_day")))
    return ranked.withColumn("place", (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_day", "_inside", "_before")


def found_users(asked: DataFrame, users: DataFrame, by_id: str, by_name: str) -> DataFrame:
    """Questions with the user they ask for, by id where that is given, else by name; nobody is null."""
    one = users.select(F.col("id").alias("_id"), F.struct("*").alias("_by_id"))
    two = users.select(F.col("username").alias("_name"), F.struct("*").alias("_by_name"))
    rows = asked.join(small(one), F.col(by_id) == F.col("_id"), "left")
    rows = rows.join(small(two), F.col(by_id).isNull() & (F.col(by_name) == F.col("_name")), "left")
    return rows.withColumn("_user", F.coalesce("_by_id", "_by_name")).select(*asked.columns, *[F.col(f"_user.{c}").alias(c) for c in users.columns])


def cache_outcomes(lookups: DataFrame, cache: str, key: str, at: str, ordinal: str, capacity: int = 10_000, ttl_s: float = 60.0) -> DataFrame:
    """Lookups with hit: what a cache of ``capacity`` entries that expire ``ttl_s`` seconds after they were put in would answer.

    A hit is a use; what is not found, or has expired, is put in anew. A full cache drops an expired entry, else the one whose
    last use is longest ago. Lookups of one ``cache`` (an instance of a gateway) are taken in the order of ``at``, then ``ordinal``.
    Lookups without a key or a time are left out. They are streamed through one task in that order, which holds no more than ``capacity`` entries; caches are dealt among tasks.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lookups.schema.fields)
    parts = int(lookups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lookups.repartition(parts, cache).sortWithinPartitions(cache, at, ordinal)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, due = object(), {}, []  # entries in the order of their last use; due: times put in, oldest first
        for batch in batches:
            hits = []
            for c, k, t in zip(*(batch.column(x).to_pylist() for x in (cache, key, at)), strict=True):
                if c != now:
                    now, entries, due = c, {}, []
                put = entries.pop(k, None)
                hit = put is not None and (t - put).total_seconds() < ttl_s
                if not hit:
                    if put is None and len(entries) >= capacity:
                        while due and entries.get(due[0][1]) != due[0][0]:
                            heapq.heappop(due)  # replaced or dropped since
                        old = due[0][1] if due and (t - due[0][0]).total_seconds() >= ttl_s else next(iter(entries))
                        del entries[old]
                    put = t
                    heapq.heappush(due, (t, k))
                    if len(due) > 4 * capacity:
                        due = [(p, x) for x, p in entries.items()]
                        due.append((t, k))
                        heapq.heapify(due)
                entries[k] = put
                hits.append(hit)
            yield batch.append_column("hit", pa.array(hits, pa.bool_()))

    return ordered.where(F.col(key).isNotNull() & F.col(at).isNotNull()).mapInArrow(answered, f"{kinds}, hit boolean")
