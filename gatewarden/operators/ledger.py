"""Token budgets, login limits and other running counts.

Running totals are taken in two steps: sums by key and block of time, then inside a block. No
window spans all rows of a key, so a key with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the key; ``block`` must not fall along the order."""
    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), before.alias("_before"))
    on = [rows[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys] + [rows["_block"].eqNullSafe(starts["_b"])]
    joined = rows.join(starts, on).drop("_b", *[f"_k_{k}" for k in keys])
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(out, F.col("_before") + inside).drop("_block", "_before")


def usage(spend: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """api_key, total: tokens since the key's last reset, if it has one (api_key, reset_at)."""
    if resets is not None:
        last = resets.groupBy("api_key").agg(F.max("reset_at").alias("reset_at"))
        spend = spend.join(last, "api_key", "left").where("reset_at is null or ts > reset_at")
    return spend.groupBy("api_key").agg(F.sum("tokens").alias("total"))


def current_limits(changes: DataFrame) -> DataFrame:
    """api_key, token_limit from dated changes; the last one counts, and a null one clears the limit."""
    last = changes.groupBy("api_key").agg(F.max_by(F.struct("token_limit"), F.struct("ts", "seq")).alias("l"))
    return last.select("api_key", "l.token_limit").where("token_limit is not null")


def quota(total: Column, limit: Column) -> Column:
    """unlimited, exceeded (at the limit or over it) or ok."""
    return F.when(limit.isNull(), "unlimited").when(F.coalesce(total, F.lit(0)) >= limit, "exceeded").otherwise("ok")


def admitted(requests: DataFrame, limits: DataFrame, block: Column, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Requests with ``admitted``: checked before they run against what ran before.

    Refused requests spend nothing, but the sum of all earlier ones serves: it is the same up
    to the first refusal, and afterwards never below the limit.
    """
    keys = keys or ["api_key"]
    rows = requests.join(limits, "api_key", "left")
    rows = running_total(rows, keys, order, "tokens", block, "spent_before")
    return rows.withColumn("admitted", F.col("token_limit").isNull() | (F.col("spent_before") < F.col("token_limit")))


def _framed(attempts: DataFrame, minutes: int) -> DataFrame:
    """Attempts by blocks of as many minutes, each in its own block and, not ``_own``, in the next.

    A window of those minutes that ends in a block lies in it and the one before, so no window spans all
    attempts of a user: one with a third of them is spread over the blocks.
    """
    block = F.floor(F.unix_micros(F.col("attempted_at").cast("timestamp")) / (minutes * 60_000_000))
    own, after = F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own"))
    rows = attempts.withColumn("_f", F.explode(F.when(block.isNull(), F.array(own)).otherwise(F.array(own, after))))
    return rows.withColumn("_block", F.col("_f.b")).withColumn("_own", F.col("_f.own")).drop("_f")


def recent_counts(attempts: DataFrame, by: str, minutes: int, out: str) -> DataFrame:
    """Adds the attempts of the same user or address within the last minutes, this one included."""
    seconds = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    window = W.partitionBy(by, "_block").orderBy(seconds).rangeBetween(-(minutes * 60_000_000 - 1), 0)
    return _framed(attempts, minutes).withColumn(out, F.count("*").over(window)).where("_own").drop("_block", "_own")


def lockouts(attempts: DataFrame, most: int = 10, minutes: int = 15) -> DataFrame:
    """Failed attempts with ``locked``: as many failures as allowed in the last minutes, since the last success."""
    rows = _framed(attempts, minutes)
    rows = rows.withColumn("epoch", F.sum(F.col("success").cast("int")).over(W.partitionBy("username", "_block").orderBy("attempted_at", "attempt_id").rowsBetween(W.unboundedPreceding, -1)))
    failed = rows.where("not success").withColumn("epoch", F.coalesce("epoch", F.lit(0)))
    window = W.partitionBy("username", "_block", "epoch").orderBy(F.unix_micros(F.col("attempted_at").cast("timestamp"))).rangeBetween(-(minutes * 60_000_000 - 1), 0)
    return failed.withColumn("recent", F.count("*").over(window)).withColumn("locked", F.col("recent") >= most).where("_own").drop("_block", "_own", "epoch")


def pruned(rows: DataFrame, at: str, now: Column, keep_minutes: int) -> DataFrame:
    """Rows that are not older than the minutes kept."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(mins=F.lit(keep_minutes)))


def live_sessions(sessions: DataFrame, now: Column, idle_minutes: int) -> DataFrame:
    """Sessions neither expired nor idle for longer than allowed."""
    return pruned(sessions.where(F.col("expires_at") >= now), "last_seen_at", now, idle_minutes)
