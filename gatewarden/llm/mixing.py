"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Sources are leaves of a tree: domain, language, source. The token budget goes down the tree:
at each node it is shared among the children by weight, and what a child cannot use (its leaves'
tokens times the allowed epochs) is shared among its siblings before anything reaches another branch.
A leaf's budget is filled by whole epochs and the prefix of one more, whose order is
a seeded hash of the epoch and the document.

No window or group ever holds a leaf: documents fall into 4,096 buckets of the hash order, sums by
bucket give the one bucket where a prefix ends, and only that one is walked through. The prefix then is
a cut-off by which every document decides for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.store import clear, whole, written

SEED, SHARE, EPOCHS = 17, (3, 5), 2
LEAVES_BROADCAST, SALTS, DIGITS = 100_000, 32, 3
LEVELS = ("domain", "lang", "source")
#: Both Spark and DuckDB read these.
NUMBER = "coalesce(try_cast(nullif(regexp_extract({}, '([0-9]+)$', 1), '') AS INT), 0)"
DOMAIN = f"CASE {NUMBER.format('source')} % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'forums' END"
WEIGHTS = {
    "domain": "CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END",
    "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    "source": f"1 + {NUMBER.format('source')} % 3",
}


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _shared(nodes: DataFrame, level: str, parents: list[str], weight: str) -> DataFrame:
    """Adds ``given``: the parent's ``budget`` shared among children (cap, weight), short ones first."""
    nodes = nodes.withColumn("w", F.expr(weight).cast("long"))
    # a child is short when its fair share of what is left is more than it has; such children come first
    order = W.partitionBy(*parents).orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))), level)
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(after))
    nodes = nodes.withColumn("short", (F.col("w") > 0) & (F.col("cap") * F.col("rest") <= F.col("left") * F.col("w")))
    whole = W.partitionBy(*parents)
    spent = F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(whole), F.lit(0))
    open_w = F.coalesce(F.sum(F.when(~F.col("short"), F.col("w"))).over(whole), F.lit(0))
    nodes = nodes.withColumn("free", F.col("budget") - spent).withColumn("open", open_w)
    given = F.when(F.col("short"), F.col("cap")).when(F.col("open") > 0, F.expr("(free * w) div open")).otherwise(F.lit(0))
    return nodes.withColumn("given", F.least(given, F.col("cap"))).drop("w", "left", "rest", "short", "free", "open")


def budgets(leaves: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf (domain, lang, source, tokens).

    What a leaf can take is its tokens times the epochs; a leaf that has weight 0, or an ancestor that has, can take
    nothing, so its tokens count in no ancestor's share.
    """
    open_ = " and ".join(f"({weights[level]}) > 0" for level in LEVELS)
    level = leaves.withColumn("cap", F.when(F.expr(open_), F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    nodes = level.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(budget).cast("long"))
    up = _shared(nodes, "domain", [], weights["domain"]).select("domain", F.col("given").alias("budget"))
    nodes = level.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(up, "domain")
    up = _shared(nodes, "lang", ["domain"], weights["lang"]).select("domain", "lang", F.col("given").alias("budget"))
    nodes = level.join(up, ["domain", "lang"])
    return _shared(nodes, "source", ["domain", "lang"], weights["source"]).select(*LEVELS, "tokens", F.col("given").alias("budget"))


def _keyed(docs: DataFrame, domain: str) -> DataFrame:
    """Documents with their leaf under clear names (null language or source: empty)."""
    leaf = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens")
    return leaf.withColumn("domain", F.expr(domain))


def _place(epoch: Column, seed: int, doc_id: str = "doc_id") -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15)


def _measured(docs: DataFrame, domain: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, domain of every row, written: the words of a text are counted once."""
    slim = clear(docs, "doc_id", "text", "lang", "source").select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("n_tokens"))
    return written(_keyed(slim, domain), "mix")


def _cutoffs(slim: DataFrame, share: tuple[int, int], epochs: int, seed: int, weights: dict[str, str]) -> DataFrame:
    """domain, lang, source, full (whole epochs), last: the greatest (h, id, n_tokens) of the prefix of epoch ``full`` (or null)."""
    spread = slim.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn("h", _place(F.col("epoch"), seed)).withColumn("bucket", F.substring("h", 1, DIGITS))
    sums = written(spread.groupBy(*LEVELS, "epoch", "bucket").agg(F.sum("n_tokens").alias("n")), "mix-sums")
    leaves = sums.where("epoch = 0").groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    plan = budgets(leaves, share, epochs, weights)
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = written(plan.withColumn("full", full.cast("int")).withColumn("rem", F.col("budget") - F.col("full") * F.col("tokens")), "mix-plan")
    walk = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    part = sums.join(plan.selectExpr(*LEVELS, "full epoch", "rem"), [*LEVELS, "epoch"])
    part = part.withColumn("before", F.coalesce(F.sum("n").over(walk), F.lit(0))).where("before <= rem")
    # the last buckets that begin within the budget: those that end within it are whole
    inner = W.partitionBy(*LEVELS, "bucket").orderBy("h", "id", "n_tokens")
    rows = spread.join(part.select(*LEVELS, "epoch", "bucket", "before", "rem", "n"), [*LEVELS, "epoch", "bucket"]).withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    key = F.struct("h", "id", "n_tokens")
    whole_ones = rows.where("before + n <= rem").groupBy(*LEVELS).agg(F.max(key).alias("last"))
    edge = rows.where("before + n > rem").withColumn("to", F.col("before") + F.sum("n_tokens").over(inner)).where("to <= rem").groupBy(*LEVELS).agg(F.max(key).alias("last"))
    last = whole_ones.unionByName(edge).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    return written(plan.select(*LEVELS, "full").join(last, [*LEVELS], "left"), "mix-cutoffs")


def _chosen(rows: DataFrame, cut: DataFrame, epochs: int, seed: int, words: Column) -> DataFrame:
    """Rows (w_doc_id, w_domain, w_lang, w_source and any others) by epoch in which they are taken: adds w_epoch.

    ``words`` counts a row's tokens; it decides only between rows of one doc_id, and is evaluated for those alone.
    """
    cut = cut.select(*[F.col(c).alias(f"w_{c}") for c in LEVELS], F.col("full").alias("w_full"), F.col("last").alias("w_last"))
    keys = [f"w_{c}" for c in LEVELS]
    if cut.count() <= LEAVES_BROADCAST:
        both = rows.join(F.broadcast(cut), keys)
    else:  # spread a hot leaf over copies of its one row
        both = rows.withColumn("w_salt", F.pmod(F.xxhash64("w_doc_id"), F.lit(SALTS)).cast("int")).join(cut.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "w_salt"])
    both = both.withColumn("w_epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    both = both.withColumn("w_h", _place(F.col("w_epoch"), seed, "w_doc_id"))
    h, i, last = F.col("w_h"), F.coalesce("w_doc_id", F.lit(-1).cast("long")), F.col("w_last")
    prefix = (h < last["h"]) | ((h == last["h"]) & ((i < last["id"]) | ((i == last["id"]) & (words <= last["n_tokens"]))))
    return both.where((F.col("w_epoch") < F.col("w_full")) | ((F.col("w_epoch") == F.col("w_full")) & F.coalesce(prefix, F.lit(False))))


def mixture(docs: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: str = DOMAIN, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: one row for each time a document is taken.

    The budget is ``share`` of all tokens. Null texts have no tokens, null languages and sources are
    empty strings, a null doc_id orders as -1. Repeated rows stand at one place of the order and are taken
    together or not at all. Weight 0 takes nothing, and leaves what it would have had to others. An empty table gives no
    rows; other columns are not read.
    """
    slim = _measured(docs, domain)
    rows = slim.select(*[F.col(c).alias(f"w_{c}") for c in ("doc_id", *LEVELS)], "n_tokens")
    taken = _chosen(rows, _cutoffs(slim, share, epochs, seed, weights), epochs, seed, F.col("n_tokens"))
    return taken.select(*[F.col(f"w_{c}").alias(c) for c in ("doc_id", *LEVELS, "epoch")], "n_tokens")


def mixed_rows(docs: DataFrame, share: tuple[int, int], epochs: int = 1, seed: int = SEED, domain: str = DOMAIN, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """The rows of documents taken, once for each epoch, with the columns they came with.

    Which rows are taken, and what nulls, ties, repeated rows and empty tables give, is as in ``mixture``; columns whose names
    clash stay as they are.
    """
    cut = _cutoffs(_measured(docs, domain), share, epochs, seed, weights)
    rows, back = whole(docs, "doc_id", "text", "lang", "source")
    leaf = rows.select("*", F.coalesce("k_lang", F.lit("")).alias("lang"), F.coalesce("k_source", F.lit("")).alias("source")).withColumn("domain", F.expr(domain))
    named = leaf.withColumnsRenamed({c: f"w_{c}" for c in LEVELS}).withColumn("w_doc_id", F.col("k_doc_id"))
    return back(_chosen(named, cut, epochs, seed, n_tokens(F.col("k_text"))))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(documents: str = "documents", share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, str] = WEIGHTS) -> str:
    """The same choice in DuckDB: leaf windows over all rows."""

    def shared(name: str, source: str, level: str, parents: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        return f"""
{name}_o AS (SELECT *, CAST({weights[level]} AS BIGINT) AS w FROM {source}),
{name}_p AS (SELECT *, budget - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_o WINDOW b AS ({by} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'inf'::DOUBLE END, {level})),
{name}_q AS (SELECT *, w > 0 AND cap * rest <= lft * w AS short FROM {name}_p),
{name} AS (SELECT *, least(cap, CASE WHEN short THEN cap WHEN coalesce(sum(CASE WHEN NOT short THEN w END) OVER ({by}), 0) > 0
  THEN ((budget - coalesce(sum(CASE WHEN short THEN cap END) OVER ({by}), 0)) * w) // sum(CASE WHEN NOT short THEN w END) OVER ({by}) ELSE 0 END) AS given FROM {name}_q)"""

    open_ = " AND ".join(f"({weights[level]}) > 0" for level in LEVELS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
k AS (SELECT *, {DOMAIN} AS domain, coalesce(doc_id, -1) AS id FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CASE WHEN {open_} THEN sum(n_tokens) * {epochs} ELSE 0 END AS cap FROM k GROUP BY domain, lang, source),
total AS (SELECT (sum(tokens) * {share[0]}) // {share[1]} AS budget FROM leaf),
n1 AS (SELECT domain, sum(cap) AS cap, any_value(budget) AS budget FROM leaf, total GROUP BY domain),{shared("g1", "n1", "domain", "")},
n2 AS (SELECT domain, lang, sum(leaf.cap) AS cap, any_value(g1.given) AS budget FROM leaf JOIN g1 USING (domain) GROUP BY domain, lang),{shared("g2", "n2", "lang", "domain")},
n3 AS (SELECT leaf.domain, leaf.lang, leaf.source, leaf.tokens, leaf.cap, g2.given AS budget FROM leaf JOIN g2 USING (domain, lang)),{shared("g3", "n3", "source", "domain, lang")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS "full", given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rem FROM g3),
e AS (SELECT k.*, p."full", p.rem, r.epoch, substr(md5(concat('{seed}:', r.epoch, ':', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS h
  FROM k JOIN plan p USING (domain, lang, source), (SELECT CAST(unnest(range({epochs})) AS INTEGER) AS epoch) r),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h, id, n_tokens) AS upto FROM e)
SELECT doc_id, domain, lang, source, epoch, n_tokens FROM c WHERE epoch < "full" OR (epoch = "full" AND upto <= rem)
"""


SQL = sql()
