"""Exact deduplication by a keyed state on disk.

The state is that of a streaming aggregation in the RocksDB store: for every digest of a text the identifier of the document that
stays, where its content is, and how many rows there were. There is no watermark, so nothing in it ever expires.
A run takes what is new in a table of contents (``contents``), and goes on where the one before ended.

Digests decide nothing alone. On hits, digests with more than one row, the text of each row is compared with the whole text of the row that
stays, which its locator finds. Rows that differ from it are told apart by their texts.

All of it is DataFrame functions: partial aggregates go into the shuffle, so a text that a third of all rows share sends one row a
task; the joins are between tables, whose large partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.store import clear, new_path, written

BLANK = r"[\x20\x09-\x0D]+"
#: A store is closed once its part of a batch is committed, so an executor holds those of its running tasks open, however many parts there are.
STATE_CONF = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
CONTENTS = "doc_id long, digest string, content string, locator long"
GROUPS = "digest string, first struct<last: boolean, doc_id: long, locator: long>, n long"
#: Files of contents that a batch of the stream takes at most.
FILES = 10_000
#: Groups of copies up to this number are sent to all tasks to pick their rows (a digest each); more are joined by shuffling.
SMALL_GROUPS = 50_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized(text: Column) -> Column:
    """The text with every run of blanks as one space; null counts as empty. Texts are equal if these are."""
    return F.coalesce(F.regexp_replace(text, BLANK, " "), F.lit(""))


def contents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, str]:
    """doc_id, digest, content and locator (a number of its own for each row), written; and the path."""
    spark = docs.sparkSession
    rows = clear(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("content"))
    rows = rows.select("doc_id", digest(F.col("content")).alias("digest"), "content", F.monotonically_increasing_id().alias("locator"))
    path = new_path(spark, "contents")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _first() -> list[Column]:
    """The row that stays, as (last, doc_id, locator): the least id, rows without one last; and the number of rows."""
    return [F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "locator")).alias("first"), F.count("*").alias("n")]


def grouped(rows: DataFrame) -> DataFrame:
    """digest, first and n of a table or of a stream of contents; on a stream this is the state that is kept."""
    return rows.select("digest", "doc_id", "locator").groupBy("digest").agg(*_first())


def updates(spark: SparkSession, path: str, schema: str, state: str, out: str) -> None:
    """Takes the contents at a path that the state has not seen yet, and writes the groups that change, a folder a batch.

    ``state`` is the folder of the stream's checkpoint. A batch that is run again after a failure writes its folder anew.
    """
    own = spark.newSession()  # its settings are no other query's
    for k, v in {**STATE_CONF, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)
    grouped(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """digest, first, n as the last batch that changed them left them: the rows of a group only grow, and its first only falls."""
    return spark.read.schema(f"{GROUPS}, batch long").parquet(out).groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def _checked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests that stand for several contents, a row for each row that differs from the one that stays.

    Only rows of digests with several rows are compared, each with the whole content of the row that stays.
    """
    hits = groups.where("n > 1").select("digest", F.col("first.locator").alias("keeper"))
    if hits.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        mine = rows.join(F.broadcast(hits), "digest")
    else:
        mine = rows.join(hits, "digest")
    mine = mine.select("digest", "locator", "keeper", "content")
    kept = mine.where("locator = keeper").select("digest", F.col("content").alias("kept"))
    return mine.where("locator <> keeper").join(kept, "digest").where("content <> kept").select("digest")


def deduplicated(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and text_sha256 of every row.

    Texts are equal if they are after runs of blanks became one space; a null text counts as empty. Of equal texts the row with the least doc_id
    stays, rows without one last, and exactly one of rows with equal doc_id. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows, path = contents(docs, digest)
    state, out = new_path(spark, "digest-state"), new_path(spark, "digest-groups")
    spark.createDataFrame([], GROUPS).write.parquet(f"{out}/batch=-1")
    updates(spark, path, CONTENTS, state, out)
    groups = written(latest(spark, out), "groups")
    # made distinct once written: the join before can then split the rows of a digest
    unlike = written(_checked(rows, groups), "digests-of-several-texts").distinct()
    rows = rows.withColumn("sha", F.col("digest") if digest is sha256 else sha256(F.col("content")))
    if not unlike.limit(1).count():
        return _told(rows, groups, ["digest"])
    # digests that stand for several texts: their rows are grouped by the text itself
    odd = rows.join(unlike, "digest", "left_semi")
    by_text = odd.groupBy("digest", "content").agg(*_first())
    return _told(rows.join(unlike, "digest", "left_anti"), groups, ["digest"]).unionByName(_told(odd, by_text, ["digest", "content"]))


def _told(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    found = rows.join(groups, keys)
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.content) AS text_sha256 FROM t JOIN g USING (content)
"""
