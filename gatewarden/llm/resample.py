"""Importance resampling towards a target: documents drawn by how much their word runs look like the target's.

Features are the runs of one to three words of a text, told by a bucket, the CRC-32 of the run modulo
``BUCKETS``. Two passes read the texts:

1. ``_counted`` counts buckets with ``np.bincount``, one vector of ``BUCKETS`` numbers for each partition, and ``treeReduce``
   adds the vectors up in a tree, so that the driver meets a few of them however many partitions there are.
2. ``_weighed`` gathers each feature's gain from a broadcast vector (``BUCKETS`` numbers) and adds them up by document with
   a weighted ``np.bincount``.

The logarithm of an exponential variable made from the document's id is added to its weight, so the documents with the highest sums
are a draw without replacement in proportion to the weights' exponentials. Ranks are taken by ranges of the score,
each in a task of its own, and the sizes of the ranges before; no task sees all documents.

The CRC of a run is put together from those of its words: the CRC of two strings one after the other is a linear map of
the first's, given by the length of the second, plus the second's. All words of a buffer are taken at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, slices, table, word_spans
from gatewarden.llm.store import clear, written

BUCKETS, RUN, SEED = 10_000, 3, 42
#: Documents of fewer words are weighed but never drawn; the share of the others that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 5
SCALE = 1000
LOWER, INSIDE = table(word=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words of up to so many bytes are appended in one step.
STEP = 64
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _byte_table() -> np.ndarray:
    """What a byte does to a CRC-32 (the reflected polynomial of zlib)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """For n up to STEP, and each byte of a CRC: what n zero bytes after it make of that byte. They are linear, so bytes add up."""
    out = np.zeros((STEP + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, STEP + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _BYTE[out[n - 1] & np.uint32(255)]
    return out.reshape(-1)


_SHIFT = _shift_tables()


def _followed(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part that a string's CRC has in that of the string and ``size`` bytes more."""
    left = size.copy()
    while True:
        step = np.minimum(left, STEP) * 1024
        crc = _SHIFT[step + (crc & 255)] ^ _SHIFT[step + 256 + (crc >> 8 & 255)] ^ _SHIFT[step + 512 + (crc >> 16 & 255)] ^ _SHIFT[step + 768 + (crc >> 24)]
        left = left - STEP
        if not len(left) or left.max() <= 0:
            return crc
        left = np.maximum(left, 0)


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte over all words that still have one."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, size = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    many = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for k, n in enumerate(many.tolist()):
        crc[:n] = _BYTE[(crc[:n] ^ data[begin[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a text column (null: none), and the words of each row."""
    data, offsets = buffer_of(texts)
    starts, ends, row = word_spans(data, offsets, INSIDE)
    words = np.bincount(row, minlength=len(texts))
    one = word_crcs(LOWER[data], starts, ends)
    size, crc, at = ends - starts, one, np.arange(len(one))
    rows, found = [row], [crc % np.uint32(buckets)]
    for k in range(1, run):
        use = np.flatnonzero(at + k < len(one))
        use = use[row[at[use]] == row[at[use] + k]]
        at, crc = at[use], crc[use]
        inverse = crc ^ np.uint32(0xFFFFFFFF)
        spaced = _BYTE[(inverse ^ np.uint32(32)) & np.uint32(255)] ^ (inverse >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        crc = _followed(spaced, size[at + k]) ^ one[at + k]
        rows.append(row[at])
        found.append(crc % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), words


def _counted(batches: Iterator[pa.RecordBatch], buckets: int, run: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            total += np.bincount(features(part.column("text"), buckets, run)[1], minlength=buckets)
    yield pa.record_batch({"counts": pa.array([total.tobytes()], pa.binary())})


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features of all texts by bucket, added up in a tree of tasks."""
    vectors = clear(texts, "text").mapInArrow(lambda it: _counted(it, buckets, run), "counts binary").rdd
    none = np.zeros(buckets, np.int64)
    if not vectors.getNumPartitions():
        return none
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(lambda a, b: a + b, depth=3)


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: the logarithm of how much likelier it is in the target.

    Counts are smoothed by one a bucket, so empty tables have gains too.
    """
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = len(source)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], shared, run: int) -> Iterator[pa.RecordBatch]:
    gain = shared.value
    for batch in batches:
        for part in slices(batch, "text"):
            row, bucket, words = features(part.column("text"), len(gain), run)
            # sums of integers below 2**53 are exact in doubles
            weight = np.bincount(row, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
            number = np.bincount(row, minlength=part.num_rows)
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(number, pa.int64()), "weight": pa.array(weight)})


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """The Gumbel variable of a document, scaled and floored; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Rows of ``w_row``, score and doc_id with their rank, if it is at most ``most``; else null. Ranks go by ranges of the score."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("w_row")]
    # written with the range each row is in, as ranges are drawn from a sample
    ranges = written(rows.repartitionByRange(parts, *order).withColumn("w_range", F.spark_partition_id()), "score-ranges")
    sizes = ranges.groupBy("w_range").agg(F.count("*").alias("w_n"))  # a row a range
    before = sizes.select("w_range", F.coalesce(F.sum("w_n").over(W.orderBy("w_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("w_before"))
    inside = F.row_number().over(W.partitionBy("w_range").orderBy(*order))
    ranked = ranges.withColumn("w_inside", inside).join(F.broadcast(before), "w_range")
    rank = F.col("w_before") + F.col("w_inside")
    return ranked.withColumn("rank", F.when(rank <= most, rank))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1 for the first drawn, null if not drawn) of every document.

    Of the documents with at least ``least_words`` words that percentage is drawn (rounded down), by the highest scores; equal scores go to the smaller
    doc_id, rows without one come last, and of rows with equal doc_id any may come first. Null texts have no words, no features and weight 0. Repeated rows stay and are drawn one by one.
    An empty table gives no rows; an empty target gives weights all the same. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = clear(docs, "doc_id", "text")
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run)))
    rows = docs.mapInArrow(lambda it: _weighed(it, gain, run), WEIGHED)
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("w_row", F.monotonically_increasing_id()), "weights")
    eligible = F.col("n_words") >= least_words
    most = percent * scored.where(eligible).count() // 100
    drawn = _ranked(scored.where(eligible), most).select(*scored.columns, "rank")
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
