"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(64 x) by component, so a dimension is a term and its integer
the term's weight. Rows are put in an order that brings like ones together (nearest of some pivots, then id) and cut into blocks, which
are ranges of that order. A block keeps the largest and least weight of every term and a forward index (its rows'
weights). The bound of a query on a block sums, over terms, the most that term can give. Each task orders the blocks it
holds by bound for every query and scores them through their forward indexes, until the bound
falls below the query's k-th score so far. That score begins at the k-th of a sample of rows, so a task prunes from its first
block on. The k best of all tasks are merged.

The pivots and the first k-th scores come from a sample of bounded size (``SAMPLE`` rows, ``SAMPLE_BYTES``); they decide how much is
pruned, never what is found. Queries are packed by the executors and dealt to sets of about ``QUERY_BYTES``; every set meets every part of the
blocks in a task of its own, all in one job, so neither the driver nor the number of jobs grows with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.store import clear, written

SCALE, TOP, EVERY, BLOCK = 64, 20, 20, 256
QUERY_BYTES, PART_BYTES = 16 << 20, 64 << 20
SAMPLE, SAMPLE_BYTES, PIVOTS = 2048, 8 << 20, 256
#: Largest component that takes part: its integer and any product of two still fit a 64-bit float's integers.
_EXACT32, _EXACT64 = 1 << 24, 1 << 53
_LEAST = np.iinfo(np.int64).min
BLOCKS = "blocks_of int, ids binary, weights binary, terms int, most binary, least binary"
PACKS = "part int, pack int, ids binary, weights binary, terms int, floors binary"
FOUND = "query_id long, vec_id long, score long, blocks long, scored long"
#: Which vectors take part.
WHOLE = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def weights(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer vectors (shorter ones are filled with zeros).

    Null vectors and vectors that hold nulls or numbers that are not finite take no part; integers
    beyond 64 bits are held at the largest ones.
    """
    kind = pa.list_(pa.float64())
    vectors = vectors.cast(kind)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    width = int(sizes[good].max()) if good.any() else 0
    out = np.zeros((len(sizes), width), np.float64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = good[row]
    with np.errstate(over="ignore"):
        out[row[use], place[use]] = np.clip(np.floor(scale * flat[use]), -(2.0**62), 2.0**62)
    return good, out[good].astype(np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b, held within 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = width * float(np.abs(a).max()) * float(np.abs(b).max())
    if most < _EXACT32:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < _EXACT64:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id to blocks of ``size``, with the number of their part."""
    part, ids, rows = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

    def block(i: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        small = np.int16 if not w.size or np.abs(w).max() < 1 << 15 else np.int64
        return pa.record_batch({"blocks_of": pa.array([part], pa.int32()), "ids": pa.array([i.tobytes()], pa.binary()), "weights": pa.array([w.astype(small).tobytes()], pa.binary()), "terms": pa.array([w.shape[1]], pa.int32()), "most": pa.array([w.max(axis=0).tobytes() if w.size else b""], pa.binary()), "least": pa.array([w.min(axis=0).tobytes() if w.size else b""], pa.binary())})

    for batch in batches:
        good, new = weights(batch.column("embedding"), scale)
        width = max(rows.shape[1], new.shape[1])
        rows = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, new)])
        ids = np.concatenate([ids, batch.column("vec_id").cast(pa.int64()).to_numpy(zero_copy_only=False)[good]])
        while len(ids) >= size:
            yield block(ids[:size], rows[:size])
            ids, rows = ids[size:], rows[size:]
    if len(ids):
        yield block(ids, rows)


def _opened(ids: bytes, data: bytes, terms: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(data) == 2 * len(i) * terms else np.int64
    return i, np.frombuffer(data, kind).reshape(len(i), terms).astype(np.int64)


def _fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))


def pivots_of(sample: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """Centres of a sample's rows: a few rounds of moving centres to the mean of what is nearest."""
    centre = sample[:number].astype(np.float64)
    for _ in range(4 if len(sample) > number else 0):
        own = nearest(sample, centre)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def nearest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    if not len(centre):
        return np.zeros(len(rows), np.int64)
    rows = _fitted(rows, centre.shape[1]).astype(np.float64)
    return np.argmin((centre * centre).sum(axis=1)[None, :] - 2 * (rows @ centre.T), axis=1)


def _placed(batches: Iterator[pa.RecordBatch], shared, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with the pivot they are nearest to."""
    _, _, centre = shared.value
    for batch in batches:
        good, w = weights(batch.column("embedding"), scale)
        yield batch.filter(pa.array(good)).append_column("pivot", pa.array(nearest(w, centre), pa.int32()))


def _packs(batches: Iterator[pa.RecordBatch], shared, scale: int, top: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Queries to sets of about ``limit`` bytes, each with the k-th score that the sample gives it."""
    known, rows, _ = shared.value
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        good, w = weights(batch.column("embedding"), scale)
        ids = batch.column("vec_id").cast(pa.int64()).to_numpy(zero_copy_only=False)[good]
        step = max(1, limit // (8 * max(1, w.shape[1]) + 16))
        for a in range(0, len(ids), step):
            i, x = ids[a : a + step], w[a : a + step]
            floors = np.full(len(i), _LEAST)
            for b in range(0, len(i) if len(known) > top else 0, 1024):
                score = inner(x[b : b + 1024], rows)
                score[known[None, :] == i[b : b + 1024, None]] = _LEAST
                floors[b : b + 1024] = np.partition(score, len(known) - top, axis=1)[:, len(known) - top]
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "pack": pa.array([number], pa.int32()), "ids": pa.array([i.tobytes()], pa.binary()), "weights": pa.array([x.tobytes()], pa.binary()), "terms": pa.array([x.shape[1]], pa.int32()), "floors": pa.array([floors.tobytes()], pa.binary())})
            number += 1


def _met(part: pa.Table, packs: pa.Table, top: int) -> pa.Table:
    return pa.Table.from_batches(_search(part, packs, top) if part.num_rows and packs.num_rows else [], _FOUND)


_FOUND = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score", "blocks", "scored")])


def _search(part: pa.Table, packs: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """A set of queries over a part of the blocks."""
    qid, qw, floors = _opened_packs(packs.to_pylist())
    blocks, high, low = [], [], []
    for row in zip(*(part.column(c) for c in ("ids", "weights", "terms", "most", "least")), strict=True):
        ids, data, terms, most, least = (x.as_py() for x in row)
        blocks.append((ids, data, terms))
        high.append(np.frombuffer(most, np.int64))
        low.append(np.frombuffer(least, np.int64))
    width = qw.shape[1]
    high, low = (np.stack([_fitted(v[None, :], width)[0] for v in x]).astype(np.float64) for x in (high, low))
    many = int(np.clip((1 << 22) // len(blocks), 64, 2048))
    for a in range(0, len(qid), many):
        q, own, floor = qw[a : a + many], qid[a : a + many], floors[a : a + many]
        plus, minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        # a little above the true sum, so that rounding never lowers it
        bound = plus @ high.T + minus @ low.T
        bound += np.abs(bound) * 1e-9 + 1
        order = np.argsort(-bound, axis=1)
        best = np.full((len(q), top), _LEAST)
        name = np.full((len(q), top), np.iinfo(np.int64).max)
        full, scored = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        active, step, size = np.arange(len(q)), 0, 1
        while step < len(blocks) and len(active):
            # the bounds of the next blocks against the k-th score so far (ties may still win by their id)
            nxt = order[active, step : step + size]
            kth = np.maximum(floor[active], np.where(full[active] >= top, best[active, top - 1], _LEAST))
            alive = np.take_along_axis(bound[active], nxt, axis=1) >= kth[:, None]
            who, which = active[np.nonzero(alive)[0]], nxt[alive]
            np.add.at(scored, who, 1)
            by = np.argsort(which, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(which[by])) + 1) if len(by) else ():
                rows = who[part]
                ids, w = _opened(*blocks[which[part[0]]])
                score = inner(q[rows], w)
                other = ids[None, :] != own[rows][:, None]
                # only what reaches the k-th score so far, or the k-th best of the block, can count
                least = np.maximum(floor[rows], best[rows, top - 1])
                if len(ids) > top:
                    masked = np.where(other, score, _LEAST)
                    least = np.maximum(least, np.partition(masked, len(ids) - top, axis=1)[:, len(ids) - top])
                r, c = np.nonzero(other & (score >= least[:, None]))
                if not len(r):
                    continue
                old_r, old_c = np.nonzero(np.arange(top)[None, :] < full[rows][:, None])
                all_r = np.concatenate([r, old_r])
                all_s = np.concatenate([score[r, c], best[rows[old_r], old_c]])
                all_n = np.concatenate([ids[c], name[rows[old_r], old_c]])
                o = np.lexsort((all_n, ~all_s, all_r))
                all_r, all_s, all_n = all_r[o], all_s[o], all_n[o]
                rank = np.arange(len(all_r)) - np.searchsorted(all_r, all_r, side="left")
                keep = rank < top
                all_r, rank = all_r[keep], rank[keep]
                best[rows[all_r], rank], name[rows[all_r], rank] = all_s[keep], all_n[keep]
                full[rows] = np.maximum(full[rows], np.bincount(all_r, minlength=len(rows)))
            active = active[alive[:, -1]]  # bounds fall, so later blocks cannot count either
            step, size = step + size, min(size * 2, 64) if step else 1
        r, c = np.nonzero(np.arange(top)[None, :] < full[:, None])
        nothing = np.zeros(len(q), bool)
        yield pa.record_batch([pa.array(own[r]), pa.array(name[r, c]), pa.array(best[r, c]), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64())], schema=_FOUND)
        yield pa.record_batch([pa.array(own), pa.array(own, mask=~nothing), pa.array(own, mask=~nothing), pa.array(np.full(len(q), len(blocks))), pa.array(scored)], schema=_FOUND)


def _opened_packs(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(r["terms"] for r in rows)
    ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
    vectors = [_fitted(np.frombuffer(r["weights"], np.int64).reshape(len(i), r["terms"]), width) for i, r in zip(ids, rows, strict=True)]
    return np.concatenate(ids), np.concatenate(vectors), np.concatenate([np.frombuffer(r["floors"], np.int64) for r in rows])


def _matches(vectors: DataFrame, queries: DataFrame, top: int, scale: int, block: int, query_bytes: int) -> DataFrame:
    """The best of every task for every query, and rows without vec_id that hold the blocks a task has and those it scored."""
    spark = vectors.sparkSession
    rows = clear(vectors, "vec_id", "embedding").where(WHOLE)
    size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    number = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size[1]))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(number).collect()
    _, drawn = weights(pa.array([r.embedding for r in sample], pa.list_(pa.float64())), scale)
    shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in sample], np.int64), drawn, pivots_of(drawn)))
    # parts of bounded size, as a task holds one
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), -(-size[0] * size[1] * 4 // PART_BYTES))
    placed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lambda it: _placed(it, shared, scale), "vec_id long, embedding array<double>, pivot int")
    blocks = placed.repartitionByRange(parts, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id").select("vec_id", "embedding").mapInArrow(lambda it: _blocks(it, scale, block), BLOCKS)
    blocks = written(blocks, "vector-blocks")
    asked = clear(queries, "vec_id", "embedding").where(WHOLE).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    packs = written(asked.mapInArrow(lambda it: _packs(it, shared, scale, top, query_bytes), PACKS), "query-packs")
    packed = packs.agg(F.coalesce(F.sum(F.length("weights") + 2 * F.length("ids")), F.lit(0))).first()[0]
    sets = max(1, -(-packed // query_bytes))
    dealt = F.pmod(F.xxhash64("part", "pack"), F.lit(sets)).cast("int").alias("set")
    asked = packs.select(dealt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("blocks_of"), "ids", "weights", "terms", "floors")
    held = blocks.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return held.groupBy("blocks_of", "set").cogroup(asked.groupBy("blocks_of", "set")).applyInArrow(lambda part, queries: _met(part, queries, top), FOUND)


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, scale: int = SCALE, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` highest scores of each query over all vectors.

    Ties go to the smaller vec_id. A query never finds rows of its own id. Rows with a null id, and vectors that are null or
    hold null or non-finite numbers, take no part; a repeated id among the queries counts once (its least vector), among candidates each row
    counts. Vectors of different lengths are compared over the terms both have. Without queries or vectors there are no rows;
    other columns are not read.
    """
    best = _matches(vectors, queries, top, scale, block, query_bytes).where("vec_id is not null")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def work(vectors: DataFrame, queries: DataFrame, top: int = TOP, scale: int = SCALE, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row: pairs of a query and a block, and how many of them were scored (the others were pruned)."""
    return _matches(vectors, queries, top, scale, block, query_bytes).agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))


def op4_top_scores(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
