"""Near-duplicates by word shingles that are alike by 0.8 or more, told by fingerprints of 512 bits.

SimHash again, compared in tiles (``simhash``), but for another question: not which fingerprints are
within a few bits, but which texts share so many of their distinct five-word shingles that intersection
over union is 0.8 or more. Two fingerprints differ in a bit with the probability that belongs to the
angle between the two sets of shingles: 0.152 at 0.8. Over 64 bits that is 9.7 with a deviation of 2.9,
which cannot tell 0.8 from 0.6; over 512 bits it is 78 with a deviation of 8, so the bit count alone
decides, and no pair's texts have to be looked at again.

The first 64 bits are compared first; only pairs near enough in these have the others counted. Each tile,
and then each pair of tiles, gives links that join its groups, never all pairs, so a group of very many
near copies costs links in proportion to its members. Comparing is quadratic in distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.lexing import slices
from gatewarden.llm.simhash import SEED, components
from gatewarden.llm.store import whole, written

#: Words of a shingle; words of 64 bits of a fingerprint; bits by which near texts differ at most, of all and of the first 64.
SHINGLE, WIDTH, RADIUS, FIRST_RADIUS = 5, 8, 84, 16
#: Fingerprints of a tile, and pairs of tiles in a partition.
TILE, PAIRS = 1 << 15, 8
#: Increment and factors of the splitmix64 generator, which makes further hashes of one.
_STEP, _MUL1, _MUL2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MIX = np.array([i * _STEP % 2**64 for i in range(WIDTH)], np.uint64)
#: Rows and columns compared at a time, candidates looked at at a time, shingles whose bits are counted at a time.
_ROWS, _COLUMNS, _CHUNK, _COUNTED = 256, 2048, 1 << 15, 255


def fingerprint_of(text: bytes) -> bytes:
    """512 bits, 64 bytes: a bit is 1 if it is set in over half the hashes of the distinct shingles. Zero for a text without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return bytes(8 * WIDTH)
    if n <= SHINGLE:
        found = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        found = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: n - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    one = np.unique(np.array(found, np.uint64))
    count = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(one), _COUNTED):  # sums of so few fit in a byte
        x = one[at : at + _COUNTED, None] + _MIX[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MUL1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MUL2)
        x ^= x >> np.uint64(31)
        count += np.add.reduce(np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8 * WIDTH), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(one), bitorder="little").tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
            prints = [fingerprint_of(t) for t in texts]
            ones = pa.array([int.from_bytes(p, "little").bit_count() for p in prints], pa.int32())
            more = {c: part.column(c) for c in part.schema.names if c != "text"}
            yield pa.record_batch({**more, "bits": pa.array(prints, pa.binary()), "ones": ones})


def _joined(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, root: np.ndarray, upper: bool) -> np.ndarray:
    """``root`` of each node once the nodes ``at_a`` and ``at_b`` of near rows of a and b are joined; with ``upper`` only columns from the row on."""
    a0, b0 = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0])
    for r in range(0, len(a), _ROWS):
        for c in range(r if upper else 0, len(b), _COLUMNS):
            near = np.bitwise_count(a0[r : r + _ROWS, None] ^ b0[None, c : c + _COLUMNS]) <= FIRST_RADIUS
            i, j = np.nonzero(near)
            i, j = i + r, j + c
            while len(i):
                apart = root[at_a[i]] != root[at_b[j]]  # what is joined already needs no look
                i, j = i[apart], j[apart]
                x, y = i[:_CHUNK], j[:_CHUNK]
                i, j = i[_CHUNK:], j[_CHUNK:]
                linked = np.bitwise_count(a[x] ^ b[y]).sum(axis=1, dtype=np.int64) <= RADIUS
                u, v = at_a[x[linked]], at_b[y[linked]]
                while len(u):
                    p, q = root[u], root[v]
                    open_ones = p != q
                    u, v, p, q = u[open_ones], v[open_ones], p[open_ones], q[open_ones]
                    np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                    while (root[root] != root).any():
                        root = root[root]
    return root


def _tiled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Tiles of rows that come sorted by bucket: one row a tile, with the group of each of its fingerprints (a number of its own among all tiles)."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    made, bucket, bits, ones = 0, None, [], []

    def tile() -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, WIDTH)
        own = np.arange(len(prints))
        groups = _joined(prints, prints, own, own, own.copy(), True) + (base + made)
        return pa.RecordBatch.from_pylist([{"tile": base + made, "lo": min(ones), "hi": max(ones), "prints": prints.tobytes(), "groups": groups.astype("<i8").tobytes()}], schema=_TILES)

    for batch in batches:
        for k, p, n in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), batch.column("ones").to_pylist(), strict=True):
            if bits and (k != bucket or len(bits) == size):
                yield tile()
                made, bits, ones = made + len(bits), [], []
            bucket = k
            bits.append(p)
            ones.append(n)
    if bits:
        yield tile()


_TILES = pa.schema([("tile", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("prints", pa.binary()), ("groups", pa.binary())])
_TILE_DDL = "tile long, lo int, hi int, prints binary, groups binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, g in zip(batch.column("prints").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            yield pa.record_batch({"bits": pa.array([p[i : i + 8 * WIDTH] for i in range(0, len(p), 8 * WIDTH)], pa.binary()), "grp": pa.array(np.frombuffer(g, "<i8"))})


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the groups of two tiles; the tiles of a pair come one after the other."""
    held = None
    for batch in batches:
        for row in batch.select(["tile", "tile2", "prints", "groups"]).to_pylist():
            if held is None or (held["tile"], held["tile2"]) != (row["tile"], row["tile2"]):
                held = row
                continue
            a, b = (np.frombuffer(r["prints"], np.uint64).reshape(-1, WIDTH) for r in (held, row))
            g, h = (np.frombuffer(r["groups"], "<i8") for r in (held, row))
            held = None
            names, node = np.unique(np.concatenate([g, h]), return_inverse=True)
            root = _joined(a, b, node[: len(g)], node[len(g) :], np.arange(len(names)), False)
            hung = np.flatnonzero(root != np.arange(len(names)))
            if len(hung):
                yield pa.record_batch({"u": pa.array(names[hung]), "v": pa.array(names[root[hung]])})


def first_of_groups(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """The least ``key`` of each group of near-duplicates among rows of text and key (any type that has an order).

    A null text counts as empty; texts without words are one group. An empty table gives no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.select("key").schema["key"].dataType.simpleString()
    prints = rows.select("key", "text").mapInArrow(_fingerprints, f"key {kind}, bits binary, ones int")
    # copies are one row from here on, put together before they are shuffled
    distinct = written(prints.groupBy("bits", "ones").agg(F.min("key").alias("first")), "alike-prints")
    # one row for each number of ones, 513 at most: rows of few such numbers share a bucket, a frequent number is dealt over several
    before = F.sum("n").over(W.orderBy("ones")) - F.col("n")
    tally = distinct.groupBy("ones").agg(F.count("*").alias("n")).select("ones", F.floor(before / tile).alias("base"), F.ceil(F.col("n") / tile).alias("span"))
    dealt = distinct.join(F.broadcast(tally), "ones").select((F.col("base") + F.pmod(F.xxhash64("bits"), F.col("span"))).alias("bucket"), "ones", "bits")
    tiles = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ones", "bits").mapInArrow(lambda it: _tiled(it, tile), _TILE_DDL)
    tiles = written(tiles, "alike-tiles")
    # a pair is told at the tile with fewer ones: the other's least number of ones is at most the radius beyond its greatest
    step = RADIUS + 1
    left = tiles.select("tile", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi + {RADIUS}) div {step}"))).alias("band"))
    right = tiles.select(F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.expr(f"lo div {step}").alias("band"))
    pairs = left.join(right, "band").where(f"(lo2 > lo or (lo2 = lo and tile2 > tile)) and lo2 <= hi + {RADIUS}").select("tile", "tile2")
    pairs = written(pairs, "alike-pairs")
    content = tiles.select(F.col("tile").alias("member"), "prints", "groups")
    both = pairs.select("tile", "tile2", F.explode(F.array("tile", "tile2")).alias("member")).join(content, "member")
    # few pairs in a partition, as their contents are held in one batch
    both = both.repartition(max(parts, -(-pairs.count() // PAIRS)), "tile", "tile2").sortWithinPartitions("tile", "tile2")
    roots = components(written(both.mapInArrow(_links, "u long, v long"), "alike-links"))
    member = tiles.select("prints", "groups").mapInArrow(_members, "bits binary, grp long")
    grouped = member.join(roots, F.col("grp") == F.col("node"), "left").select("bits", F.coalesce("root", "grp").alias("root"))
    return grouped.join(distinct, "bits").groupBy("root").agg(F.min("first").alias("key")).select("key")


def one_of_each(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row of each near-duplicate group, with the columns it came with: that of the least doc_id, then of the least hash.

    Groups are what links of near texts join. Rows without a doc_id come last. Null texts count as empty, and all texts
    without words are one group. Of rows with equal doc_id and text any one stays. Clashing column names stay as they are;
    an empty table gives no rows.
    """
    named, back = whole(docs, "doc_id", "text")
    # equal for rows of equal doc_id and text only, which are in one group
    digest = F.sha2(F.concat(F.coalesce(F.col("k_doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("k_text", F.lit(""))), 256)
    named = named.withColumn("w_key", digest)
    order = F.struct(F.col("k_doc_id").isNull().alias("last"), F.col("k_doc_id").cast("long").alias("doc_id"), "w_key")
    first = first_of_groups(named.select(F.col("k_text").alias("text"), order.alias("key")), tile).select("key.w_key")
    return back(named.join(first, "w_key", "left_semi").dropDuplicates(["w_key"]))
