"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in one narrow pass. Equal fingerprints are collapsed natively, so a
group of copies costs one row. The distinct ones are packed into tiles: first by the
population counts of their two halves (the stratum), inside a stratum by those of their
quarters. Two fingerprints within the radius have population counts that differ by at most
the radius in sum over any split into parts, so a tile meets only the tiles of strata
within that distance (an equi-join on the stratum), and of those only the ones whose
quarter counts come near enough. Tiles are compared with numpy exclusive-or and bit counts.

A tile pair returns links that join its groups (a forest), never all pairs: each tile
is first split into its own linked groups, then a pair returns one link per two groups.
The groups of all tiles are joined by ``components``, a distributed label contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.lexing import slices
from gatewarden.llm.store import clear, removed, scope, whole, written

SHINGLE, RADIUS, SEED, TILE = 4, 4, 42, 1024
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints; a text without words has zero."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if n <= shingle:
            if n:
                hashes.append(digest(b" ".join(words), SEED))
                sizes[i] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        hashes.extend(digest(joined[s:e], SEED) for s, e in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True))
        sizes[i] = n - shingle + 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    h = np.array(hashes, np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes[some])])
    step = 1 << 16  # shingles at a time: 64 counters each
    for lo in range(0, len(some)):
        a, b = at[lo], at[lo + 1]
        count = np.zeros(64, np.int64)
        for x in range(a, b, step):
            bits = np.unpackbits(h[x : min(b, x + step)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[some[lo]] = np.packbits(2 * count > b - a, bitorder="little").view("<u8")[0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
            more = {c: part.column(c) for c in part.schema.names if c not in ("doc_id", "text")}
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "fp": pa.array(fingerprints_of(texts, shingle).view(np.int64)), **more})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return clear(docs, "doc_id", "text").mapInArrow(lambda it: _fingerprint(it, shingle), "doc_id long, fp long")


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component of each node of a boolean adjacency matrix (its least member)."""
    n = len(linked)
    label = np.arange(n)
    if not linked.any():
        return label
    busy = np.flatnonzero(linked.any(axis=1))
    sub = linked[np.ix_(busy, busy)]
    lab = np.arange(len(busy))
    while True:
        low = np.where(sub, lab[None, :], len(busy)).min(axis=1)
        new = np.minimum(lab, low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        np.minimum.at(new, lab, new.copy())  # hook the old roots too
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    label[busy] = busy[lab]
    return label


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _tile(batches: Iterator[pa.RecordBatch], radius: int, size: int) -> Iterator[pa.RecordBatch]:
    """Tiles of fingerprints that come sorted by stratum and quarters: one row a tile."""
    rest = np.zeros(0, np.int64)

    def tiles(fps: np.ndarray, last: bool) -> tuple[list[dict], np.ndarray]:
        out, at = [], 0
        u = fps.view(np.uint64)
        high, low = np.bitwise_count(u >> np.uint64(32)), np.bitwise_count(u & np.uint64(0xFFFFFFFF))
        key = high.astype(np.int64) * 64 + low
        while at < len(fps):
            stop = min(at + size, at + int(np.searchsorted(key[at : at + size], key[at], side="right")))
            if stop == len(fps) and not last:
                break
            part = u[at:stop]
            q1, q3 = np.bitwise_count(part >> np.uint64(48)), np.bitwise_count((part >> np.uint64(16)) & np.uint64(0xFFFF))
            group = part[_labels(_near(part, part, radius))]
            out.append({"tile": int(fps[at]), "a": int(high[at]), "b": int(low[at]), "q1": int(q1.min()), "q1x": int(q1.max()), "q3": int(q3.min()), "q3x": int(q3.max()), "fps": part.tobytes(), "groups": group.tobytes()})
            at = stop
        return out, fps[at:]

    for batch in batches:
        rows, rest = tiles(np.concatenate([rest, batch.column("fp").to_numpy()]), False)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_TILES)
    rows, _ = tiles(rest, True)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_TILES)


_TILES = pa.schema([("tile", pa.int64()), *[(c, pa.int32()) for c in ("a", "b", "q1", "q1x", "q3", "q3x")], ("fps", pa.binary()), ("groups", pa.binary())])
_TILE_DDL = "tile long, a int, b int, q1 int, q1x int, q3 int, q3x int, fps binary, groups binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, g in zip(batch.column("fps"), batch.column("groups"), strict=True):
            yield pa.record_batch({"fp": pa.array(np.frombuffer(f.as_buffer(), np.int64)), "grp": pa.array(np.frombuffer(g.as_buffer(), np.int64))})


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """One link for each two groups of two tiles that hold near fingerprints."""
    for batch in batches:
        left, right = [], []
        cols = [batch.column(c) for c in ("fps", "groups", "fps2", "groups2")]
        for row in zip(*cols, strict=True):
            f, g, f2, g2 = (np.frombuffer(x.as_buffer(), np.uint64) for x in row)
            i, j = np.nonzero(_near(f, f2, radius))
            if len(i):
                pairs = np.unique(np.stack([g[i], g2[j]], axis=1), axis=0)
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
        if left:
            yield pa.record_batch({"u": pa.array(np.concatenate(left).view(np.int64)), "v": pa.array(np.concatenate(right).view(np.int64))})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the least node reachable, for every node of an edge (u, v).

    Alternates two contractions until only stars remain: every node's larger neighbours are
    hung on its least neighbour, then every node's smaller ones. Each is one aggregation;
    a node's neighbours are never gathered in one row. What they are joined to is written first, so that
    a hub's rows are read from a shuffle on both sides and can be split. A lost executor
    costs at most one round; tables of earlier rounds are removed. Raises if it has not settled after ``max_rounds``.
    """
    with scope() as tables:
        return _contracted(edges, tables, max_rounds)


def _contracted(edges: DataFrame, tables: list[str], max_rounds: int) -> DataFrame:
    e = edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
    for _ in range(max_rounds):
        both = e.unionByName(e.selectExpr("v u", "u v"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m"), "components-low")
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v")
        keep = low.where("m < u").selectExpr("u", "m v")
        e = written(large.unionByName(keep).where("u <> v").distinct(), "components-large")
        small = written(e.groupBy("u").agg(F.min("v").alias("m")), "components-small")
        e = e.join(small, "u").where("v <> m").selectExpr("v u", "m v").unionByName(small.selectExpr("u", "m v")).selectExpr("greatest(u, v) u", "least(u, v) v").where("u <> v").distinct()
        e = written(e, "components")
        removed(edges.sparkSession, tables, keep=1)
        rows, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        # only stars: every node hangs on one root, and no root hangs on anything
        if rows == nodes and not e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi").limit(1).count():
            return e.selectExpr("u node", "v root")
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links of ``radius`` bits.

    A null text counts as empty; texts without words share the fingerprint zero and are
    linked like any other. Repeated rows stay, with equal results. A null doc_id keeps a
    null doc_id and gets the component of its fingerprint (null if no other row has one).
    An empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    return prints.join(_roots(prints, radius, tile), "fp").select("doc_id", "fp", "component_id")


def _roots(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, root, component_id for every fingerprint of a table of doc_id and fp; root names the group and is never null."""
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    bits = lambda lo, n: F.bit_count(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)))
    ordered = distinct.select("fp", bits(32, 32).alias("a"), bits(0, 32).alias("b"), bits(48, 16).alias("q1"), bits(16, 16).alias("q3"))
    keys = ["a", "b", "q1", "q3", "fp"]
    tiles = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("fp").mapInArrow(lambda it: _tile(it, radius, tile), _TILE_DDL)
    tiles = written(tiles, "tiles")
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around]))
    # The pairs of tiles are found on their small columns; contents are joined to the pairs that remain.
    slim = tiles.drop("fps", "groups")
    left = slim.withColumn("s", shifts).selectExpr("tile", "a", "b", "q1", "q1x", "q3", "q3x", "a + s.i ka", "b + s.j kb")
    right = slim.selectExpr("tile tile2", "a ka", "b kb", "q1 r1", "q1x r1x", "q3 r3", "q3x r3x")
    gap = "greatest(0, {0} - {1}, {2} - {3})"  # distance of two ranges
    quarters = [("r1", "q1x", "q1", "r1x"), ("kx", "ax", "an", "kn"), ("r3", "q3x", "q3", "r3x"), ("lx", "bx", "bn", "ln")]
    pairs = left.join(right, ["ka", "kb"]).where("ka > a or (ka = a and kb > b) or (ka = a and kb = b and tile2 > tile)")
    pairs = pairs.selectExpr("*", "ka - r1x kx", "a - q1 ax", "a - q1x an", "ka - r1 kn", "kb - r3x lx", "b - q3 bx", "b - q3x bn", "kb - r3 ln")
    pairs = pairs.where(" + ".join(gap.format(*q) for q in quarters) + f" <= {radius}").select("tile", "tile2")
    content = tiles.select("tile", "fps", "groups")
    pairs = pairs.repartition("tile", "tile2").join(content, "tile").join(content.toDF("tile2", "fps2", "groups2"), "tile2").select("fps", "groups", "fps2", "groups2")
    links = pairs.mapInArrow(lambda it: _links(it, radius), "u long, v long")
    roots = components(written(links.distinct(), "links"))
    member = tiles.select("fps", "groups").mapInArrow(_members, "fp long, grp long")
    grouped = member.join(roots, member.grp == roots.node, "left").selectExpr("fp", "coalesce(root, grp) root").join(distinct, "fp")
    grouped = written(grouped, "groups")
    # written, so that a group with very many fingerprints can be split in the join below
    least = written(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return written(grouped.join(least, "root").select("fp", "root", "component_id"), "roots")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with the columns it came with: that of the least doc_id, then of the least hash.

    Rows without a doc_id come last. Null texts count as empty, and all texts without words are one group. Of rows
    with equal doc_id and text any one stays. Clashing column names stay as they are; an empty table gives no rows.
    """
    named, back = whole(docs, "doc_id", "text")
    # equal for rows of equal doc_id and text only, which are in one group
    key = F.sha2(F.concat(F.coalesce(F.col("k_doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("k_text", F.lit(""))), 256)
    named = named.withColumn("w_key", key)
    rows = named.select(F.col("k_doc_id").alias("doc_id"), F.col("k_text").alias("text"), "w_key")
    prints = written(rows.mapInArrow(lambda it: _fingerprint(it, SHINGLE), "doc_id long, fp long, w_key string"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "w_key")
    first = prints.join(_roots(prints), "fp").groupBy("root").agg(F.min(order).alias("first")).select("first.w_key")
    return back(named.join(first, "w_key", "left_semi").dropDuplicates(["w_key"]))
