"""Ranked lexical search by a hierarchical tree of maxima over document ranges.

Documents are cut, as they come, into chunks of about ``CHUNK_BYTES`` of text. The index of a chunk holds for every term its postings
(document and gain) and a tree over ranges of the chunk's documents: each node covers ``FAN`` nodes of the level
below and holds the term's largest gain there; the root covers the chunk. The gain of a posting is the score of the document for
the term but for the term's weight, which is a factor.

A search descends best first: of all open nodes those with the highest sum of weighted maxima are opened, until
no bound reaches the k-th score. Nodes whose bound equals it are opened too, as a document there may win by its id. The roots of all
chunks are the uppermost level: every item's best chunk is searched before the others, and its k-th score there is where
the search of all chunks begins, so most chunks are left at their root.

Items are packed by hash into packs of about ``PACK_BYTES`` of text; a chunk meets a pack by a join, so neither the driver nor a
broadcast grows with the benchmark. Terms are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, prefix_hash, runs, slices, span_hash, table, word_spans
from gatewarden.llm.store import clear, written
from gatewarden.llm.suffixes import packed, unpacked

TOP, FAN_BITS, BEAM = 10, 4, 16
CHUNK_BYTES, PACK_BYTES = 4 << 20, 1 << 20
#: Chosen chunks up to this number are sent to all tasks (a few numbers each).
SMALL_CHOICES = 20_000
#: Chunks are dealt to so many copies of a pack, if there are several packs.
COPIES = 64
LOWER, INSIDE = table(word=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
INDEX = "chunk long, docs binary, missing binary, terms binary, df binary, root binary, counts array<binary>, nodes array<binary>, most array<binary>"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of a text column; null has none."""
    data, offsets = buffer_of(texts)
    starts, ends, row = word_spans(data, offsets, INSIDE)
    return row, span_hash(prefix_hash(LOWER[data]), starts, ends)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffer_of(part.column("text"))
            _, _, row = word_spans(data, offsets, INSIDE)
            total += len(row)
            n += len(runs(row))
    yield pa.record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})


class Chunk:
    """The index of a chunk. Levels from 0 (postings) up: keys (term << 32 | node), in order, and the largest gain of each."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, terms: np.ndarray, keys: list[np.ndarray], most: list[np.ndarray]) -> None:
        self.ids, self.missing, self.terms, self.keys, self.most = ids, missing, terms, keys, most

    @classmethod
    def of(cls, ids: np.ndarray, missing: np.ndarray, row: np.ndarray, hashes: np.ndarray, n: int, total: int) -> Chunk:
        """From the terms of documents; ``n`` and ``total`` are the documents and terms of all chunks."""
        size = np.bincount(row, minlength=len(ids))
        order = np.lexsort((row, hashes))
        h, r = hashes[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(h)))
        h, r = h[first], r[first]
        gain = 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * size[r] * n // max(1, total)))
        terms, term = np.unique(h, return_inverse=True)
        keys, most = [term.astype(np.int64) << 32 | r], [gain]
        while len(terms) and (len(keys) == 1 or (keys[-1] & 0xFFFFFFFF).any()):
            node = keys[-1] >> 32 << 32 | (keys[-1] & 0xFFFFFFFF) >> FAN_BITS
            at = runs(node)
            keys.append(node[at])
            most.append(np.maximum.reduceat(most[-1], at))
        return cls(ids, missing, terms, keys, most)

    def row(self, chunk: int) -> pa.RecordBatch:
        counts = [np.bincount(k >> 32, minlength=len(self.terms)).astype(np.uint32) for k in self.keys]
        lists = {
            "counts": [packed(c) for c in counts],
            "nodes": [packed((k & 0xFFFFFFFF).astype(np.uint32)) for k in self.keys],
            "most": [packed(m.astype(np.uint32)) for m in self.most],
        }
        flat = {"docs": packed(self.ids), "missing": packed(self.missing.astype(np.uint8)), "terms": packed(self.terms), "df": packed(counts[0]), "root": packed(self.most[-1].astype(np.uint32))}
        return pa.record_batch({"chunk": pa.array([chunk], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in flat.items()}, **{k: pa.array([v], pa.list_(pa.binary())) for k, v in lists.items()}})

    @classmethod
    def read(cls, row: dict) -> Chunk:
        terms = unpacked(row["terms"], "<u8")
        term = np.arange(len(terms), dtype=np.int64) << 32
        counts = [unpacked(c, "<u4") for c in row["counts"]]
        keys = [np.repeat(term, c) | unpacked(x, "<u4").astype(np.int64) for c, x in zip(counts, row["nodes"], strict=True)]
        return cls(unpacked(row["docs"], "<i8"), unpacked(row["missing"], "<u1").astype(bool), terms, keys, [unpacked(m, "<u4").astype(np.int64) for m in row["most"]])

    def search(self, term: np.ndarray, weight: np.ndarray, floor: int, top: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their numbers in the chunk) and scores of the ``top`` best of at least ``floor``, ties by id.

        ``work``, if given, gets the number of nodes opened.
        """
        level = len(self.keys) - 1
        bound = int((weight * self._most(level, term)).sum())
        opened, open_level, open_node, open_bound = 0, np.array([level]), np.array([0]), np.array([bound])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(open_bound):
            alive = open_bound >= floor
            open_level, open_node, open_bound = open_level[alive], open_node[alive], open_bound[alive]
            if not len(open_bound):
                break
            best = int(np.argmax(open_bound))
            level = int(open_level[best])
            same = np.flatnonzero(open_level == level)
            if len(same) > BEAM:
                same = same[np.argpartition(-open_bound[same], BEAM)[:BEAM]]
            nodes = open_node[same]
            opened += len(nodes)
            rest = np.ones(len(open_bound), bool)
            rest[same] = False
            open_level, open_node, open_bound = open_level[rest], open_node[rest], open_bound[rest]
            below, sums = self._below(level - 1, nodes, term, weight)
            good = sums >= floor
            below, sums = below[good], sums[good]
            if level > 1:
                open_level = np.concatenate([open_level, np.full(len(below), level - 1)])
                open_node, open_bound = np.concatenate([open_node, below]), np.concatenate([open_bound, sums])
                continue
            docs, scores = np.concatenate([docs, below]), np.concatenate([scores, sums])
            order = np.lexsort((self.ids[docs], self.missing[docs], -scores))[:top]
            docs, scores = docs[order], scores[order]
            if len(scores) == top:
                floor = max(floor, int(scores[-1]))
        if work is not None:
            work.append(opened)
        return docs, scores

    def _most(self, level: int, term: np.ndarray) -> np.ndarray:
        """The largest gain of each term; at the top level a term has one node."""
        return self.most[level][np.searchsorted(self.keys[level], term << 32)]

    def _below(self, level: int, nodes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a level below others, with their sums of weighted maxima."""
        low = (term[:, None] << 32 | nodes[None, :] << FAN_BITS).ravel()
        a = np.searchsorted(self.keys[level], low)
        many = np.searchsorted(self.keys[level], low + (1 << FAN_BITS)) - a
        at = np.arange(many.sum()) + np.repeat(a - np.cumsum(many) + many, many)
        slot = np.repeat(np.tile(np.arange(len(nodes)), len(term)), many) << FAN_BITS | self.keys[level][at] & (1 << FAN_BITS) - 1
        worth = np.repeat(np.repeat(weight, len(nodes)), many) * self.most[level][at]
        # sums of integers below 2**53 are exact in doubles
        sums = np.bincount(slot, weights=worth, minlength=len(nodes) << FAN_BITS).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot, minlength=len(sums)))
        return nodes[some >> FAN_BITS] << FAN_BITS | some & (1 << FAN_BITS) - 1, sums[some]


def _chunks(batches: Iterator[pa.RecordBatch], n: int, total: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    number, held, size, docs = TaskContext.get().partitionId() << 32, [], 0, 0

    def made() -> pa.RecordBatch:
        ids, missing, row, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        return Chunk.of(ids, missing, row, hashes, n, total).row(number)

    for batch in batches:
        for part in slices(batch, "text"):
            row, hashes = terms_of(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), row + docs, hashes))
            size, docs = size + 6 * len(hashes), docs + part.num_rows
            if size >= chunk_bytes:
                yield made()
                number, held, size, docs = number + 1, [], 0, 0
    if held:
        yield made()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, hashes = terms_of(part.column("text"))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            terms = [np.unique(hashes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch({"pack": part.column("pack"), "item": part.column("item"), "terms": pa.array(terms, pa.binary())})


class Pack:
    """Items with their terms: ``item`` numbers, ``own`` the item of each term, ``term`` its place in ``known``."""

    def __init__(self, items: list[dict]) -> None:
        items = sorted((x for x in items if x["terms"]), key=lambda x: x["item"])
        self.item = np.array([x["item"] for x in items], np.int64)
        each = [np.frombuffer(x["terms"], np.uint64) for x in items]
        self.own = np.repeat(np.arange(len(items)), [len(x) for x in each])
        self.known, self.term = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
        self.weight, self.floor = np.zeros(len(self.known), np.int64), np.ones(len(items), np.int64)

    def weighed(self, df: list[dict], n: int) -> Pack:
        number = np.zeros(len(self.known))
        for x in df:
            number[x["place"]] = x["df"]
        self.weight = np.floor(1000 * np.log((2 * n + 2) / (2 * number + 1))).astype(np.int64)
        return self

    def floors(self, known: list[dict] | None) -> Pack:
        for x in known or ():
            self.floor[np.searchsorted(self.item, x["item"])] = max(1, x["floor"])
        return self

    def met(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (item, term) pairs have a term of the chunk, and its number there."""
        at = np.searchsorted(terms, self.known)
        at[at == len(terms)] = 0
        hit = terms[at] == self.known if len(terms) else np.zeros(len(self.known), bool)
        pairs = np.flatnonzero(hit[self.term])
        return pairs, at[self.term[pairs]]

    def bounds(self, pairs: np.ndarray, term: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The bound of each item at the root of a chunk."""
        return np.bincount(self.own[pairs], weights=self.weight[self.term[pairs]] * root[term], minlength=len(self.item)).astype(np.int64)


def _packs(batch: pa.RecordBatch, held: dict[int, Pack], n: int) -> Iterator[tuple[dict, Pack]]:
    """Rows of an index joined with packs, each with its pack; the last packs are kept."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        number = row.column("pack")[0].as_py()
        if number not in held:
            if len(held) > 8:
                held.pop(next(iter(held)))
            pack = Pack(row.column("items")[0].as_py())
            names = row.schema.names
            held[number] = pack.weighed(row.column("df_known")[0].as_py() if "df_known" in names else [], n).floors(row.column("floors")[0].as_py() if "floors" in names else None)
        skip = ("pack", "items", "df_known", "floors")
        yield {c: row.column(c)[0].as_py() for c in row.schema.names if c not in skip} | {"pack": number}, held[number]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts = {}, {}
    for batch in batches:
        for row, pack in _packs(batch, held, 0):
            terms = unpacked(row["terms"], "<u8")
            at = np.searchsorted(terms, pack.known)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == pack.known) if len(terms) else np.zeros(0, np.int64)
            total = counts.setdefault(row["pack"], np.zeros(len(pack.known), np.int64))
            total[hit] += unpacked(row["df"], "<u4")[at[hit]]
    for number, total in counts.items():
        some = np.flatnonzero(total)
        yield pa.record_batch({"pack": pa.array(np.full(len(some), number), pa.int32()), "place": pa.array(some), "df": pa.array(total[some])})


def _best_roots(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held, best = {}, {}
    for batch in batches:
        for row, pack in _packs(batch, held, n):
            pairs, term = pack.met(unpacked(row["terms"], "<u8"))
            bound = pack.bounds(pairs, term, unpacked(row["root"], "<u4").astype(np.int64))
            most, where = best.setdefault(row["pack"], (np.zeros(len(pack.item), np.int64), np.zeros(len(pack.item), np.int64)))
            better = bound > most
            most[better], where[better] = bound[better], row["chunk"]
            best[row["pack"]] = most, where
    for number, (most, where) in best.items():
        some = np.flatnonzero(most)
        yield pa.record_batch({"pack": pa.array(np.full(len(some), number), pa.int32()), "i": pa.array(some), "bound": pa.array(most[some]), "chunk": pa.array(where[some])})


FOUND = "item long, missing boolean, doc_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], n: int, top: int) -> Iterator[pa.RecordBatch]:
    """The best of a task for every item. Rows with ``only`` search for those items (their places in the pack) alone."""
    held, best = {}, {}
    for batch in batches:
        for row, pack in _packs(batch, held, n):
            chunk, own = Chunk.read(row), best.setdefault(row["pack"], {})
            if not len(chunk.terms):
                continue
            pairs, term = pack.met(chunk.terms)
            bound = pack.bounds(pairs, term, chunk.most[-1])
            cuts = np.searchsorted(pack.own[pairs], np.arange(len(pack.item) + 1))
            for i in row["only"] if row.get("only") is not None else np.flatnonzero(bound >= pack.floor).tolist():
                name = int(pack.item[i])
                known = own.get(name)
                floor = max(int(pack.floor[i]), known[0][-1] if known and len(known[0]) == top else 1)
                if bound[i] < floor:
                    continue
                a, b = cuts[i], cuts[i + 1]
                docs, scores = chunk.search(term[a:b], pack.weight[pack.term[pairs[a:b]]], floor, top)
                if not len(docs):
                    continue
                score, missing, ids = scores, chunk.missing[docs], chunk.ids[docs]
                if known:
                    score, missing, ids = (np.concatenate(x) for x in zip(known, (score, missing, ids), strict=True))
                order = np.lexsort((ids, missing, -score))[:top]
                own[name] = score[order], missing[order], ids[order]
    for own in best.values():
        for name, (score, missing, ids) in own.items():
            yield pa.record_batch({"item": pa.array(np.full(len(ids), name), pa.int64()), "missing": pa.array(missing), "doc_id": pa.array(ids, mask=missing), "score": pa.array(score)})


def _joined(chunks: DataFrame, packs: DataFrame, number: int) -> DataFrame:
    """Every chunk with every pack, by an equi-join: one pack is of bounded size and goes to all tasks, several are dealt in copies."""
    copies = 1 if number == 1 else COPIES
    left = chunks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("copy", F.pmod(F.xxhash64("chunk"), F.lit(copies)))
    right = packs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    return left.join(F.broadcast(right) if number == 1 else right, ["pack", "copy"]).drop("copy")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, chunk_bytes: int = CHUNK_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item, with a score above 0.

    Equal scores go to the smaller doc_id, rows without one come last; each row of a repeated document, and of a repeated item, counts for itself. Null texts have
    no terms: such items find nothing, such documents are not found and do not count. Without documents or items there are no rows. Other columns are not read.
    """
    docs = clear(docs, "doc_id", "text")
    items = written(clear(items, "item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    size = docs.select("text").mapInArrow(_sizes, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    n, total = size
    index = written(docs.mapInArrow(lambda it: _chunks(it, n, total, chunk_bytes), INDEX), "lexical-index")
    number = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pack_bytes))
    own = items.select(F.pmod(F.xxhash64("item"), F.lit(number)).cast("int").alias("pack"), "item", "text").mapInArrow(_item_terms, "pack int, item long, terms binary")
    packs = written(own.groupBy("pack").agg(F.collect_list(F.struct("item", "terms")).alias("items")), "item-packs")
    df = _joined(index.select("chunk", "terms", "df"), packs, number).mapInArrow(_document_counts, "pack int, place long, df long")
    df = df.groupBy("pack", "place").agg(F.sum("df").alias("df")).groupBy("pack").agg(F.collect_list(F.struct("place", "df")).alias("df_known"))
    packs = written(packs.join(df, "pack"), "weighed-packs")
    # every item's chunk with the highest bound, searched first
    roots = _joined(index.select("chunk", "terms", "root"), packs, number).mapInArrow(lambda it: _best_roots(it, n), "pack int, i long, bound long, chunk long")
    chosen = roots.groupBy("pack", "i").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk")).groupBy("chunk", "pack").agg(F.collect_list("i").alias("only"))
    chosen = written(chosen, "chosen-chunks")
    few = chosen.limit(SMALL_CHOICES + 1).count() <= SMALL_CHOICES
    ahead = index.join(F.broadcast(chosen) if few else chosen, "chunk")
    ahead = ahead.join(F.broadcast(packs) if number == 1 else packs, "pack").mapInArrow(lambda it: _search(it, n, top), FOUND)
    kth = _best(ahead, top).where(F.col("rank") == top).select("item", F.col("score").alias("floor"))
    kth = kth.groupBy(F.pmod(F.xxhash64("item"), F.lit(number)).cast("int").alias("pack")).agg(F.collect_list(F.struct("item", "floor")).alias("floors"))
    begun = written(packs.join(kth, "pack", "left"), "packs-with-floors")
    found = _best(_joined(index, begun, number).mapInArrow(lambda it: _search(it, n, top), FOUND), top)
    return found.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _best(found: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "missing", "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH w AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
t AS (SELECT term, floor(1000 * ln((2 * (SELECT big_n FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * big_n) // big_l)))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN tf USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
