"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hash of its 8-word grams in every 6 consecutive grams,
so any 13 consecutive words shared by two texts share a fingerprint. Items of fewer than 13
words are one window each; for the lengths that occur among them every gram of that length is kept
(a winnowing window of one), so those are found as surely. Fingerprints of documents and
items are joined, and every hit is extended in both directions, word by word. Every window has a
fingerprint of its own, so a hit is extended no further than the windows around its gram reach; spans
that reach the window length count. Places of the benchmark that look alike that far are one entry of the index, so that
repeated words cost no more than others.

Joining: a benchmark of at most ``BROADCAST_BYTES`` of text (measured first) becomes an
index that every task holds, and documents are read in one narrow pass. A larger one is joined
by shuffling: a row's fingerprints are kept if any item has them (a semi-join), the windows that reach over what is kept are
looked up among the distinct windows of all items, and windows that the same items have are one set. So a row meets each
of its windows once, however many items share it, and items are named once for all rows that hit the same
sets. Both ways judge each row by its own text and give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, mixed, prefix_hash, runs, slices, span_hash, table, window_argmin, word_spans
from gatewarden.llm.store import clear, whole, written

WINDOW, GRAM, SHARE = 13, 8, 20
BROADCAST_BYTES = 8 << 20
#: Pairs of a place in a text and an entry of the index that are extended together.
PAIRS = 1 << 17
LOWER, INSIDE = table(word=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Words:
    """Word hashes of many texts: ``hashes`` in order, ``first`` the index of each text's first word."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = buffer_of(texts)
        starts, ends, row = word_spans(data, offsets, INSIDE)
        self.hashes = span_hash(prefix_hash(LOWER[data]), starts, ends)
        self.row = row
        self.counts = np.bincount(row, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all k-word grams within single texts, and their hashes."""
        at = np.arange(max(0, len(self.hashes) - k + 1))
        at = at[self.row[at] == self.row[at + k - 1]] if len(at) else at
        return at, span_hash(prefix_hash(self.hashes), at, at + k)

    def winnowed(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the fingerprints of texts of at least ``window`` words."""
        if len(self.hashes) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        every = np.arange(len(self.hashes) - gram + 1)
        hashes = span_hash(prefix_hash(self.hashes), every, every + gram)
        at = window_argmin(hashes, window - gram + 1)
        begin = np.arange(len(at))
        at = (at + 0)[self.row[begin] == self.row[begin + window - 1]]
        at = at[runs(at)]
        return at, hashes[at]


class Index:
    """Fingerprints of benchmark items, with the words to extend hits by."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        words = Words(pa.array(texts, pa.large_string()))
        seen: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        parts, self.first, self.size = [], [], []
        at = 1
        for i, item in enumerate(ids):  # items of equal words are one
            h = words.hashes[words.first[i] : words.first[i + 1]]
            if not len(h) or item is None:
                continue
            key = h.tobytes()
            if key in seen:
                self.ids[seen[key]].append(str(item))
                continue
            seen[key] = len(self.ids)
            self.ids.append([str(item)])
            parts += [np.array([len(seen)], np.uint64), h]  # a border before each item
            self.first.append(at)
            self.size.append(len(h))
            at += len(h) + 1
        self.hashes = np.concatenate([*parts, np.zeros(window, np.uint64)])
        self.first, self.size = np.array(self.first, np.int64), np.array(self.size, np.int64)
        self.item = np.full(len(self.hashes), -1, np.int64)
        for i, (f, n) in enumerate(zip(self.first, self.size, strict=True)):
            self.item[f : f + n] = i
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.place, self.names = np.zeros(0, np.int64), [np.zeros((0, 2), np.int64)]
        long = np.flatnonzero(self.size >= window)
        prefix = prefix_hash(self.hashes)
        if len(long):
            found = []
            for i in long:
                f, n = self.first[i], self.size[i]
                at = np.arange(f, f + n - gram + 1)
                h = span_hash(prefix, at, at + gram)
                found.append(at[np.unique(window_argmin(h, window - gram + 1))])
            self._add(0, np.concatenate(found), gram, window, prefix)
        for n in np.unique(self.size[self.size < window]):
            self._add(int(n), self.first[self.size == n], int(n), int(n), prefix)
        names = np.concatenate(self.names)
        self.names = names[np.argsort(names[:, 0], kind="stable")]

    def _add(self, kind: int, at: np.ndarray, k: int, window: int, prefix: np.ndarray) -> None:
        """Entries: places that are equal as far as windows around their gram reach, with the items that have them."""
        around = at[:, None] + np.arange(k - window, window)
        own = self.item[np.clip(around, 0, len(self.item) - 1)] == self.item[at][:, None]
        own &= (around >= 0) & (around < len(self.item))
        look = np.where(own, self.hashes[np.where(own, around, 0)], np.uint64(0))
        _, first, inverse = np.unique(np.concatenate([look, own.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
        self.names.append(np.unique(np.stack([inverse.ravel() + len(self.place), self.item[at]], 1), axis=0))
        entry = np.arange(len(first)) + len(self.place)
        self.place = np.concatenate([self.place, at[first]])
        h = span_hash(prefix, at[first], at[first] + k)
        order = np.argsort(h, kind="stable")
        self.grams[kind] = (h[order], entry[order])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Shared spans: words hit (boolean, by word) and distinct (row, item) pairs."""
        hit = np.zeros(len(words.hashes) + 1, np.int64)
        pairs = np.zeros((0, 2), np.int64)
        for kind, (known, entry) in self.grams.items():
            at, h = words.grams(kind) if kind else words.winnowed(self.window, self.gram)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            some = np.flatnonzero(high > low)
            upto = np.cumsum(high[some] - low[some])
            a = 0
            while a < len(some):  # bounds the memory of frequent grams
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
                part = some[a:b]
                count = high[part] - low[part]
                p = np.repeat(at[part], count)
                e = entry[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[part], count)]
                found = self._extend(words, p, e, kind or self.gram, kind or self.window, hit)
                pairs = np.unique(np.concatenate([pairs, found]), axis=0)
                a = b
        low, high = np.searchsorted(self.names[:, 0], pairs[:, 1], "left"), np.searchsorted(self.names[:, 0], pairs[:, 1], "right")
        count = high - low
        item = self.names[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count), 1]
        return np.cumsum(hit[:-1]) > 0, np.unique(np.stack([np.repeat(pairs[:, 0], count), item], 1), axis=0)

    def _extend(self, words: Words, p: np.ndarray, entry: np.ndarray, gram: int, need: int, hit: np.ndarray) -> np.ndarray:
        q = self.place[entry]
        row, item, most = words.row[p], self.item[q], len(words.hashes) - 1
        first, last = words.first[row], words.first[row + 1]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        go = np.ones(len(p), bool)
        for k in range(need):
            go = go & (p + k < last) & (self.item[q + k] == item) & (words.hashes[np.minimum(p + k, most)] == self.hashes[q + k])
            right += go
        go = right >= gram
        for k in range(1, need - gram + 1):
            go = go & (p - k >= first) & (self.item[q - k] == item) & (words.hashes[p - k] == self.hashes[q - k])
            left += go
        good = left + right >= need
        np.add.at(hit, (p - left)[good], 1)
        np.add.at(hit, (p + right)[good], -1)
        return np.unique(np.stack([row[good], entry[good]], 1), axis=0)


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _spread(rows: int, pairs: np.ndarray, ids: list[list[str]]) -> list[set[str]]:
    names: list[set[str]] = [set() for _ in range(rows)]
    for r, i in pairs.tolist():
        names[r].update(ids[i])
    return names


def _rows(part: pa.RecordBatch, words: Words, hit: np.ndarray, pairs: np.ndarray, ids: list[list[str]]) -> pa.RecordBatch:
    names = _spread(part.num_rows, pairs, ids)
    return _judged(part.column("doc_id"), words, np.bincount(words.row[hit], minlength=part.num_rows), [len(x) for x in names], [_digest(x) if x else None for x in names])


def _judged(doc_id: pa.Array, words: Words, n_hit: np.ndarray, n_items: list, digests: list) -> pa.RecordBatch:
    nothing = _digest([])
    return pa.record_batch({
        "doc_id": doc_id.cast(pa.int64()), "n_words": pa.array(words.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array([x or nothing for x in digests], pa.string()),
        "contaminated": pa.array((n_hit > 0) & (SHARE * n_hit >= words.counts)),
    })


def _narrow(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    found = index.value
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            yield _rows(part, words, *found.hits(words), found.ids)


def _prints(batches: Iterator[pa.RecordBatch], lengths: list[int], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            for kind in lengths:
                at, h = words.grams(kind) if kind else words.winnowed(window, gram)
                if len(at):
                    both = np.unique(np.stack([words.row[at].astype(np.uint64), h], 1), axis=0)
                    rows = part.column("w_row").take(pa.array(both[:, 0].astype(np.int64)))
                    yield pa.record_batch({"w_row": rows, "kind": pa.array(np.full(len(both), kind), pa.int32()), "h": pa.array(both[:, 1].view(np.int64))})


def _item_prints(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of items: kind 0 for those of a window's length or more, else their number of words."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            short = np.flatnonzero((words.counts > 0) & (words.counts < window))
            own = span_hash(prefix_hash(words.hashes), words.first[short], words.first[short + 1])
            _, h = words.winnowed(window, gram)
            kinds = np.concatenate([np.zeros(len(h), np.int64), words.counts[short]])
            yield pa.record_batch({"kind": pa.array(kinds, pa.int32()), "h": pa.array(np.concatenate([h, own]).view(np.int64))})


def _places(row: np.ndarray, words: Words, starts: np.ndarray, stops: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Windows of words as two hashes of 64 bits, of the words and of the words mixed anew."""
    a, b = (span_hash(prefix_hash(h), starts, stops).view(np.int64) for h in (words.hashes, mixed(words.hashes)))
    first = words.first[row]
    return pa.record_batch({"row": pa.array(row), "kind": pa.array(kind, pa.int32()), "a": pa.array(a), "b": pa.array(b), "start": pa.array(starts - first), "stop": pa.array(stops - first)})


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            short = np.flatnonzero((words.counts > 0) & (words.counts < window))
            at, _ = words.grams(window)
            starts, stops = np.concatenate([at, words.first[short]]), np.concatenate([at + window, words.first[short + 1]])
            row = np.concatenate([words.row[at], short])
            found = _places(row, words, starts, stops, np.concatenate([np.zeros(len(at), np.int64), words.counts[short]]))
            yield pa.record_batch({"item_id": part.column("item_id").take(found.column("row")), **{c: found.column(c) for c in ("kind", "a", "b")}})


def _around(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of each row that reach over one of its ``prints``."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            words = Words(part.column("text"))
            prints = part.column("prints").flatten()
            kinds, hashes = prints.field("kind").to_numpy(), prints.field("h").to_numpy().view(np.uint64)
            for kind in np.unique(kinds).tolist():
                need, reach = kind or window, kind or gram
                at, h = words.grams(kind) if kind else words.winnowed(window, gram)
                at = at[np.isin(h, hashes[kinds == kind])]
                starts = np.unique((at[:, None] - np.arange(need - reach + 1)).ravel())
                starts = starts[(starts >= 0) & (starts + need <= len(words.hashes))]
                found = _places(np.zeros(len(starts), np.int64), words, starts, starts + need, np.full(len(starts), kind))
                row = part.column("w_row").take(found.column("row"))
                yield pa.record_batch({"w_row": row, **{c: found.column(c) for c in ("kind", "a", "b", "start", "stop")}})


def _numbered(rows: DataFrame, items: DataFrame, window: int, gram: int, named: bool = True) -> DataFrame:
    """Rows (k_text and others) with the spans that they share with the benchmark, by shuffling; if ``named`` with number and digest of the items.

    Documents may lack or repeat doc_id, so rows get a key of their own; they are written with it, as
    it would not be the same in another run. What joins read is written first, so that a window or set which very many
    rows have can be split. A row's spans and sets are bounded by its words.
    """
    rows = written(rows.withColumn("w_row", F.monotonically_increasing_id()), "numbered")
    texts = rows.select("w_row", F.col("k_text").alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    known = written(items.select("text").mapInArrow(lambda it: _item_prints(it, window, gram), "kind int, h long").distinct(), "item-fingerprints")
    # Lengths up to the window are few, whatever the benchmark holds.
    lengths = sorted(r[0] for r in known.select("kind").distinct().collect())
    prints = texts.mapInArrow(lambda it: _prints(it, lengths, window, gram), "w_row long, kind int, h long").join(known, ["kind", "h"], "left_semi")
    own = prints.groupBy("w_row").agg(F.collect_list(F.struct("kind", "h")).alias("prints"))
    around = texts.join(own, "w_row").select("w_row", "text", "prints").mapInArrow(lambda it: _around(it, window, gram), "w_row long, kind int, a long, b long, start long, stop long")
    key = ["kind", "a", "b"]
    windows = written(items.mapInArrow(lambda it: _item_windows(it, window), "item_id string, kind int, a long, b long").distinct(), "item-windows")
    same = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64(F.lit("set"), "item_id")))
    sets = written(windows.groupBy(*key).agg(same.alias("set")), "window-sets")
    hits = written(around, "windows").join(sets, key)
    found = hits.groupBy("w_row").agg(F.collect_list(F.array("start", "stop")).alias("w_spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    if not named:
        return rows.join(found.drop("sets"), "w_row", "left")
    found = written(found.withColumn("alike", F.sha2(F.array_join("sets", ","), 256)), "hits")
    one = sets.groupBy("set").agg(F.min(F.struct(*key)).alias("w")).select("set", "w.*")
    members = windows.join(one, key).select("set", "item_id")
    alike = found.select("alike", "sets").dropDuplicates(["alike"]).select("alike", F.explode("sets").alias("set"))
    names = alike.join(members, "set").select("alike", "item_id").distinct().groupBy("alike")
    names = names.agg(F.count("*").alias("w_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("w_digest"))
    return rows.join(found.join(written(names, "names"), "alike").select("w_row", "w_spans", "w_items", "w_digest"), "w_row", "left")


def _hits_of(part: pa.RecordBatch, words: Words) -> np.ndarray:
    """Words hit of each row of a part with ``w_spans``."""
    out = np.zeros(part.num_rows, np.int64)
    for i, spans in enumerate(part.column("w_spans").to_pylist()):
        if spans:
            edge = np.zeros(words.counts[i] + 1, np.int64)
            both = np.concatenate(spans).reshape(-1, 2)
            np.add.at(edge, both[:, 0], 1)
            np.add.at(edge, both[:, 1], -1)
            out[i] = np.count_nonzero(np.cumsum(edge[:-1]))
    return out


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "k_text"):
            words = Words(part.column("k_text"))
            yield _judged(part.column("k_doc_id"), words, _hits_of(part, words), [x or 0 for x in part.column("w_items").to_pylist()], part.column("w_digest").to_pylist())


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items that take part, and the bytes of their texts."""
    items = clear(benchmark, "item_id", "text").where("item_id is not null and text is not null").dropDuplicates()
    return items, items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]


def _shared(items: DataFrame, window: int, gram: int):
    rows = items.collect()  # of a size that was measured
    return items.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], window, gram))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Each row is judged by its own text, whether its doc_id is null, repeated or not. Null texts have no
    words and are never contaminated; items that are null, empty or have a null id are left out. Items are counted
    by id: one id with several texts counts once, equal texts with several ids once for each. Repeated rows
    stay, with equal results. Empty tables give no rows, an empty benchmark gives rows without hits.
    Other columns, whatever their names, are not read.
    """
    docs = clear(docs, "doc_id", "text")
    items, size = _items(benchmark)
    if size <= broadcast_bytes:
        index = _shared(items, window, gram)
        return docs.mapInArrow(lambda it: _narrow(it, index), RESULT)
    rows = _numbered(docs.toDF("k_doc_id", "k_text"), items, window, gram)
    return rows.select("k_doc_id", "k_text", "w_spans", "w_items", "w_digest").mapInArrow(_wide, RESULT)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _kept(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "k_text"):
            words = Words(part.column("k_text"))
            hit, _ = index.value.hits(words)
            n_hit = np.bincount(words.row[hit], minlength=part.num_rows)
            yield part.filter(pa.array((n_hit == 0) | (SHARE * n_hit < words.counts)))


def _kept_wide(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "k_text"):
            words = Words(part.column("k_text"))
            n_hit = _hits_of(part, words)
            yield part.select(columns).filter(pa.array((n_hit == 0) | (SHARE * n_hit < words.counts)))


def clean_rows(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of documents that are not contaminated, with the columns they came with.

    Each row is judged by its own text as in ``contamination``: null and empty texts stay, repeated
    rows stay or go together, columns whose names clash stay as they are, empty tables give no rows.
    One narrow pass for a benchmark of bounded size.
    """
    rows, back = whole(docs, "text")
    items, size = _items(benchmark)
    if size <= broadcast_bytes:
        index = _shared(items, WINDOW, GRAM)
        return back(rows.mapInArrow(lambda it: _kept(it, index), rows.schema))
    found = _numbered(rows, items, WINDOW, GRAM, named=False)
    columns = rows.columns
    return back(found.select(*columns, "w_spans").mapInArrow(lambda it: _kept_wide(it, columns), rows.schema))
