"""Removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller
id. Suffixes are dealt to tasks by their anchors: of the ``GRAM``-byte strings inside a string of
LENGTH bytes, the leftmost with the least hash. Equal strings have equal anchors, and consecutive
strings mostly share one, so a document is a list of short contexts, one for each run of
strings with a common anchor.

1. ``_anchors`` (narrow) lists anchors. Contexts that a smaller document of the same chunk has too, byte for byte, are
   settled there, so a passage that fills a third of all documents travels once a chunk. The rest go to the task
   of their anchor, packed, without their bytes.
2. ``_meet`` keeps the anchors that occur in several documents. Nothing is decided by a hash: equal anchors
   only name contexts to be compared.
3. ``_fetch`` reads the bytes of these contexts from the documents, and ``_expand`` compares them. Contexts of one anchor that
   are equal byte for byte become one with the least of its documents; among different ones,
   over the Burrows-Wheeler transform of the contexts of a block, intervals of strings are
   extended backward one byte at a time, breadth first, which derives the common prefixes of
   neighbouring suffixes by increasing value. It stops at LENGTH, where suffixes still joined
   share a string of that length; the least document of such a group keeps it. (Different contexts that agree on neither half
   around their anchor cannot share such a string, and are left out by the hashes of their halves.)
4. ``_remove`` takes the found strings out of the documents.

Documents are packed first, as they come, into chunks of about ``PART_BYTES`` of text, written once: a row is known by its chunk and its
place there, never by its id or its text, so rows without an id, with one id or with one text are all their own.

Memory: a task holds one chunk or one part of the anchors at a time. Parts hold about ``PART_BYTES`` of text, whatever the input
(there are no fewer than shuffle partitions), and each has a partition of its own. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, mixed, prefix_hash, runs, slices, span_hash, window_argmin
from gatewarden.llm.store import clear, written

LENGTH, GRAM = 50, 16
PART_BYTES = 8 << 20  # of text, by part
SUFFIXES = 1 << 17  # of one transform
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any


def packed(a: np.ndarray, keep: int | None = None) -> bytes:
    """Bytes of equal weight together (of unsigned integers, the lower ``keep`` ones), compressed."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)[:, :keep]
    return zstandard.ZstdCompressor(level=1).compress(flat.T.tobytes())


def unpacked(data: bytes, kind: str, keep: int | None = None) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    part = np.frombuffer(raw, np.uint8).reshape(keep or width, -1)
    full = np.zeros((part.shape[1], width), np.uint8)
    full[:, : part.shape[0]] = part.T
    return full.view(kind).ravel()


def own_partitions(parts: int) -> np.ndarray:
    """For each partition an integer that ``repartition(parts, column)`` sends there: no two parts share a partition."""
    out = np.full(parts, -1, np.int32)
    left, base = parts, 0
    with np.errstate(over="ignore"):
        while left:  # the hash of an integer that Spark deals by: 32-bit MurmurHash3, seed 42
            x = np.arange(base, base + 4 * parts, dtype=np.uint32)
            turned = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
            h = np.uint32(42) ^ (turned(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
            h = (turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            place = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts
            first, at = np.unique(place, return_index=True)
            new = out[first] < 0
            out[first[new]] = x[at[new]].view(np.int32)
            left, base = int((out < 0).sum()), base + 4 * parts
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal, for each (sizes of 8 and more)."""
    same = np.ones(len(a), bool)
    if len(a):
        words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
        for k in range(0, int(size.max()), 8):
            step = np.minimum(k, size - 8)
            same &= words[a + step] == words[b + step]
    return same


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    at = [*runs(values).tolist(), len(values)]
    return list(zip(at[:-1], at[1:], strict=True))


class Spans:
    """Runs of strings of the documents of a chunk: document (its place there), first start, number, and for open ones the anchor."""

    DDL = "part long, doc binary, start binary, count binary, anchor binary, has_open boolean"

    @staticmethod
    def rows(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
        """One row for each chunk; ``keys`` are (id, chunk, place) of documents; anchor 0: settled."""
        part, place = keys[doc, 1], keys[doc, 2]
        order = np.lexsort((start, place, part))
        part, place, start, count, anchor = (x[order] for x in (part, place, start, count, anchor))
        out: dict[str, list] = {k: [] for k in ("part", "doc", "start", "count", "anchor")}
        for a, b in stretches(part):
            out["part"].append(int(part[a]))
            out["doc"].append(packed(place[a:b].astype(np.uint32)))
            out["start"].append(packed(start[a:b].astype(np.uint32)))
            out["count"].append(packed(count[a:b].astype(np.uint8)))
            out["anchor"].append(packed(anchor[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int64()), *[pa.array(out[k], pa.binary()) for k in ("doc", "start", "count", "anchor")], pa.array([bool(anchor.any())] * len(out["part"]))], names=[*out, "has_open"])

    @staticmethod
    def read(row: dict) -> tuple[np.ndarray, ...]:
        return unpacked(row["doc"], "<u4").astype(np.int64), unpacked(row["start"], "<u4").astype(np.int64), unpacked(row["count"], "<u1").astype(np.int64), unpacked(row["anchor"], "<u8")


CHUNKS = "part long, ids binary, missing binary, sizes binary, text binary"


class Texts:
    """A chunk of documents: ids (LAST for null), which are missing, bytes of all texts, and where each begins."""

    def __init__(self, row: dict) -> None:
        self.part = row["part"]
        self.ids, self.missing = unpacked(row["ids"], "<i8"), unpacked(row["missing"], "<u1").astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(unpacked(row["sizes"], "<u4"), dtype=np.int64)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        self.keys = np.stack([self.ids, np.full(len(self.ids), self.part), np.arange(len(self.ids))], 1)

    def cuts(self, size: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents of at most ``size`` bytes (one longer text stands alone)."""
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + size, side="right")) - 1)
            yield a, b
            a = b


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number, held, flat, n_bytes = TaskContext.get().partitionId() << 32, [], [], 0
    press = zstandard.ZstdCompressor(level=1)

    def made() -> pa.RecordBatch:
        ids, missing, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = packed(ids), packed(missing.astype(np.uint8)), packed(sizes.astype(np.uint32)), press.compress(b"".join(flat))
        return pa.record_batch({"part": pa.array([number], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip(("ids", "missing", "sizes", "text"), columns, strict=True)}})

    for batch in batches:
        for part in slices(batch, "text", size):
            data, offsets = buffer_of(part.column("text"))
            if held and n_bytes + len(data) > size:
                yield made()
                number, held, flat, n_bytes = number + 1, [], [], 0
            ids = part.column("doc_id").cast(pa.int64())
            held.append((ids.fill_null(LAST).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.diff(offsets)))
            flat.append(data.tobytes())
            n_bytes += len(data)
    if held:
        yield made()


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: row, first start in the text, number, anchor hash, context hash."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    anchor = window_argmin(grams, length - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[: len(anchor)] == row[length - 1 :][: len(anchor)])
    first = runs(anchor[start])
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    context = span_hash(prefix, begin, begin + count + length - 1)
    place = anchor[begin]
    return row[begin], begin - offsets[row[begin]], count, grams[place], mixed(context ^ (place - begin).astype(np.uint64))


def _settled(data: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, and in that order whether a smaller document has the same context, byte for byte."""
    order = np.argsort(anchor)
    a = anchor[order]
    same = np.zeros(len(a), bool)
    same[1:] = a[1:] == a[:-1]
    same[:-1] |= same[1:]  # only anchors that occur again need the other keys
    again = order[same]
    order[same] = again = again[np.lexsort((doc[again], context[again], anchor[again]))]
    a, c, d = anchor[again], context[again], doc[again]
    done = np.zeros(len(order), bool)
    if len(again):
        head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        least = np.flatnonzero(head)[np.cumsum(head) - 1]
        other = np.flatnonzero((d > d[least]) & (size[again] == size[again[least]]))
        one, two = again[other], again[least[other]]
        gone = np.zeros(len(again), bool)
        gone[other] = equal_bytes(data, begin[one], begin[two], size[one])
        done[same] = gone
    return order, done


def _anchors(batches: Iterator[pa.RecordBatch], deal: np.ndarray, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    parts = len(deal)
    for batch in batches:
        for i in range(batch.num_rows):
            texts = Texts(batch.slice(i, 1).to_pylist()[0])
            held = []
            for a, b in texts.cuts(1 << 20):
                base = texts.offsets[a]
                row, start, count, anchor, context = anchors_of(texts.data[base : texts.offsets[b]], texts.offsets[a : b + 1] - base, length, gram)
                held.append((row + a, texts.offsets[row + a] + start, start, count, anchor, context))
            doc, begin, start, count, anchor, context = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(doc):
                continue
            order, done = _settled(texts.data, begin, count + length - 1, anchor, context, texts.ids[doc])
            keys = texts.keys
            del texts, begin, context, held
            doc, start, count, anchor = (x[order] for x in (doc, start, count, anchor))
            if done.any():
                own = Spans.rows(keys, doc[done], start[done], count[done], np.zeros(int(done.sum()), np.uint64))
                for k in range(own.num_rows):  # on their way to the documents they pass through the tasks of anchors
                    yield _sent(int(deal[k % parts]), None, None, None, None, None, _ipc(own.slice(k, 1)))
            doc, start, count, anchor = (x[~done] for x in (doc, start, count, anchor))
            part = ((anchor >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")  # the anchors of a part stay sorted
            doc, start, count, anchor, part = (x[by] for x in (doc, start, count, anchor, part))
            for a, b in stretches(part):
                used, local = np.unique(doc[a:b], return_inverse=True)
                step = np.diff(anchor[a:b] >> np.uint64(16), prepend=np.uint64(0))  # 48 bits; a chance equality only adds a comparison
                yield _sent(int(deal[part[a]]), packed(keys[used].ravel()), packed(local.astype(np.uint32)), packed(start[a:b].astype(np.uint32)), packed(count[a:b].astype(np.uint8)), packed(step), None)


ANCHORS = "part int, docs binary, doc binary, start binary, count binary, anchors binary, pass binary"


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _sent(part: int, *columns: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in columns]], names=["part", "docs", "doc", "start", "count", "anchors", "pass"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one part at a time; they come sorted by part."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and rows:
                yield now, rows
                rows = []
            now = row["part"]
            rows.append(row)
    if rows:
        yield now, rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of several documents, with where they stand."""
    for _, rows in _by_part(batches):
        keys, held, n_keys = [], [], 0
        for row in rows:
            if row["pass"] is not None:
                yield from pa.ipc.open_stream(row["pass"])
                continue
            own = unpacked(row["docs"], "<i8").reshape(-1, 3)
            anchor = np.cumsum(unpacked(row["anchors"], "<u8"), dtype=np.uint64)
            held.append((unpacked(row["doc"], "<u4").astype(np.int64) + n_keys, unpacked(row["start"], "<u4").astype(np.int64), unpacked(row["count"], "<u1").astype(np.int64), anchor))
            keys.append(own)
            n_keys += len(own)
        if not held:
            continue
        keys = np.concatenate(keys)
        doc, start, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        order = np.argsort(anchor)
        at = runs(anchor[order])
        ids = keys[doc[order], 0]
        many = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at) if len(at) else np.zeros(0, bool)
        use = order[np.repeat(many, np.diff(np.append(at, len(order))))]
        if len(use):
            yield Spans.rows(keys, doc[use], start[use], count[use], anchor[use] | np.uint64(1 << 63))


CONTEXTS = "part int, docs binary, doc binary, start binary, count binary, anchor binary, bytes binary"


def _packed_contexts(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, data: np.ndarray, begin: np.ndarray, deal: np.ndarray, length: int) -> pa.Table:
    """Contexts with their bytes, one row for each part of anchors."""
    part = (mixed(anchor) % np.uint64(len(deal))).astype(np.int64)
    order = np.lexsort((anchor, part))
    doc, start, count, anchor, begin, part = (x[order] for x in (doc, start, count, anchor, begin, part))
    out: dict[str, list] = {k: [] for k in ("part", "docs", "doc", "start", "count", "anchor", "bytes")}
    press = zstandard.ZstdCompressor(level=1)
    for a, b in stretches(part):
        used, local = np.unique(doc[a:b], return_inverse=True)
        size = count[a:b] + length - 1
        ends = np.cumsum(size)
        flat = data[np.arange(ends[-1]) + np.repeat(begin[a:b] - ends + size, size)]
        out["part"].append(int(deal[part[a]]))
        out["docs"].append(packed(keys[used].ravel()))
        out["doc"].append(packed(local.astype(np.uint32)))
        out["start"].append(packed(start[a:b].astype(np.uint32)))
        out["count"].append(packed(count[a:b].astype(np.uint8)))
        out["anchor"].append(packed(anchor[a:b] & np.uint64((1 << 48) - 1), 6))
        out["bytes"].append(press.compress(flat.tobytes()))
    return pa.table({"part": pa.array(out.pop("part"), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def _fetch(chunk: pa.Table, spans: pa.Table, deal: np.ndarray, length: int) -> pa.Table:
    """Bytes of the open contexts of a chunk."""
    held = [(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))]
    for row in spans.to_pylist():
        doc, start, count, anchor = Spans.read(row)
        some = np.flatnonzero(anchor)
        held.append((doc[some], start[some], count[some], anchor[some]))
    doc, start, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(doc):
        return _packed_contexts(np.zeros((0, 3), np.int64), doc, start, count, anchor, np.zeros(0, np.uint8), doc, deal, length)
    texts = Texts(chunk.to_pylist()[0])
    return _packed_contexts(texts.keys, doc, start, count, anchor, texts.data, texts.offsets[doc] + start, deal, length)


def _contexts(rows: list[dict], length: int) -> tuple[np.ndarray, ...]:
    """Keys of documents, and of each context its document, start, anchor, and bytes (flat, with where they begin)."""
    keys, held, flat, n_keys = [], [], [], 0
    press = zstandard.ZstdDecompressor()
    for row in rows:
        own = unpacked(row["docs"], "<i8").reshape(-1, 3)
        held.append((unpacked(row["doc"], "<u4").astype(np.int64) + n_keys, unpacked(row["start"], "<u4").astype(np.int64), unpacked(row["count"], "<u1").astype(np.int64), unpacked(row["anchor"], "<u8", 6)))
        flat.append(np.frombuffer(press.decompress(row["bytes"]), np.uint8))
        keys.append(own)
        n_keys += len(own)
    doc, start, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
    return np.concatenate(keys), doc, start, anchor, np.concatenate(flat), np.concatenate([[0], np.cumsum(count + length - 1)])


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by the next ``length`` bytes (zeros after the end), by doubling ranks."""
    n = len(text)
    bits = 8 * text.dtype.itemsize
    have = min(64 // bits, length)
    wide = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key |= wide[i : i + n] << np.uint64(64 - bits * (i + 1))
    while True:
        order = np.argsort(key)
        if have >= length:
            return order
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])).astype(np.uint64)
        step = min(have, length - have)
        ahead = np.zeros(n, np.uint64)
        ahead[: n - step] = rank[step:]
        key = rank << np.uint64(32) | ahead
        have += step


def prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and where in it a common prefix is shorter than ``length`` (starts of groups).

    ``text`` holds strings over 1..k, each ended by 0. For a suffix that has fewer than length bytes
    before its 0 the marks need not be complete.
    """
    n = len(text)
    order = suffix_order(text, length)
    last = text[order - 1]  # the transform; the text is read as a circle
    back = np.empty(n, np.int64)  # the row one step to the left, of rows that follow no 0
    back[np.argsort(last, kind="stable")] = np.arange(n)
    change = np.zeros(n, np.int64)  # rows in between that follow another byte than the row before
    np.cumsum(last[1:] != last[:-1], out=change[1:])
    total = np.bincount(text)
    base = np.cumsum(total) - total
    lead = text[order]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    # intervals of all single bytes
    low, high = base[total > 0], (base + total)[total > 0]
    border[high] = True
    one = high - low == 1
    single, low, high = low[one], low[~one], high[~one]
    for _ in range(1, length):
        # an interval whose rows all follow one byte goes to the left as it is
        same = change[low] == change[high - 1]
        i, j = low[same], high[same]
        some = last[i] != 0
        a = back[i[some]]
        b = a + (j - i)[some]
        fresh = ~border[b]
        new_low, new_high = [a[fresh]], [b[fresh]]
        # of others each row goes one step to the left, and those that stay side by side are one interval
        i, j = low[~same], high[~same]
        many = j - i
        rows = np.repeat(i - np.cumsum(many) + many, many) + np.arange(many.sum())
        own = np.repeat(np.arange(len(i)), many)
        some = last[rows] != 0
        to = np.sort(own[some] * n + back[rows[some]])
        if len(to):
            own, to = np.divmod(to, n)
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (to[1:] != to[:-1] + 1) | (lead[to[1:]] != lead[to[:-1]])]))
            a, b = to[first], np.append(to[first[1:] - 1], to[-1]) + 1
            fresh = ~border[b]
            new_low.append(a[fresh])
            new_high.append(b[fresh])
        left = single[last[single] != 0]
        left = back[left]
        left = left[~border[left + 1]]
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        border[high] = True
        border[left + 1] = True
        one = high - low == 1
        single = np.concatenate([left, low[one]])
        low, high = low[~one], high[~one]
        if not len(low) and not len(single):
            break
    return order, border[:n]


def repeated(contexts: list[np.ndarray] | tuple[np.ndarray, np.ndarray], doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the strings that a context of a smaller document holds too."""
    flat, at = contexts
    size = np.diff(at)
    codes, dense = np.unique(flat, return_inverse=True)
    text = np.zeros(len(flat) + len(size), np.uint8 if len(codes) < 255 else np.uint16)
    row = np.repeat(np.arange(len(size)), size)
    text[np.arange(len(flat)) + row] = dense + 1
    order, head = prefix_groups(text, length)
    owner = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(text)) - np.repeat(at[:-1] + np.arange(len(size)), size + 1)
    d = np.where(size[owner] - place >= length, doc[owner], LAST)[order]
    group = np.cumsum(head) - 1
    least = np.minimum.reduceat(d, np.flatnonzero(head))[group]
    hit = order[(d > least) & (size[owner[order]] - place[order] >= length)]
    hit.sort()
    return owner[hit], place[hit]


def _copies(flat: np.ndarray, at: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context the index of the first, by id, of those equal to it byte for byte."""
    size = np.diff(at)
    hashed = [np.zeros(0, np.uint64)]
    for i in range(0, len(size), 8192):
        own = at[i : i + 8193] - at[i]
        hashed.append(span_hash(prefix_hash(flat[at[i] : at[i] + own[-1]]), own[:-1], own[1:]))
    content = np.concatenate(hashed)
    order = np.lexsort((ids, content, size, anchor))
    a, c, n = anchor[order], content[order], size[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])]) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
    equal = equal_bytes(flat, at[:-1][order], at[:-1][first], n)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(equal, first, order)  # a chance equality of hashes: the context stands for itself
    return out


def _expand(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_part(batches):
        keys, doc, begin, anchor, flat, at = _contexts(rows, length)
        del rows
        ids, size = keys[doc, 0], np.diff(at)
        first = _copies(flat, at, anchor, ids)
        own = np.flatnonzero(first == np.arange(len(first)))  # different contexts, each with the least of its documents
        # Of two contexts with an anchor, a common string of this length covers the bytes before it or after it
        # by half: only contexts that agree with one of another document on such a half are compared.
        near = np.zeros(len(ids), bool)
        for half in _halves(flat, at, own, anchor, length, gram):
            fits = np.flatnonzero(half)
            order = fits[np.argsort(half[fits], kind="stable")]
            head = runs(half[order])
            both = np.minimum.reduceat(ids[own[order]], head) != np.maximum.reduceat(ids[own[order]], head) if len(head) else np.zeros(0, bool)
            near[own[order[np.repeat(both, np.diff(np.append(head, len(order))))]]] = True
        keep = np.flatnonzero(near)
        keep = keep[np.argsort(anchor[keep], kind="stable")]
        ends = np.cumsum(size[keep] + 1)
        bounds = np.append(runs(anchor[keep]), len(keep))
        a = 0
        # copies of what a smaller document has go whole
        copy = np.flatnonzero(ids > ids[first])
        found = [(copy, np.zeros(len(copy), np.int64), size[copy] - length + 1)]
        twin = np.flatnonzero((ids == ids[first]) & (first != np.arange(len(first))))  # more than one of them in the least document
        twin = twin[np.argsort(first[twin], kind="stable")]
        while a < len(keep):  # whole anchors, about SUFFIXES suffixes at a time
            room = (ends[a - 1] if a else 0) + SUFFIXES
            b = int(bounds[np.searchsorted(bounds, np.searchsorted(ends, room), side="right") - 1])
            b = b if b > a else int(bounds[np.searchsorted(bounds, a, side="right")])
            part = keep[a:b]
            rel = np.concatenate([[0], np.cumsum(size[part])])
            text = flat[np.arange(rel[-1]) + np.repeat(at[part] - rel[:-1], size[part])]
            who, start = repeated((text, rel), ids[part], length)
            if len(who):
                who = part[who]
                head = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)]))
                who, start, count = who[head], start[head], np.diff(np.append(head, len(who)))
                low, high = np.searchsorted(first[twin], who, "left"), np.searchsorted(first[twin], who, "right")
                more = np.repeat(np.arange(len(who)), high - low)
                also = twin[np.arange(len(more)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[more]]
                found += [(who, start, count), (also, start[more], count[more])]
            a = b
        who, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(who):
            yield Spans.rows(keys, doc[who], begin[who] + start, count, np.zeros(len(who), np.uint64))


def _halves(flat: np.ndarray, at: np.ndarray, which: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Hashes of the anchor with the bytes before it, and after it, of the contexts ``which`` (0: it does not reach so far)."""
    middle, out = (length - gram) // 2, [np.zeros(len(which), np.uint64) for _ in range(2)]
    for i in range(0, len(which), 8192):
        part = which[i : i + 8192]
        size = at[part + 1] - at[part]
        own = np.concatenate([[0], np.cumsum(size)])
        text = flat[np.arange(own[-1]) + np.repeat(at[part] - own[:-1], size)]
        prefix = prefix_hash(text)
        every = np.arange(max(0, len(text) - gram + 1))
        spot = window_argmin(span_hash(prefix, every, every + gram), length - gram + 1)[own[:-1]]
        for k, (a, b) in enumerate(((spot - middle, spot + gram), (spot, spot + gram + middle))):
            fits = np.flatnonzero((a >= own[:-1]) & (b <= own[1:]))
            out[k][i + fits] = span_hash(prefix, a[fits], b[fits]) ^ mixed(anchor[part[fits]]) | np.uint64(1)
    return out


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(chunk: pa.Table, spans: pa.Table, length: int, texts: bool) -> pa.Table:
    rows = chunk.to_pylist()
    if not rows:
        return _removed(np.zeros(0, np.int64), np.zeros(0, bool), [], [], [], [], texts)
    docs = Texts(rows[0])
    held = [(np.zeros(0, np.int64),) * 3]
    for row in spans.to_pylist():
        doc, start, count, anchor = Spans.read(row)
        use = np.flatnonzero(anchor == 0)
        held.append((doc[use], start[use], count[use]))
    doc, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
    edge = np.zeros(len(docs.data) + 1, np.int32)
    np.add.at(edge, docs.offsets[doc] + start, 1)
    np.add.at(edge, docs.offsets[doc] + start + count + length - 1, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    n, removed, number, kept = [], [], [], []
    for a, b in zip(docs.offsets[:-1].tolist(), docs.offsets[1:].tolist(), strict=True):
        out = gone[a:b]
        lost = int(out.sum())
        left = docs.data[a:b][~out].tobytes() if lost else docs.data[a:b].tobytes()
        n.append(b - a)
        removed.append(lost)
        number.append(int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])) if lost else 0)
        kept.append(left if texts else hashlib.sha256(left).hexdigest())
    return _removed(docs.ids, docs.missing, n, removed, number, kept, texts)


def _removed(ids: np.ndarray, missing: np.ndarray, n: list, removed: list, number: list, kept: list, texts: bool) -> pa.Table:
    last = {"kept": pa.array(kept, pa.binary())} if texts else {"kept_sha256": pa.array(kept, pa.string())}
    return pa.table({"doc_id": pa.array(ids, mask=missing), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), **last})


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or with ``texts`` the bytes, kept) of each row.

    A null text counts as empty. A null doc_id counts as larger than any other. Rows of one doc_id do not
    remove from each other; equal rows get equal results. An empty table gives no rows; other columns are not read.
    """
    rows = clear(docs, "doc_id", "text")
    chunks = written(rows.mapInArrow(lambda it: _chunked(it, part_bytes), CHUNKS), "text-chunks")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    deal = own_partitions(parts)
    sent = chunks.mapInArrow(lambda it: _anchors(it, deal, length, gram), ANCHORS)
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, Spans.DDL)
    met = written(met, "repeat-spans")
    many = max(parts, chunks.select("part").count())  # a chunk has about a partition to itself
    own = chunks.repartition(many, "part").groupBy("part")
    contexts = own.cogroup(met.where("has_open").repartition(many, "part").groupBy("part")).applyInArrow(lambda a, b: _fetch(a, b, deal, length), CONTEXTS)
    more = contexts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda it: _expand(it, length, gram), Spans.DDL)
    spans = met.where("not has_open").unionByName(more)
    schema = REMOVED.replace("kept_sha256 string", "kept binary") if texts else REMOVED
    return own.cogroup(spans.repartition(many, "part").groupBy("part")).applyInArrow(lambda a, b: _remove(a, b, length, texts), schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
