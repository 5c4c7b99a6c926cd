"""Token ids of documents: encoding, wavelet-matrix shards, flat files with separators.

Encoding. Texts are cut where the vocabulary's own pattern always cuts; the library encodes each
distinct piece once, and ids are gathered from what is known (``Encoder``).

Shards. Documents are dealt to shards by ranges of doc_id and sorted. A shard is one row with one
binary: a wavelet matrix of its ids (a bit plane a bit, compressed in blocks, with a directory of the blocks' places and of
the ones before them), the ids' documents and lengths. ``Shard`` opens it: access, rank, select, counting
and occurrences of any id read the directory and one block a plane.

Flat files (``separator_scan``): ids of many documents, one after another, each ended by a
separator id, cut into blocks of equal size at any place, with no index. Blocks are searched for the
separator, and what each block leaves open at its borders is stitched by a prefix scan.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, prefix_hash, slices, span_hash
from gatewarden.llm.store import clear, new_path, written

END = 0
CACHE = 1_000_000
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_SPACE = _byte_set((9, 13), (32, 32))
_ALNUM = _byte_set((48, 57), (65, 90), (97, 122))
_PUNCT = _byte_set((33, 47), (58, 64), (91, 96), (123, 126))
_CONTROL = _byte_set((28, 31))


class Encoder:
    """Encodes whole texts; the result is that of the library's own ``encode``.

    The splitting pattern of a byte-level vocabulary always parts a text before a single space and around a
    single line break that stand between other characters, and between an ASCII letter or digit and
    ASCII punctuation. Texts are cut there by array operations; each distinct piece is
    encoded by the library once and kept by its hash. Texts for which the rule could fail (white space beyond
    ASCII, separators among control characters, the end token spelt out) are one piece.
    """

    END = "<|endoftext|>"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = self.library.token_to_id(self.END)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted hashes of the pieces known
        self.at = np.zeros(0, np.int64)  # where their ids begin in the arena
        self.size = np.zeros(0, np.int64)
        self.arena = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces."""
        n = len(data)
        space, line = _SPACE[data], data == 10
        solid = ~space
        cut = np.zeros(n + 1, bool)
        if n > 2:
            single = space[1:-1] & solid[:-2] & solid[2:] & ((data[1:-1] == 32) | line[1:-1])
            cut[1 : n - 1] = single
            cut[2:n] |= single & line[1:-1]
        if n > 1:
            cut[1:n] |= _ALNUM[data[:-1]] & _PUNCT[data[1:]]
        odd = _CONTROL[data]
        for lead, next_one, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
            i = np.flatnonzero(data == lead)
            i = i[i + (1 if third is None else 2) < n]
            i = i[np.isin(data[i + 1], next_one)]
            odd[i if third is None else i[np.isin(data[i + 2], third)]] = True
        i = np.flatnonzero(data[:-12] == 60) if n > 12 else np.zeros(0, np.int64)
        for k, c in enumerate(self.END.encode()):
            i = i[data[i + k] == c]
        odd[i] = True
        if odd.any():
            whole = np.zeros(len(offsets) - 1, bool)
            whole[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
            for d in np.flatnonzero(whole).tolist():
                cut[offsets[d] : offsets[d + 1]] = False
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, sizes = [], []
        for i in range(0, len(texts), 2000):
            part = texts[i : i + 2000]
            # the end token between two pieces keeps them apart, whatever they are
            got = self.library.encode_batch_fast([self.END.join(part[j : j + 40]) for j in range(0, len(part), 40)], add_special_tokens=False)
            joined: list[int] = []
            for x in got:
                joined += x.ids
                joined.append(self.end)
            flat = np.array(joined[:-1], np.uint32)
            cut = np.flatnonzero(flat == self.end)
            if len(cut) == len(part) - 1 and not any(self.END in x for x in part):
                ids.append(np.delete(flat, cut))
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(flat)]])) - 1)
            else:
                for x in part:
                    ids.append(np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint32))
                    sizes.append(np.array([len(ids[-1])]))
        size = np.concatenate(sizes)
        at = len(self.arena) + np.cumsum(size) - size
        self.arena = np.concatenate([self.arena, *ids])
        place = np.searchsorted(self.key, keys)
        self.key, self.at, self.size = (np.insert(old, place, new) for old, new in ((self.key, keys), (self.at, at), (self.size, size)))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; ``end`` is put after each text (null texts: that alone)."""
        data, offsets = buffer_of(texts)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        keys, first, inverse = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.key) + len(keys) > CACHE:
            self._forget()
        place = np.searchsorted(self.key, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.key)
        new[inside] = self.key[place[inside]] != keys[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.key, keys)
        size, at = self.size[place][inverse], self.at[place][inverse]
        lengths = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
        past = np.cumsum(size)
        total = int(past[-1]) if len(past) else 0
        flat = self.arena[np.arange(total) + np.repeat(at - past + size, size)] if total else np.zeros(0, np.uint32)
        if end is None:
            return flat, lengths
        out = np.full(total + len(lengths), end, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(lengths)), lengths)] = flat
        return out, lengths + 1


# ---- wavelet matrix

_HEAD, _MAGIC = "<4sQQHI", b"WMX2"
BITS = 1 << 15  # of a plane that are pressed together


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, bits: int = BITS) -> bytes:
    """A shard file: a head, the directory, the documents, and the bit planes.

    Planes go from the highest bit down, each stably parted by its own bits. A plane is pressed in blocks
    of ``bits`` bits; the directory holds, for each block, where it begins and how many ones are before it. So whoever
    has the directory finds rank and select by opening one block a plane.
    """
    n, levels = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    tables = [press.compress(x.tobytes()) for x in (np.array([x or 0 for x in doc_ids], "<i8"), known, np.asarray(lengths, "<i8"))]
    blocks, before, zeros = [], [], []
    for level in range(levels - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << level)) != 0
        plane = np.packbits(one)
        ends = np.arange(0, n, bits)
        ones = np.add.reduceat(one.astype(np.int64), ends) if n else np.zeros(0, np.int64)
        before.append(np.cumsum(ones) - ones)
        blocks += [press.compress(plane[a // 8 : (a + bits) // 8].tobytes()) for a in ends.tolist()]
        seq = np.concatenate([seq[~one], seq[one]])
        zeros.append(n - int(ones.sum()))
    sizes = np.array([*map(len, tables), *map(len, blocks)], "<u4")
    head = struct.pack(_HEAD, _MAGIC, n, len(doc_ids), levels, bits)
    return b"".join([head, np.array(zeros, "<u8").tobytes(), sizes.tobytes(), np.concatenate(before).astype("<u4").tobytes() if n else b"", *tables, *blocks])


class Shard:
    """An open shard file: access, rank, select, counting and occurrences. All positions count from 0.

    Opening reads the head and the directory; every other call reads the blocks that it needs, one a plane for access and rank, and
    keeps a few of them. The file is a buffer, or a function of (offset, size) that reads from wherever it lies. Without
    documents the file has no ids; ids that do not occur have rank 0.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes], kept: int = 64) -> None:
        self._read = data if callable(data) else lambda at, n: data[at : at + n]
        head = struct.calcsize(_HEAD)
        magic, self.size, docs, levels, self.bits = struct.unpack(_HEAD, bytes(self._read(0, head)))
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        self.blocks = -(-self.size // self.bits)
        parts = 3 + levels * self.blocks
        raw = bytes(self._read(head, 8 * levels + 4 * parts + 4 * levels * self.blocks))
        self.zeros = np.frombuffer(raw, "<u8", levels).astype(np.int64).tolist()
        sizes = np.frombuffer(raw, "<u4", parts, 8 * levels).astype(np.int64)
        self._ones = np.frombuffer(raw, "<u4", levels * self.blocks, 8 * levels + 4 * parts).astype(np.int64).reshape(levels, -1)
        ends = head + len(raw) + np.cumsum(sizes)
        self._at, self._sizes = (ends - sizes).tolist(), sizes.tolist()
        self._press, self._kept, self._most = zstandard.ZstdDecompressor(), {}, kept
        self._documents: tuple | None = None

    def _part(self, i: int) -> bytes:
        return self._press.decompress(bytes(self._read(self._at[i], self._sizes[i])))

    def _block(self, depth: int, block: int) -> np.ndarray:
        key = depth * self.blocks + block
        if key not in self._kept:
            if len(self._kept) >= self._most:
                del self._kept[next(iter(self._kept))]
            self._kept[key] = np.frombuffer(self._part(3 + key), np.uint8)
        return self._kept[key]

    def _docs(self) -> tuple[list[int | None], np.ndarray]:
        if self._documents is None:
            ids, known, lengths = np.frombuffer(self._part(0), "<i8"), np.frombuffer(self._part(1), np.uint8), np.frombuffer(self._part(2), "<i8")
            self._documents = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)], lengths
        return self._documents

    @property
    def doc_ids(self) -> list[int | None]:
        return self._docs()[0]

    @property
    def lengths(self) -> np.ndarray:
        return self._docs()[1]

    def ids(self) -> np.ndarray:
        """All ids: the planes' partings undone from the last to the first."""
        levels = len(self.zeros)
        kind = np.uint16 if levels <= 16 else np.uint32
        seq = np.zeros(self.size, kind)
        for depth in range(levels - 1, -1, -1):
            plane = b"".join(self._part(3 + depth * self.blocks + b) for b in range(self.blocks))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.size).view(bool)
            z = self.zeros[depth]
            new = np.empty_like(seq)
            new[~one] = seq[:z]
            new[one] = seq[z:] | kind(1 << (levels - 1 - depth))
            seq = new
        return seq

    def _rank1(self, depth: int, i: int) -> int:
        """Ones in the first i bits of a plane: the directory's sum before a block, and bits counted in it."""
        if i == self.size:
            return self.size - self.zeros[depth]
        block, rest = divmod(i, self.bits)
        total = int(self._ones[depth, block])
        if rest:
            part = self._block(depth, block)
            total += int(np.bitwise_count(part[: rest >> 3]).sum())
            if rest & 7:
                total += (int(part[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return total

    def _select(self, depth: int, bit: int, k: int) -> int:
        """Place in a plane of the k-th (from 0) of its ones or zeros."""
        before = self._ones[depth] if bit else np.arange(self.blocks) * self.bits - self._ones[depth]
        block = int(np.searchsorted(before, k, side="right")) - 1
        here = np.unpackbits(self._block(depth, block), count=min(self.bits, self.size - block * self.bits))
        return block * self.bits + int(np.flatnonzero(here == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for depth, z in enumerate(self.zeros):
            block, rest = divmod(i, self.bits)
            bit = (int(self._block(depth, block)[rest >> 3]) >> (7 - (rest & 7))) & 1
            ones = self._rank1(depth, i)
            i = z + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _down(self, token: int, i: int) -> int:
        for depth, z in enumerate(self.zeros):
            ones = self._rank1(depth, i)
            i = z + ones if token >> (len(self.zeros) - 1 - depth) & 1 else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id among the first i."""
        if token < 0 or token >> len(self.zeros):
            return 0
        return self._down(token, i) - self._down(token, 0)

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._down(token, 0) + k
        for depth in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - depth) & 1
            i = self._select(depth, bit, i - self.zeros[depth] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


SHARDS = "shard int, part int, first_doc long, tokens long, docs long, payload binary"


def _shards(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents to shards of about ``most`` ids; a longer document fills one shard."""
    from pyspark import TaskContext

    shard, part_no = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    docs: list[int | None] = []
    total = 0

    def row() -> pa.RecordBatch:
        nonlocal ids, sizes, docs, total, part_no
        flat = np.concatenate(ids)
        data = shard_bytes(flat, docs, np.concatenate(sizes))
        first = next((d for d in docs if d is not None), None)
        out = pa.record_batch({"shard": pa.array([shard], pa.int32()), "part": pa.array([part_no], pa.int32()), "first_doc": pa.array([first], pa.int64()), "tokens": pa.array([len(flat)], pa.int64()), "docs": pa.array([len(docs)], pa.int64()), "payload": pa.array([data], pa.binary())})
        ids, sizes, docs, total, part_no = [], [], [], 0, part_no + 1
        return out

    for batch in batches:
        for part in slices(batch, "text", 3 << 19):
            flat, lengths = Encoder.of(path).encode(part.column("text"), end)
            ids.append(flat)
            sizes.append(lengths)
            docs += part.column("doc_id").cast(pa.int64()).to_pylist()
            total += len(flat)
            if total >= most:
                yield row()
    if docs:
        yield row()


def write_shards(docs: DataFrame, vocab: str | None = None, end: int = END, shard_tokens: int = 2 << 20, path: str | None = None) -> str:
    """Writes the shard files of documents in ascending doc_id order (nulls first, equal ids by a hash of the text); returns their folder.

    Null texts hold the end id alone; rows of one id and text stand side by side; an empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    vocab, path = vocab or vocabulary(), path or new_path(spark, "token-shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = clear(docs, "doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(lambda it: _shards(it, vocab, end, shard_tokens), SHARDS).write.option("compression", "uncompressed").parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, start in zip(batch.column("payload"), batch.column("start").to_pylist(), strict=True):
            shard = Shard(data.as_buffer().to_pybytes())
            flat = shard.ids().astype("<u4")
            ends = np.cumsum(shard.lengths)
            begins = ends - shard.lengths
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(begins + start), "n_tokens": pa.array(shard.lengths), "ids_crc32": pa.array(crc, pa.int64())})


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files alone.

    The place of each shard is the sum of the sizes before it: one small row a shard.
    """
    files = spark.read.schema(SHARDS).parquet(path)
    sizes = files.select("shard", "part", "tokens")
    base = sizes.groupBy("shard").agg(F.sum("tokens").alias("all"))
    before = base.select("shard", (F.sum("all").over(W.orderBy("shard")) - F.col("all")).alias("base"))
    inside = F.sum("tokens").over(W.partitionBy("shard").orderBy("part")) - F.col("tokens")
    place = sizes.select("shard", "part", inside.alias("inside")).join(before, "shard").select("shard", "part", (F.col("base") + F.col("inside")).alias("start"))
    # The places hold 16 bytes a shard; the files stay where they are when that is small.
    place = F.broadcast(place) if place.count() <= 1_000_000 else place
    return files.select("shard", "part", "payload").join(place, ["shard", "part"]).select("payload", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocab: str | None = None, end: int = END) -> DataFrame:
    """Writes documents to shards and reads them back: one row per document row.

    A null text counts as empty and has the end id alone; a null doc_id sorts first and stays
    null; repeated rows stay. An empty table gives no rows.
    """
    return read_shards(docs.sparkSession, write_shards(docs, vocab, end))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---- flat files

FLAT_END = 50256
BLOCK = 1 << 18


def _flat(batches: Iterator[pa.RecordBatch], path: str, end: int, block: int) -> Iterator[pa.RecordBatch]:
    """Flat files cut into blocks at any place; a file is what one task writes."""
    from pyspark import TaskContext

    kind = "<u2" if Encoder.of(path).library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
    file, seq, rest = TaskContext.get().partitionId(), 0, np.zeros(0, kind)
    press = zstandard.ZstdCompressor(level=1)

    def row(block: int, ids: np.ndarray | None, docs: list | None) -> pa.RecordBatch:
        data = None if ids is None else press.compress(ids.tobytes())
        return pa.record_batch({"file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int32()), "data": pa.array([data], pa.binary()), "n": pa.array([0 if ids is None else len(ids)], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64()))})

    names = 0
    for batch in batches:
        for part in slices(batch, "text", 3 << 19):
            flat, lengths = Encoder.of(path).encode(part.column("text"), end)
            own = flat == end
            own[np.cumsum(lengths) - 1] = False
            flat[own] = 0
            rest = np.concatenate([rest, flat.astype(kind)])
            yield row(names, None, part.column("doc_id").cast(pa.int64()).to_pylist())
            names += 1
            while len(rest) >= block:
                yield row(seq, rest[:block], None)
                rest, seq = rest[block:], seq + 1
    if len(rest):
        yield row(seq, rest, None)


FLAT = "file int, block int, data binary, n long, doc_ids array<long>"


def _separators(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """Positions of the separator in each block, as one list a block."""
    press = zstandard.ZstdDecompressor()

    def ids(data: pa.BinaryScalar, n: int) -> np.ndarray:
        raw = press.decompress(data.as_buffer().to_pybytes())
        return np.frombuffer(raw, f"<u{len(raw) // n}")  # two bytes an id, or four for larger vocabularies

    for batch in batches:
        found = [np.flatnonzero(ids(x, n) == end) for x, n in zip(batch.column("data"), batch.column("n").to_pylist(), strict=True)]
        yield pa.record_batch({"file": batch.column("file"), "block": batch.column("block"), "n": batch.column("n"), "at": pa.array(found, pa.list_(pa.int32()))})


def separator_scan(flat: DataFrame, end: int = FLAT_END) -> DataFrame:
    """file, ordinal, start, n_tokens of each document in unindexed flat blocks (file, block, data, n).

    Each block is searched alone. Of a block, the prefix scan needs three numbers: its
    size, its count of separators, and the place of its last one; the scan over a file's blocks
    gives where the block begins, how many documents ended before it, and where the open one began.
    A last document without a separator is reported too; n_tokens counts the separator. Separators side by side are
    documents of that one token. A file without blocks gives no rows; blocks are told apart by file and number, which must not
    be null or repeated; other columns are not read.
    """
    at = written(flat.select("file", "block", "data", "n").mapInArrow(lambda it: _separators(it, end), "file int, block int, n long, at array<int>"), "separators")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    small = at.selectExpr("file", "block", "n", "size(at) k", "case when size(at) > 0 then at[size(at) - 1] + 1 end tail")
    small = small.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    small = small.select("file", "block", "base", "n", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("done"), F.coalesce(F.max(F.col("base") + F.col("tail")).over(before), F.lit(0)).alias("open"), (F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"))) == 1).alias("last"), "tail")
    both = at.select("file", "block", "at").join(small, ["file", "block"])
    ends = both.select("file", "done", "base", "open", "at", F.posexplode("at").alias("i", "p"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("at", F.col("i") - 1) + 1)
    closed = ends.select("file", (F.col("done") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("base") + F.col("p") + 1 - begin).alias("n_tokens"))
    stop, start = F.col("base") + F.col("n"), F.coalesce(F.col("base") + F.col("tail"), F.col("open"))
    unclosed = small.where(F.col("last") & (stop > start)).select("file", (F.col("done") + F.col("k")).alias("ordinal"), start.alias("start"), (stop - start).alias("n_tokens"))
    return closed.unionByName(unclosed)


def write_flat(docs: DataFrame, vocab: str | None = None, end: int = FLAT_END, block: int = BLOCK) -> DataFrame:
    """Flat token files (rows with data) and, apart from them, the documents of each file in order.

    Null texts are empty documents; null and repeated doc_ids stay, in the order of the rows that a task reads.
    """
    vocab = vocab or vocabulary()
    return written(clear(docs, "doc_id", "text").mapInArrow(lambda it: _flat(it, vocab, end, block), FLAT), "flat-tokens")


def token_counts(docs: DataFrame, vocab: str | None = None, end: int = FLAT_END, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens (without the end id) of every document row, counted from flat files.

    Null texts count as empty and have no tokens; null doc_ids stay null; repeated rows stay. A text
    that spells the separator's own name would be cut there, so such ids are written as id 0.
    """
    flat = write_flat(docs, vocab, end, block)
    counts = separator_scan(flat.where("data is not null"), end)
    names = flat.where("doc_ids is not null").selectExpr("file", "block", "doc_ids", "size(doc_ids) k")
    first = F.coalesce(F.sum("k").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = names.select("file", first.alias("first"), "doc_ids").select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).selectExpr("file", "first + i ordinal", "doc_id")
    return names.join(counts, ["file", "ordinal"]).selectExpr("doc_id", "n_tokens - 1 n_tokens")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
