"""Vectorised reading of Arrow text columns: words, rolling hashes, window minima.

Every function works on one flat byte buffer holding many texts at once, so that the cost
is a few numpy passes over the bytes. Buffers are cut to a bounded size first (``slices``),
which bounds memory whatever the Arrow batch holds; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``max_bytes`` bytes (one longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a text or binary column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def table(word: bytes | None = None, separators: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables (lower-cased byte, is a word byte): ASCII letters only are lower-cased.

    ``separators`` lists the bytes outside words; with ``word`` given, ASCII bytes outside
    it are separators and every byte from 0x80 up belongs to words.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    if word is not None:
        inside[:128] = False
        inside[list(word)] = True
    inside[list(separators)] = False
    return lower, inside


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word, in order; words end at the borders of texts."""
    mask = inside[data]
    if not mask.any():
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[offsets[offsets < len(data)]] = False
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, U64(base))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads the low-entropy bits of polynomial hashes."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal content, equal hash."""
    _, down = _powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def window_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least key in each window of ``width`` (by its upper 40 bits)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << 24) - 1)
    assert len(keys) <= 1 << 24 or width <= 1 << 24
    if len(keys) > 1 << 24:  # one enormous text: in overlapping parts
        step = (1 << 24) - width
        return np.concatenate([window_argmin(keys[i : i + step + width - 1], width) + i for i in range(0, n, step)])
    m, have = (keys & ~low) | np.arange(len(keys), dtype=U64), 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:n], m[width - have : width - have + n])
    return (m[:n] & low).astype(np.int64)


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sequence of equal runs (first index of each run)."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
