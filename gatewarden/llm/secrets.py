"""Secret scans: three fixed patterns and sliding-window entropy.

The patterns find assignments to telling names, access keys and long hexadecimal runs, each
kind leftmost first without overlaps. Entropy adds what no pattern names: runs of key
characters are candidate strings; by the characters they hold they belong to a class (hexadecimal,
letters with digits, both cases with digits), and a window slides over each, its Shannon
entropy kept up by the two counts that change at a step. Windows at or above the threshold of the class join
into spans. The parts of candidates that an allow-list pattern covers, and spans inside a pattern's span, are
suppressed. All of it is one narrow pass over whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatewarden.llm.lexing import buffer_of, slices, table, word_spans
from gatewarden.llm.store import clear

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
LEAST_ASSIGN, LEAST_HEX = 12, 16
WINDOW = 20
#: Bits in a window of 20 characters, by class of the candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "mixed": 3.8}
#: Parts of candidates that are known not to be secrets; what a pattern covers is left out, the rest is scanned.
ALLOWED = (
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9a-fA-F])",  # UUID
    r"(?i)(?<![a-z0-9])[a-z0-9]*(?:example|sample|placeholder|dummy|changeme|your[_-]?key)[a-z0-9]*",  # one part of a run
    r"(?<![A-Za-z0-9])\d{4}-\d{2}-\d{2}(?:T\d{2})?(?![A-Za-z0-9])",  # date and hour
    r"(?<![A-Za-z0-9])(?:[A-Za-z]+\d{0,4}(?:[/_-]+|$))+",  # paths and slugs
    r"(?<![A-Za-z0-9])0[xX](?:[0-9a-fA-F]{1,40}(?![A-Za-z0-9])|(?=[0-9a-fA-F]{41}))",  # numbers and addresses, of longer ones the mark alone
    r"(?<![A-Za-z0-9])(?:sha1-[A-Za-z0-9+/]{27}=|sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==|md5-[A-Za-z0-9+/]{22}==)",  # integrity
)
_, HEX = table(word=b"0123456789abcdef")
_, KEY = table(word=b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
HEX[128:] = KEY[128:] = False
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


@cache
def _allowed(patterns: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(p.encode()) for p in patterns]


def class_of(candidate: bytes) -> str | None:
    """hex, alnum or mixed; None for strings that hold no digit or no letter."""
    digit = any(48 <= c <= 57 for c in candidate)
    lower = any(97 <= c <= 122 for c in candidate)
    upper = any(65 <= c <= 90 for c in candidate)
    if not digit or not (lower or upper):
        return None
    if all(chr(c) in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    return "mixed" if lower and upper else "alnum"


def hot_windows(candidate: bytes, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans (start, end) covered by windows whose entropy reaches the threshold.

    Entropy = log2(w) - (sum of n log2 n) / w; a step changes two counts, so two terms.
    """
    if len(candidate) < window:
        return []
    counts = [0] * 256
    total = 0.0
    for c in candidate[:window]:
        n = counts[c]
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
    most = window * (math.log2(window) - threshold) + 1e-9
    spans: list[tuple[int, int]] = []
    for i in range(len(candidate) - window + 1):
        if i:
            out, new = candidate[i - 1], candidate[i + window - 1]
            n = counts[out]
            counts[out] = n - 1
            total += _TERM[n - 1] - _TERM[n]
            n = counts[new]
            counts[new] = n + 1
            total += _TERM[n + 1] - _TERM[n]
        if total <= most:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + window)
            else:
                spans.append((i, i + window))
    return spans


def unlisted(candidate: bytes, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[int, bytes]]:
    """What no allow-list pattern covers: (start, bytes) of each piece."""
    covered = sorted(m.span() for p in _allowed(allowed) for m in p.finditer(candidate) if m.end() > m.start())
    out, at = [], 0
    for a, b in covered:
        if a > at:
            out.append((at, candidate[at:a]))
        at = max(at, b)
    return [*out, (at, candidate[at:])] if at < len(candidate) else out


def spans_of(part: pa.RecordBatch, window: int = WINDOW, thresholds: dict = THRESHOLDS, allowed: tuple[str, ...] = ALLOWED) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end) in code points, sorted."""
    data, offsets = buffer_of(part.column("text"))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
    view = memoryview(data)
    for i in range(part.num_rows):
        a, b = offsets[i], offsets[i + 1]
        text = view[a:b]
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                found[i].append((a + m.start(), 0, a + m.end()))
        for m in ACCESS.finditer(text):
            found[i].append((a + m.start(), 1, a + m.end()))
    starts, ends, row = word_spans(data, offsets, HEX)
    for k in np.flatnonzero(ends - starts >= LEAST_HEX).tolist():
        found[row[k]].append((starts[k], 2, ends[k]))
    starts, ends, row = word_spans(data, offsets, KEY)
    for k in np.flatnonzero(ends - starts >= window).tolist():
        s, e, own = int(starts[k]), int(ends[k]), found[row[k]]
        candidate = bytes(view[s:e])
        if class_of(candidate) is None:
            continue
        base = [x for x in own if x[1] < 3 and x[0] < e and s < x[2]]
        for begin, piece in unlisted(candidate, allowed):
            kind = class_of(piece) if len(piece) >= window else None
            for x, y in hot_windows(piece, thresholds[kind], window) if kind else ():
                x, y = s + begin + x, s + begin + y
                if not any(b[0] <= x and y <= b[2] for b in base):
                    own.append((x, 3, y))
    if any(found):
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        for i, own in enumerate(found):
            zero = point[offsets[i]]
            found[i] = sorted((int(point[a] - zero), kind, int(point[b] - zero)) for a, kind, b in own)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = spans_of(part, **options)
            count = [[sum(x[1] == k for x in own) for own in found] for k in range(4)]
            base = [hashlib.sha256(_joined([x for x in own if x[1] < 3]).encode()).hexdigest() for own in found]
            yield pa.record_batch({
                "doc_id": part.column("doc_id").cast(pa.int64()), **{f"n_{k}": pa.array(n, pa.int64()) for k, n in zip(KINDS, count, strict=True)},
                "base_sha256": pa.array(base, pa.string()), "spans": pa.array(map(_joined, found), pa.string()),
            })


def secrets(docs: DataFrame, window: int = WINDOW, thresholds: dict = THRESHOLDS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per document row: counts by kind, a digest of the pattern spans, all spans.

    Null texts count as empty; an empty text has no spans and the digest of the empty string.
    Repeated rows stay; a null doc_id stays null; an empty table gives no rows; other columns are not read. Spans of
    several kinds may overlap; at one start they stand in the order of the kinds.
    """
    return clear(docs, "doc_id", "text").mapInArrow(
        lambda it: _scan(it, window=window, thresholds=thresholds, allowed=allowed),
        "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string",
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
