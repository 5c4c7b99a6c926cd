"""Toxic passages by maximum-scoring segments.

Tokens are words, each scored by the log-odds of its occurrence in toxic against clean
labelled texts under an informative Dirichlet prior, less two standard deviations; a word
takes the best of itself and its 5- and 4-byte beginnings, which carry inflected forms.
Tokens without evidence cost a little, so that evidence must lie close together. A
linear-time scan then finds all maximal scoring segments of a text.
Segment scores are judged as extremes of random sequences: the expected number of chance
segments of score S in n words is K n exp(-lambda S), and the segments of a text are pooled
by their sum statistic. lambda solves the equation of the scores' chances in clean text. A logistic curve turns
the statistic into a score. K and the curve are fitted together, for the greatest likelihood of labels (K among
``SCALES``), on segments found with weights that were learned without the row: the labelled rows are halved, and
each half is scanned with the weights of the other.

The labelled rows that are fitted on are a bounded sample (``SAMPLE`` rows, least hash of
the id first), so the table of scored tokens is bounded too and can be sent to all tasks.
Scoring is one narrow pass over the whole of every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.llm.lexing import buffer_of, prefix_hash, slices, span_hash, table, word_spans
from gatewarden.llm.store import clear, whole, written

#: Most labelled rows fitted on; prior weight as a share of all tokens; share of evidence in a toxic passage.
SAMPLE, PRIOR, DENSITY, MIN_COUNT = 20_000, 0.01, 0.3, 3
THRESHOLD, SIGNIFICANT, FLOOR = 0.3, 0.01, -12.0
STARTS = (5, 4)
#: Values of K that are tried.
SCALES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
LOWER, INSIDE = table(word=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def tokens(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of every word and of its beginnings (one array each), and the row of each word."""
    data, offsets = buffer_of(texts)
    starts, ends, row = word_spans(data, offsets, INSIDE)
    prefix = prefix_hash(LOWER[data])
    kinds = [span_hash(prefix, starts, ends)]
    for k in STARTS:
        kinds.append(span_hash(prefix, starts, np.minimum(starts + k, ends)) ^ np.uint64(k))
    return kinds, row


def segments(positions: np.ndarray, scores: np.ndarray, gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end word): ``scores`` at ``positions``, ``gap`` elsewhere.

    One scan; a segment is extended to the left along links to the nearest earlier segment
    that begins lower, and no link is followed twice.
    """
    start, end, low, high, link = [], [], [], [], []
    total, last = 0.0, 0
    for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
        total += gap * (p - last)
        a, left = p, total
        total += s
        last = p + 1
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            a, left = start[j], low[j]
            for stack in (start, end, low, high):
                del stack[j:]
            j = link[j]
            del link[len(low) :]
        start.append(a)
        end.append(p + 1)
        low.append(left)
        high.append(total)
        link.append(j)
    return [(h - b, a, e) for a, e, b, h in zip(start, end, low, high, strict=True)]


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # sorted hashes of scored tokens
    weight: np.ndarray
    gap: float
    rate: float  # lambda
    scale: float  # K
    shift: float = 0.0
    slope: float = 0.0

    def found(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[float, int, int]]]]:
        """Words and scored segments of each text."""
        kinds, row = tokens(texts)
        count = np.bincount(row, minlength=len(texts))
        out: list = [[] for _ in range(len(texts))]
        if not len(self.known) or not len(row):
            return count, out
        seen = np.zeros(1 << 20, bool)
        seen[self.known & np.uint64((1 << 20) - 1)] = True
        best = np.zeros(len(row))
        for h in kinds:
            maybe = np.flatnonzero(seen[h & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            hit = self.known[at] == h[maybe]
            best[maybe[hit]] = np.maximum(best[maybe[hit]], self.weight[at[hit]])
        first = np.concatenate([[0], np.cumsum(count)])
        positive = np.flatnonzero(best)
        bounds = np.searchsorted(positive, first)
        for i in np.unique(row[positive]).tolist():
            at = positive[bounds[i] : bounds[i + 1]]
            out[i] = segments(at - first[i], best[at], self.gap)
        return count, out

    def statistic(self, count: int, found: list) -> float:
        """Pooled evidence of the best r segments, for the r that gives most; ``FLOOR`` without any."""
        if not found:
            return FLOOR
        log_n = math.log(max(self.scale * count, 1e-9))
        s = np.sort([x[0] for x in found])[::-1]
        # log r! is the sum of the logs up to r
        return max(FLOOR, float(np.cumsum(self.rate * s - log_n + np.log(np.arange(1, len(s) + 1))).max()))

    def score(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.shift + self.slope * statistic))))

    def passages(self, count: int, found: list) -> list[tuple[float, int, int]]:
        """The segments expected by chance at most ``SIGNIFICANT`` times in a text of this length."""
        return [x for x in found if self.scale * count * math.exp(-self.rate * x[0]) <= SIGNIFICANT]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens in toxic and clean rows of each half; kind -1 counts all words."""
    for batch in batches:
        for part in slices(batch, "text"):
            kinds, row = tokens(part.column("text"))
            cell = (2 * part.column("half").to_numpy(zero_copy_only=False) + part.column("toxic").to_numpy(zero_copy_only=False)).astype(np.int64)[row]
            for kind, h in [(-1, np.zeros(len(row), np.uint64)), *enumerate(kinds)]:
                token, inverse = np.unique(h, return_inverse=True)
                if len(token):
                    n = np.bincount(4 * inverse + cell, minlength=4 * len(token)).reshape(-1, 4)
                    yield pa.record_batch({"kind": pa.array(np.full(len(token), kind), pa.int32()), "token": pa.array(token.view(np.int64)), **{f"n{i}": pa.array(n[:, i], pa.int64()) for i in range(4)}})


def _statistics(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """The statistic of each row under every K, with the other half's weights."""
    for batch in batches:
        for part in slices(batch, "text"):
            for half in (0, 1):
                some = part.filter(pc.equal(part.column("half"), half))
                if some.num_rows:
                    count, found = models[1 - half].found(some.column("text"))
                    each = [replace(models[1 - half], scale=k) for k in SCALES]
                    x = [[m.statistic(n, f) for m in each] for n, f in zip(count.tolist(), found, strict=True)]
                    yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "toxic": some.column("toxic").cast(pa.int32())})


def _rate(weight: np.ndarray, share: np.ndarray, gap: float) -> float:
    """lambda of the extreme-value law for scores with these chances in clean text."""
    rest = max(1 - share.sum(), 1e-6)
    f = lambda r: float((share * np.exp(np.minimum(r * weight, 600))).sum() + rest * math.exp(r * gap)) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Shift and slope of the curve through 0/1 labels, lightly regularised (Newton's method)."""
    a, b = 0.0, 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def _likelihood(x: np.ndarray, y: np.ndarray, shift: float, slope: float) -> float:
    """Log of the chance of the labels under a curve."""
    z = np.clip(shift + slope * x, -500, 500)
    return float((y * z - np.logaddexp(0, z)).sum())


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _weighed(rows, gap: float) -> Model | None:
    """Weights from counts (kind, token, t, c) of toxic and clean rows, and their lambda; None without evidence."""
    sums = rows[rows.kind < 0]
    nt, nc = int(sums.t.sum()), int(sums.c.sum())
    known, weight, share = [], [], []
    for kind in range(1 + len(STARTS)):
        some = rows[(rows.kind == kind) & (rows.t >= MIN_COUNT)]
        if not nt or not nc or not len(some):
            continue
        t, c = some.t.to_numpy(np.float64), some.c.to_numpy(np.float64)
        prior = PRIOR * (nt + nc)
        a = PRIOR * (t + c)
        odds = np.log((t + a) / (nt + prior - t - a)) - np.log((c + a) / (nc + prior - c - a))
        lower = odds - 2 * np.sqrt(1 / (t + a) + 1 / (c + a))
        good = lower > 1
        known.append(some.token.to_numpy(np.int64).view(np.uint64)[good])
        weight.append(lower[good])
        share.append((c[good] + a[good]) / (nc + prior))
    if not known or not sum(map(len, known)):
        return None
    known, weight, share = map(np.concatenate, (known, weight, share))
    rate = _rate(weight, share / max(1.0, 2 * share.sum()), gap)
    order = np.argsort(known)
    return Model(known[order], weight[order], gap, rate, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out; without both classes in each half one that scores 0.

    At most ``sample`` labelled ids are fitted on (least hash first). Of several labels of one id the larger counts; labels
    without an id or a value are left out; a null text has no words; repeated rows count each.
    """
    gap = math.log(1 - DENSITY)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), gap, 1.0, 1.0, -30.0, 0.0)
    named = clear(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    named = named.where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(sample)
    named = named.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.shiftright(order, 7), F.lit(2)).cast("int").alias("half"))
    # the texts of the sample, read twice below
    marked = written(clear(docs, "doc_id", "text").join(F.broadcast(named), "doc_id").select("text", "toxic", "half"), "labelled")
    cells = [F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]
    total = marked.mapInArrow(_counts, "kind int, token long, n0 long, n1 long, n2 long, n3 long").groupBy("kind", "token").agg(*cells)
    rows = total.where(f"kind < 0 or n1 + n3 >= {MIN_COUNT}").toPandas()  # bounded by the sample
    model, *halves = [_weighed(rows.assign(t=t, c=c), gap) for t, c in ((rows.n1 + rows.n3, rows.n0 + rows.n2), (rows.n1, rows.n0), (rows.n3, rows.n2))]
    if model is None or None in halves:
        return empty
    got = marked.mapInArrow(lambda it: _statistics(it, halves), "x array<double>, toxic int").toPandas()
    if got.toxic.nunique() < 2:
        return empty
    x, y = np.stack(got.x.to_numpy()), got.toxic.to_numpy(np.float64)
    curves = [_logistic(x[:, k], y) for k in range(len(SCALES))]
    k = int(np.argmax([_likelihood(x[:, i], y, *c) for i, c in enumerate(curves)]))
    return replace(model, scale=SCALES[k], shift=curves[k][0], slope=curves[k][1])


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in slices(batch, "text"):
            count, found = model.found(part.column("text"))
            score = [model.score(model.statistic(n, f)) for n, f in zip(count.tolist(), found, strict=True)]
            spans = [[{"start": a, "end": e, "evidence": s} for s, a, e in model.passages(n, f)] for n, f in zip(count.tolist(), found, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "score": pa.array(score, pa.float64()), "passages": pa.array(spans, kind)})


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (word ranges with their evidence) of every row.

    Null texts count as empty; a text without words or evidence has the least score. A null doc_id stays null, repeated rows stay
    with equal scores, an empty table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return clear(docs, "doc_id", "text").mapInArrow(lambda it: _scored(it, shared), "doc_id long, score double, passages array<struct<start int, end int, evidence double>>")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), F.to_json("passages").alias("passages"))


def _mild(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in slices(batch, "k_text"):
            count, found = model.found(part.column("k_text"))
            yield part.filter(pa.array([model.score(model.statistic(n, f)) < threshold for n, f in zip(count.tolist(), found, strict=True)], pa.bool_()))


def mild_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score below the threshold, in one narrow pass, with the columns they came with.

    Null and empty texts stay (they hold no evidence), repeated rows stay or go together, a score equal to the
    threshold goes; doc_id is not read; clashing column names stay as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, back = whole(docs, "text")
    return back(rows.mapInArrow(lambda it: _mild(it, shared, threshold), rows.schema))
