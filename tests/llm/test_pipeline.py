"""Each stage of the pipeline on its own input, and the whole."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_alike import plain_groups
from test_operators import RX, WORDS, brute_contamination

import corpus_pipeline as pipeline
from gatewarden.llm import mixing, tokens, toxicity, winnow
from gatewarden.llm.store import written

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
def test_stages(spark):
    docs = written(spark.read.parquet(f"{FOLDER}/documents.parquet"), "t0")
    columns, after = docs.columns, []
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), "t")
        after.append(docs)
    assert [d.columns for d in after[:-1]] == [columns] * 4
    first, near, clean, mixed, out = after
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert sorted(r[0] for r in near.select("doc_id").collect()) == sorted(d[0] for d in plain_groups([tuple(r) for r in first.select("doc_id", "text").collect()]))
    bad = {r.doc_id for r in winnow.contamination(near, bench).where("contaminated").collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in near.select("doc_id").collect()} - bad
    assert {r.doc_id for r in mixing.mixture(clean, pipeline.MIX_SHARE, pipeline.MIX_EPOCHS).collect()} == {r[0] for r in mixed.select("doc_id").collect()}
    assert {tuple(r) for r in tokens.token_output(mixed).collect()} == {tuple(r) for r in out.collect()}
    labels, all_docs = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/documents.parquet")
    low = {r.doc_id for r in toxicity.scores(all_docs, toxicity.fit(all_docs, labels)).collect() if r.score < toxicity.THRESHOLD}
    assert {r[0] for r in first.select("doc_id").collect()} == low
    assert pipeline.run(spark, FOLDER).count() == out.count()


def words_of(text):
    return [w.encode() for w in RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def forms(word):
    return [(0, word), (5, word[:5]), (4, word[:4])]


def plain_weights(rows):
    """Weights of word forms and lambda, from (text, toxic)."""
    counts, sizes = (Counter(), Counter()), [0, 0]
    for text, toxic in rows:
        for w in words_of(text):
            counts[toxic].update(forms(w))
            sizes[toxic] += 1
    weight, share, prior = {}, {}, toxicity.PRIOR * sum(sizes)
    for form, t in counts[1].items():
        c, a = counts[0][form], toxicity.PRIOR * (t + counts[0][form])
        odds = math.log((t + a) / (sizes[1] + prior - t - a)) - math.log((c + a) / (sizes[0] + prior - c - a))
        if t >= toxicity.MIN_COUNT and odds - 2 * math.sqrt(1 / (t + a) + 1 / (c + a)) > 1:
            weight[form], share[form] = odds - 2 * math.sqrt(1 / (t + a) + 1 / (c + a)), (c + a) / (sizes[0] + prior)
    scale, gap = max(1.0, 2 * sum(share.values())), math.log(1 - toxicity.DENSITY)
    rest = 1 - sum(share.values()) / scale
    low, high = 1e-6, 8.0
    for _ in range(200):
        r = (low + high) / 2
        below = sum(share[f] / scale * math.exp(r * weight[f]) for f in weight) + rest * math.exp(r * gap) < 1
        low, high = (r, high) if below else (low, r)
    return weight, low


def best_segments(scores):
    """Scores of all maximal segments: the best one, then those on either side of it."""
    best, at, total, begin = 0.0, None, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, at = total, (begin, i + 1)
    return [] if at is None else [best, *best_segments(scores[: at[0]]), *best_segments(scores[at[1] :])]


def plain_statistic(text, weight, rate, k):
    words = words_of(text)
    found = sorted(best_segments([max([weight[f] for f in forms(w) if f in weight], default=math.log(1 - toxicity.DENSITY)) for w in words]), reverse=True)
    total, best = 0.0, toxicity.FLOOR
    for r, s in enumerate(found, 1):
        total += rate * s - math.log(max(k * len(words), 1e-9))
        best = max(best, total + math.lgamma(r + 1))
    return best


def plain_scores(spark, docs, labels):
    """Scores of op2 by its definition, in plain Python: docs (id, text), labels {id: toxic}, all of them within the sample."""
    ids = [i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    half = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.shiftright(F.xxhash64("i"), 7), F.lit(2)).alias("h")).collect()}
    rows = [(t, int(labels[i] > 0), half[i]) for i, t in docs if i in half]
    models = [plain_weights([r[:2] for r in rows if r[2] == h]) for h in (0, 1)]
    y, best = np.array([r[1] for r in rows], float), None
    for k in toxicity.SCALES:
        x = np.array([plain_statistic(t, *models[1 - h], k) for t, _, h in rows])
        at = np.zeros(2)
        loss = lambda v: np.logaddexp(0, v[0] + v[1] * x).sum() - (y * (v[0] + v[1] * x)).sum() + 0.005 * (v @ v)  # noqa: E731, B023
        for _ in range(300):  # the least loss, by Newton's steps halved until they help
            p = 1 / (1 + np.exp(-(at[0] + at[1] * x)))
            g = np.array([(p - y).sum(), ((p - y) * x).sum()]) + 0.01 * at
            w = p * (1 - p)
            step = np.linalg.solve(np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]]), g)
            while np.abs(step).max() > 1e-12 and loss(at - step) > loss(at):
                step = step / 2
            at = at - step
        z = at[0] + at[1] * x
        likely = (y * z - np.logaddexp(0, z)).sum()
        if best is None or likely > best[0]:
            best = (likely, k, *at)
    weight, rate = plain_weights([r[:2] for r in rows])
    return [1 / (1 + math.exp(-(best[2] + best[3] * plain_statistic(t, weight, rate, best[1])))) for _, t in docs]


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(77)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "ne", "ti", "ax"]) for _ in range(n))
    passages = [prose(30) for _ in range(4)]
    docs, labels = [], {}
    for i in range(320):
        words = prose(rnd.randint(20, 90)).split()
        if i % 5 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(["grubol", "grubix", "Snarkel"]) + rnd.choice(["", "a", "o"]) for _ in range(rnd.randint(1, 4))]
        text = " ".join(words) + (" " + rnd.choice(passages) if i % 7 == 0 else "")
        docs.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src0", "src1", "src2", None])))
        if i % 10 < 7 or i % 5 == 0:
            labels[i] = int(i % 5 == 0)
    docs += [(400 + i, docs[i][1] + rnd.choice(["", " ", " end"]), "en", "src1") for i in range(0, 60, 2)] + [docs[3], docs[3], (500, None, "en", None), (501, "", None, "src0"), (502, "!!", "en", "src0"), (None, prose(40), "en", "src0"), (None, prose(40), "de", "src2")]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [*enumerate(passages), (9, None), (10, "kana")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    want = plain_scores(spark, [d[:2] for d in docs], labels)
    got = toxicity.op2_toxicity(spark, folder).collect()
    assert sorted((repr(r.doc_id), round(r.score, 6), r.predicted) for r in got) == sorted((repr(d[0]), round(s, 6), int(s >= 0.3)) for d, s in zip(docs, want, strict=True))
    mild = [d for d, s in zip(docs, want, strict=True) if s < toxicity.THRESHOLD]
    near = plain_groups(mild)
    clean = [d for d in near if not brute_contamination([d[:2]], items)[0][5]]
    assert len(docs) - len(mild) > 30 and len(mild) - len(near) > 15 and len(near) - len(clean) > 15
    spark.createDataFrame(clean, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/clean")
    took = Counter(r[0] for r in duckdb.sql(f"select doc_id from ({mixing.sql(f"read_parquet('{tmp_path}/clean/*.parquet')", pipeline.MIX_SHARE, pipeline.MIX_EPOCHS)})").fetchall())
    assert 0 < sum(took.values()) < len(clean)
    library, place, rows = Tokenizer.from_file(tokens.vocabulary()), 0, []
    text_of = {d[0]: d[1] for d in clean if d[0] is not None}
    out = sorted(pipeline.run(spark, folder).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in out) == took and [r.doc_id is not None for r in out] == sorted(r.doc_id is not None for r in out)
    for r in out:
        assert r.start == place
        place += r.n_tokens
        if r.doc_id is not None:
            ids = library.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids + [0]
            rows.append((r.doc_id, r.n_tokens, r.ids_crc32) == (r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert all(rows) and [r.doc_id for r in out if r.doc_id is not None] == sorted(text_of_id for text_of_id in took.elements() if text_of_id is not None)
