"""Ranked search, exact deduplication and importance resampling against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import exact, ranked, resample, store

WORDS = [a + b for a in ("ka", "lo", "mi", "té", "ru", "Sa") for b in ("na", "to", "ve", "X9", "zin")]
NAMES = ["doc_id", "TEXT", "text", "DOC_ID", "item", "c0", "w_row", "digest"]


def prose(rnd, n, gaps=(" ",)):
    return "".join(rnd.choice(WORDS) + rnd.choice(gaps) for _ in range(n))


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = F.lit("other").alias("x")
    return df.select("doc_id", other, "text", F.lit(-7), F.lit(1), other, other, other).toDF(*NAMES).repartition(3)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranking(docs, items, top=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(rx.findall(lowered(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in set(rx.findall(lowered(text))) if w in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:top], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk, pack", [(8 << 20, 1 << 20), (600, 60)])
def test_ranked_search(spark, chunk, pack):
    rnd = random.Random(40)
    docs = [(i, prose(rnd, rnd.choice([3, 20, 60]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, ";;"), (None, docs[3][1]), (None, None), docs[4], docs[4], (9, docs[4][1]), (300, prose(rnd, 3000)), (301, "é.É x-kana")]
    items = [(i, prose(rnd, rnd.randint(1, 8))) for i in range(25)] + [(50, None), (51, "nowhere"), (None, "kana x9"), (3, "KANA kana"), (52, docs[4][1]), (53, "")]
    got = ranked.ranked(clashing(spark, docs), spark.createDataFrame(items, "item_id long, text string"), chunk_bytes=chunk, pack_bytes=pack)
    assert sorted(repr(tuple(r)) for r in got.collect()) == ranking(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = plain(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert [tuple(r) for r in ranked.ranked(docs, items).collect()] == [("1", 1, 1, 287 * (1_000_000_000 // 1800))]
    assert ranked.ranked(docs.limit(0), items).count() == 0 and ranked.ranked(docs, items.limit(0)).count() == 0


def test_equal_scores_are_all_opened(spark):
    """A thousand copies have one score; the smallest ids win wherever they stand."""
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    docs = plain(spark, [(i, "alpha beta") for i in ids] + [(5000 + i, "gamma") for i in range(9)])
    got = ranked.ranked(docs, spark.createDataFrame([(1, "beta")], "item_id long, text string"), chunk_bytes=3000)
    assert sorted((r.rank, r.doc_id) for r in got.collect()) == [(i + 1, i) for i in range(10)]


def test_terms_of_one_document_each(spark):
    """No term is in two documents, so every level has as many nodes as terms; the root still covers all."""
    docs = plain(spark, [(i, f"w{i}") for i in range(100)])
    items = spark.createDataFrame([(i, f"w{i} w{99 - i}") for i in range(50)], "item_id long, text string")
    got = {(r.item_id, r.rank, r.doc_id) for r in ranked.ranked(docs, items).collect()}
    assert got == {(i, 1, i) for i in range(50)} | {(i, 2, 99 - i) for i in range(50)}


def test_a_descent_opens_few_nodes():
    rnd = random.Random(41)
    texts = pa.array([prose(rnd, 40) + (" rare" * (i == 777)) for i in range(4000)])
    row, hashes = ranked.terms_of(texts)
    chunk = ranked.Chunk.of(np.arange(4000), np.zeros(4000, bool), row, hashes, 4000, len(row))
    again = ranked.Chunk.read(chunk.row(5).to_pylist()[0])
    assert all((a == b).all() for a, b in zip(chunk.keys + chunk.most, again.keys + again.most, strict=True))
    pack = ranked.Pack([{"item": 1, "terms": np.unique(ranked.terms_of(pa.array(["rare kana"]))[1]).tobytes()}])
    _, term = pack.met(again.terms)
    weight, work = np.array([8000 if again.keys[0][np.searchsorted(again.keys[0], t << 32)] >> 32 == t and (again.keys[0] >> 32 == t).sum() == 1 else 5 for t in term]), []
    docs, _ = again.search(term, weight, 1, 1, work)
    assert docs.tolist() == [777] and work[0] < 60


def groups(docs):
    same = {}
    for n, (i, t) in enumerate(docs):
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, n))
    out = []
    for content, rows in same.items():
        keep = docs[min(rows)[2]][0]
        for _, _, n in rows:
            out.append((docs[n][0], keep, len(rows), hashlib.sha256(content.encode()).hexdigest()))
    return sorted(map(repr, out)), len(same)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.left(F.sha2(c, 256), F.lit(1))], ids=["sha256", "colliding"])
def test_exact_deduplication(spark, digest):
    rnd = random.Random(42)
    base = [prose(rnd, rnd.randint(0, 12), (" ", "\n", "  ", "\t \r")) for _ in range(40)]
    docs = [(rnd.randrange(500), rnd.choice(base)) for _ in range(200)]
    docs += [(600, "a  b"), (601, "a\n\tb"), (602, "a b "), (603, " a b"), (604, None), (605, ""), (606, "   "), (None, "a b"), (None, "lone"), (None, "lone"), (7, "twice"), (7, "twice"), (608, "a b"), (609, "x" * 3_000_000), (610, "x" * 3_000_000)]
    rows = exact.deduplicated(clashing(spark, docs), digest).collect()
    want, number = groups(docs)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == want
    assert sum(r.kept for r in rows) == number and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact.deduplicated(plain(spark, []), digest).count() == 0


def test_the_state_goes_on_where_it_ended(spark):
    """Two runs over a growing table of contents: the second reads what is new, and older groups are remembered."""
    state, out = store.new_path(spark, "state"), store.new_path(spark, "updates")
    first, path = exact.contents(plain(spark, [(5, "same text"), (6, "other")]))
    exact.updates(spark, path, exact.CONTENTS, state, out)
    more, _ = exact.contents(plain(spark, [(3, "same \n text"), (9, "third")]))
    more.select("doc_id", "digest", "content", (F.col("locator") + 10**12).alias("locator")).write.mode("append").parquet(path)
    exact.updates(spark, path, exact.CONTENTS, state, out)
    got = {(r.first.doc_id, r.n) for r in exact.latest(spark, out).collect()}
    assert got == {(3, 2), (6, 1), (9, 1)}
    last = spark.read.parquet(out).where("batch > 0").select("first.doc_id", "n").collect()
    assert sorted(map(tuple, last)) == [(3, 2), (9, 1)]


def test_native(spark):
    """The main path has no Python in its plans."""
    plan = exact.grouped(exact.contents(plain(spark, [(1, "a")]))[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text):
    words = RX.findall(lowered(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_crcs_of_runs():
    rnd = random.Random(43)
    texts = [prose(rnd, rnd.randint(0, 9)) + "w" * rnd.choice([0, 63, 64, 65, 500]) + " " + prose(rnd, 3) for _ in range(60)] + [None, "", "one", "a b"]
    row, bucket, words = resample.features(pa.array(texts))
    for i, t in enumerate(texts):
        n, want = runs_of(t)
        assert words[i] == n and sorted(bucket[row == i].tolist()) == sorted(want)


def test_resampling(spark):
    rnd = random.Random(44)
    docs = [(i, prose(rnd, rnd.choice([5, 19, 20, 21, 80]))) for i in range(400)]
    docs += [(500, None), (501, ""), (None, docs[5][1] + prose(rnd, 30)), (None, None), docs[7], docs[7], (502, prose(rnd, 300_000)), (503, "long" * 9000 + prose(rnd, 40))]
    target = [(1, prose(rnd, 9)), (2, "kana lo " * 30), (3, None)]
    s, t = Counter(), Counter()
    for text in (x for _, x in docs):
        s.update(runs_of(text)[1])
    for _, text in target:
        t.update(runs_of(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, text in docs:
        n, found = runs_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    want = [(*r, None) for r in rows if r[1] < 20] + [(*r, k if k <= 5 * len(able) // 100 else None) for k, r in enumerate(able, 1)]
    got = resample.resampled(clashing(spark, docs), spark.createDataFrame(target, "item_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert resample.resampled(plain(spark, []), plain(spark, [])).count() == 0 and resample.resampled(plain(spark, docs[:30]), plain(spark, [])).count() == 30


def test_ranks_of_one_score(spark):
    """Equal scores and ids are split over ranges by the row itself, and ranks go on from one to the next."""
    rows = spark.range(1000).select(F.lit(5).cast("long").alias("score"), F.when(F.col("id") >= 400, F.col("id")).alias("doc_id"), F.col("id").alias("w_row"))
    got = resample._ranked(rows, 700).where("rank is not null").select("doc_id", "rank").collect()
    assert sorted(r.rank for r in got) == list(range(1, 701))
    assert sorted((r.rank, r.doc_id) for r in got if r.doc_id is not None) == [(i + 1, 400 + i) for i in range(600)]
