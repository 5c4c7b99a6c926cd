"""Near-duplicates by long fingerprints: against all pairs, against exact similarity, and odd inputs."""

import hashlib
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from test_operators import WORDS, table

from gatewarden.llm import alike


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_print(text):
    """512 bits as a number, from plain integers."""
    found, out, mask = {xxhash.xxh64_intdigest(s, 42) for s in shingles(text)}, 0, 2**64 - 1
    for k in range(8):
        mixed = []
        for h in found:
            x = (h + k * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            mixed.append(x ^ (x >> 31))
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)) << 64 * k
    return out


def near(x, y):
    return ((x ^ y) & (2**64 - 1)).bit_count() <= 16 and (x ^ y).bit_count() <= 84


def plain_groups(docs):
    """The row that stays of each group of near-duplicates, by all pairs of fingerprints."""
    prints, group = [plain_print(d[1]) for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if group[i] != group[j] and near(prints[i], prints[j]):
                group = [group[j] if g == group[i] else g for g in group]
    order = lambda d: (d[0] is None, d[0] or 0, hashlib.sha256(f"{'' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest())
    return [min((d for d, g in zip(docs, group, strict=True) if g == k), key=order) for k in sorted(set(group))]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(n))


def changed(rnd, text, times):
    words = text.split()
    for _ in range(times):
        words[rnd.randrange(len(words))] = "new" + str(rnd.randrange(999))
    return " ".join(words)


@pytest.mark.parametrize("tile", [7, 64, alike.TILE])
def test_groups_against_all_pairs(spark, tile):
    rnd = random.Random(tile)
    base = [prose(rnd, rnd.choice([3, 6, 60, 150])) for _ in range(25)]
    docs = [(i, rnd.choice([changed(rnd, b, rnd.randrange(6)), b.upper(), b.replace(" ", "\n ")])) for i, b in enumerate(base * 6)]
    docs += [docs[3], docs[3], (7, docs[8][1]), (None, base[0]), (None, base[0]), (None, None), (500, None), (501, ""), (502, " \t"), (503, "x"), (504, "x x x x x x x x"), (None, prose(rnd, 9000))]
    want = plain_groups(docs)
    got = alike.one_of_each(table(spark, docs), tile).collect()
    assert sorted(repr((r.doc_id, r.text or "")) for r in got) == sorted(repr((i, t or "")) for i, t in want)
    assert 30 < len(want) < 130


def test_fingerprints_against_plain_integers():
    rnd = random.Random(5)
    for text in [None, "", "one", "a b c d e", "A B C D E f", prose(rnd, 300), "r " * 700, prose(rnd, 2000), "é " * 9]:
        assert int.from_bytes(alike.fingerprint_of((text or "").encode()), "little") == plain_print(text)


def test_similar_texts_are_told_from_others():
    """Of random pairs alike by 0.8 or more nine in ten are near, by 0.85 or more nearly all, by 0.65 or less hardly any."""
    rnd, counts = random.Random(6), {}
    for _ in range(1500):
        a = prose(rnd, rnd.randint(80, 300))
        b = changed(rnd, a, rnd.randrange(1, 16))
        x, y = shingles(a), shingles(b)
        s = len(x & y) / len(x | y)
        kind = "most" if s >= 0.85 else "some" if s >= 0.8 else "few" if s <= 0.65 else None
        counts.setdefault(kind, []).append(near(*(int.from_bytes(alike.fingerprint_of(t.encode()), "little") for t in (a, b))))
    share = {k: sum(v) / len(v) for k, v in counts.items()}
    assert len(counts["few"]) > 50 and len(counts["some"]) > 50
    assert share["most"] > 0.97 and sum(counts["most"] + counts["some"]) > 0.93 * len(counts["most"] + counts["some"]) and share["few"] < 0.03


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_near_copies_of_the_tables(spark):
    """Every text that is alike by 0.85 or more to one before it goes; what goes is alike by 0.6 or more to one that was there."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    kept = {r.doc_id for r in alike.one_of_each(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    held, seen = {}, {}
    for r in rows:
        mine, counts = shingles(r["text"]), {}
        for s in mine:
            for other in held.get(s, ()):
                counts[other] = counts.get(other, 0) + 1
            held.setdefault(s, []).append(r["doc_id"])
        best = max((n / (len(mine) + seen[o] - n) for o, n in counts.items()), default=0 if mine else 1)
        seen[r["doc_id"]] = len(mine)
        if best >= 0.85:
            assert r["doc_id"] not in kept
        if r["doc_id"] not in kept:
            assert best >= 0.6 or not mine
    assert 0 < len(kept) < len(rows)


def test_a_large_group_gives_few_links():
    """Four thousand copies, each near all others: joined without their pairs being kept."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, alike.WIDTH, np.int64).view(np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (4000, alike.WIDTH)).astype(np.uint64)
    prints, own = base ^ flips, np.arange(4000)
    assert set(alike._joined(prints, prints, own, own, own.copy(), True).tolist()) == {0}


def test_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6)], "doc_id long, text string, TEXT_2 int").toDF("doc_id", "text", "Text")
    got = alike.one_of_each(docs)
    assert got.columns == ["doc_id", "text", "Text"] and [tuple(r) for r in got.collect()] == [(1, "a b", 5)]
    assert alike.one_of_each(docs.limit(0)).count() == 0
