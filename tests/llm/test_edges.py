"""Odd inputs for every operator and stage: clashing columns, long texts, empty tables, ties and repeated rows."""

import hashlib
import math
import random
import re
import time
import zlib
from datetime import datetime as at

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import alike, lexing, mixing, secrets, simhash, store, suffixes, tokens, topk, toxicity, urls, winnow

WORDS = [a + b for a in ("ka", "lo", "mi", "té", "ru", "sa") for b in ("na", "to", "ve", "x", "zin")]
NAMES = ["doc_id", "TEXT", "text", "DOC_ID", "lang", "LANG", "source", "Source", "c_lang", "w_row", "c0", "text"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def clashing(spark, rows):
    """Documents (doc_id, text, lang, source) among columns whose names clash with them and with each other."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    other = F.lit("other").alias("x")
    return df.select("doc_id", other, "text", F.lit(-7).alias("y"), "lang", other, "source", other, other, F.lit(3).alias("z"), other, other).toDF(*NAMES)


STAGES = {
    "toxicity": lambda docs, labels, bench: toxicity.mild_rows(docs, toxicity.fit(docs, labels)),
    "near-duplicates": lambda docs, labels, bench: alike.one_of_each(docs),
    "near-duplicates, few bits": lambda docs, labels, bench: simhash.one_of_each(docs),
    "decontamination": lambda docs, labels, bench: winnow.clean_rows(docs, bench),
    "decontamination, large": lambda docs, labels, bench: winnow.clean_rows(docs, bench, 0),
    "mixing": lambda docs, labels, bench: mixing.mixed_rows(docs, (4, 5)),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_with_clashing_columns_and_empty_tables(spark, stage):
    rnd = random.Random(20)
    rows = [(i, prose(rnd, 30), rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", None])) for i in range(60)]
    rows += [(100, None, "en", "src0"), (101, "", None, None), (None, "x y z", "en", "src1"), (None, None, None, None), rows[0], rows[0], (102, prose(rnd, 9000), "en", "src0")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[3][1]), (2, None), (None, "a")], "item_id long, text string")
    docs = clashing(spark, rows)
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = STAGES[stage](docs, labels, bench)
    assert got.columns == NAMES
    mine = sorted((repr((r[0], r[2], r[4], r[6])) for r in got.collect()))
    assert mine == sorted(repr(tuple(r)) for r in STAGES[stage](plain, labels, bench).collect()) and mine
    assert all((r[1], r[3], r[8], r[10]) == ("other", -7, "other", "other") for r in got.collect())
    for e_docs, e_labels, e_bench in ((docs.limit(0), labels, bench), (docs.limit(0), labels.limit(0), bench.limit(0))):
        assert STAGES[stage](e_docs, e_labels, e_bench).count() == 0
    assert STAGES[stage](docs, labels.limit(0), bench.limit(0)).count() > 0


OPERATORS = {
    "secrets": lambda d, o: secrets.secrets(d),
    "toxicity": lambda d, o: toxicity.scores(d, toxicity.fit(d, o["labels"])).drop("passages"),
    "contamination": lambda d, o: winnow.contamination(d, o["bench"]),
    "contamination, large": lambda d, o: winnow.contamination(d, o["bench"], broadcast_bytes=0),
    "tokens": lambda d, o: tokens.token_output(d).drop("start"),
    "suffixes": lambda d, o: suffixes.without_repeats(d),
    "counts": lambda d, o: tokens.token_counts(d),
    "simhash": lambda d, o: simhash.near_groups(d),
    "mixing": lambda d, o: mixing.mixture(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_with_clashing_columns_and_empty_tables(spark, name):
    rnd = random.Random(21)
    long = prose(rnd, 400_000)  # beyond every buffer of texts
    rows = [(i, prose(rnd, 25), "en", "src0") for i in range(12)] + [(20, None, None, None), (21, "", "", ""), (22, long, "en", "src1"), (None, "a b", None, None), (None, None, None, None)]
    rows += [rows[2], rows[2], (23, rows[2][1], "de", "src2")]
    other = {"labels": spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int"), "bench": spark.createDataFrame([(1, rows[3][1]), (2, " ".join(long.split()[9000:9040]))], "item_id long, text string")}
    docs, plain = clashing(spark, rows), spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, two = [sorted(repr(tuple(r)) for r in OPERATORS[name](d, other).collect()) for d in (docs, plain)]
    assert one == two and (len(one) == len(rows) or name == "mixing")
    assert OPERATORS[name](docs.limit(0), other).count() == 0


def test_a_long_text_is_one(spark):
    """A text of several buffers gives what its pieces give."""
    rnd = random.Random(22)
    words = [rnd.choice(WORDS) for _ in range(700_000)]
    item = " ".join(words[650_000:650_020])
    text = " ".join(words) + " password=abcdefghijklmnop"
    assert len(text.encode()) > 3 << 20
    docs = spark.createDataFrame([(1, text), (2, item + " and then " + item)], "doc_id long, text string")
    got = {r.doc_id: r for r in winnow.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated, got[2].n_hit) == (700_002, 20, False, 40)
    start = len(text) - len("password=abcdefghijklmnop")
    assert {r.doc_id: r.spans for r in secrets.secrets(docs).collect()} == {1: f"assign:{start}:{len(text)}", 2: ""}
    cut = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert cut[1].n_removed == 0 and cut[2].n_removed >= 2 * len(item.encode())
    same = tokens.Encoder.of(tokens.vocabulary()).library.encode(text, add_special_tokens=False).ids + [0]
    read = {r.doc_id: r for r in tokens.token_output(docs).collect()}
    assert (read[1].n_tokens, read[1].ids_crc32) == (len(same), zlib.crc32(np.array(same, "<u4").tobytes()))


def test_window_minimum_of_an_enormous_buffer(monkeypatch):
    keys = np.random.default_rng(1).integers(0, 1 << 63, (1 << 24) + 5000).astype(np.uint64)
    got = lexing.window_argmin(keys, 9)
    at_end = np.array([int(np.argmin(keys[i : i + 9] >> np.uint64(24))) + i for i in range(len(got) - 400, len(got))])
    middle = range((1 << 24) - 300, (1 << 24) + 300)
    assert len(got) == len(keys) - 8 and (got[-400:] == at_end).all()
    assert all(got[i] == int(np.argmin(keys[i : i + 9] >> np.uint64(24))) + i for i in middle)


def test_repeated_words_cost_no_more():
    for n in (3000, 20_000):
        began = time.time()
        index, words = winnow.Index([1, 2], ["one " * n, "one " * 5 + "two"]), winnow.Words(pa.array(["one " * n, "one two " * 40, "one " * 5 + "two " * 20]))
        hit, pairs = index.hits(words)
        assert time.time() - began < 2
        assert np.bincount(words.row[hit], minlength=3).tolist() == [n, 0, 6] and pairs.tolist() == [[0, 0], [2, 1]]


def test_an_item_counts_once_by_its_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta"), (7, "gamma delta"), (8, "beta gamma")], "item_id long, text string")
    for bound in (1 << 20, 0):
        (row,) = winnow.contamination(docs, bench, broadcast_bytes=bound).collect()
        assert (row.n_hit, row.n_items) == (4, 2)


BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
)


def test_patterns_against_the_library(spark):
    rnd = random.Random(23)
    pool = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGHIJ", "0123456789", "abcdef", "é", "日", "\n", ".", "-", "G", "xyz", "9f", "K", "ſ"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secrets(docs).collect():
        want = sorted((m.start(), k, m.end()) for k, (_, p, least, group) in enumerate(BASE) for m in re.finditer(p, texts[r.doc_id], re.ASCII) if m.end(group) - m.start(group) >= least)
        mine = [s for s in r.spans.split(",") if s and not s.startswith("entropy")]
        assert mine == [f"{BASE[k][0]}:{a}:{b}" for a, k, b in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))


def test_digest_of_the_patterns(spark):
    rnd = random.Random(40)
    pieces = ["password", "TOKEN", "api_key", "apikey", ": ", "=", "'", '"', "é", "\n", "AKIA", "ABCDEFGHIJKLMNO", "0123456789abcdef", "Zx9Qp2Lm8Rt4Vb6Nc1Ds", " ", "zz-zz", "/+.", "日本"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))) for i in range(400)] + [(900, None), (901, ""), (None, "0123456789abcdef"), (3, "secret=aaaaaaaaaaaa"), (3, "secret=aaaaaaaaaaaa")]
    want = []
    for i, text in rows:
        found = [(m.start(), k, m.end()) for k, (_, rx, least, g) in enumerate(BASE) for m in re.finditer(rx, text or "") if m.end(g) - m.start(g) >= least]
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))
        want.append((repr(i), *[sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want) and sum(w[1] for w in want) > 50
    assert all(sum(not x.startswith("entropy") for x in r.spans.split(",") if x) == r.n_assign + r.n_access + r.n_hex for r in got)


def test_allowed_parts_do_not_hide_the_rest():
    key = "Zx9Qp2Lm8Rt4Vb6Nc1DsWy7"
    scan = lambda t: [x[1:] for x in secrets.spans_of(pa.record_batch({"text": pa.array([t])}))[0]]
    for lead in ("prod/example/", "2024-01-02/", "config/secrets_v2/"):
        assert (3, len(lead + key)) in scan(lead + key)
    for quiet in ("2024-01-02T03", "123e4567-e89b-12d3-a456-426614174000", "0x" + "Ab12" * 10, "sha256-" + (key * 2)[:43] + "=", "assets/images/v2/logo_2024", "my-example9Qp2Lm8Rt4Vb6Nc1Ds"):
        assert not [x for x in scan(quiet) if x[0] == 3], quiet
    assert [x for x in scan("0x" + "AB12CDEF34" * 7) if x[0] == 3]  # longer than any address
    began = time.time()
    scan("aB3" * 200_000)
    assert time.time() - began < 5


def test_calibration(spark):
    """K and the curve come from rows scanned with weights that were learned without them."""
    rnd = random.Random(24)
    x, y = np.array([-3.0, -2, -1, 1, 2, 3]), np.array([0.0, 0, 1, 0, 1, 1])
    best = toxicity._likelihood(x, y, *toxicity._logistic(x, y))
    assert all(best >= toxicity._likelihood(x, y, a, b) - 0.02 for a in np.linspace(-1, 1, 9) for b in np.linspace(0, 2, 9))
    assert toxicity._likelihood(x, y, 0.2, 0.7) == pytest.approx(sum(math.log(p if t else 1 - p) for t, p in zip(y, 1 / (1 + np.exp(-0.2 - 0.7 * x)), strict=True)))
    rows, labels = [], []
    for i in range(800):
        toxic = int(i % 4 == 0)
        own = [f"u{i}w{k}" for k in range(3)] * 3  # words that only this row has must not count for it
        rows.append((i, " ".join([prose(rnd, 40), *own, *(["grubol"] * (3 * toxic))])))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    said = np.array([got[i] for i in held])
    true = np.array([i % 4 == 0 for i in held])
    assert said[true].mean() > 0.9 and said[~true].mean() < 0.1 and model.scale in toxicity.SCALES


def test_pruning_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centre[i % 30] + 0.05 * rng.normal(size=16)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = topk.work(df, df.where("vec_id % 20 = 0"), block=64).first()
    assert done.scored < 0.5 * done.blocks
    w = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0"), block=64).collect()))
    want = []
    for q in range(0, 6000, 20):
        s = w @ w[q]
        s[q] = -(1 << 40)
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(np.lexsort((np.arange(6000), -s))[:20])]
    assert got == want
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(50)], "vec_id long, embedding array<double>").repartition(4)
    got = topk.search(df, df.where("vec_id % 20 = 0"), block=4).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in got if r.query_id == 20} == {(20, k + 1): i for k, i in enumerate([i for i in range(21) if i != 20])}


def test_vectors_with_clashing_columns_and_great_width(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3000)]) for i in range(60)] + [(100, None), (101, [float("nan")] * 3000), (102, [None] * 3000), (None, [1.0] * 3000), (40, [0.5] * 3000), (40, [0.5] * 3000)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    other = F.array(F.lit(9.0))
    odd = plain.select(F.lit(-1).alias("a"), "embedding", other.alias("b"), "vec_id", F.lit("x").alias("c")).toDF("VEC_ID", "embedding", "Embedding", "vec_id", "VEC_ID")
    one, two = [sorted(map(tuple, topk.search(d, store.clear(d, "vec_id", "embedding").where("vec_id % 20 = 0"), block=16).collect()), key=repr) for d in (plain, odd)]
    assert one == two and len(one) >= 3 * 20 and one == sorted(set(one), key=repr)


def test_shards_read_only_what_they_need():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 40_000, 600_000).astype(np.uint32)
    data = tokens.shard_bytes(ids, [1, None], np.array([500_000, 100_000]))
    read = [0]

    def take(start, size):
        read[0] += size
        return data[start : start + size]

    opened = tokens.Shard(take)
    assert read[0] < len(data) // 50
    token = int(ids[1234])
    for what, want in ((lambda s: s.access(543_210), ids[543_210]), (lambda s: s.rank(token, 300_000), (ids[:300_000] == token).sum()), (lambda s: s.select(token, 0), np.flatnonzero(ids == token)[0]), (lambda s: s.count(token), (ids == token).sum())):
        shard = tokens.Shard(take)
        read[0] = 0
        assert what(shard) == want and read[0] < len(data) // 6
    assert opened.occurrences(token) == np.flatnonzero(ids == token).tolist() and opened.doc_ids == [1, None] and opened.lengths.tolist() == [500_000, 100_000]
    empty = tokens.Shard(tokens.shard_bytes(np.zeros(0, np.uint32), [], np.zeros(0, np.int64)))
    assert empty.size == 0 and empty.count(3) == 0 and not len(empty.ids())


def test_parts_have_partitions_of_their_own(spark):
    for parts in (1, 7, 64):
        deal = suffixes.own_partitions(parts)
        assert len(set(deal.tolist())) == parts
        got = spark.createDataFrame([(int(x),) for x in deal], "part int").repartition(parts, "part").select(F.spark_partition_id().alias("p")).collect()
        assert len({r.p for r in got}) == parts


def test_equal_hashes_remove_nothing_by_themselves():
    """Copies are told by their bytes, so contexts whose hashes meet by chance stay apart."""
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    zero = np.zeros(3, np.uint64)
    _, done = suffixes._settled(data, np.array([0, 60, 120]), np.array([60, 60, 60]), zero, zero, np.array([1, 2, 3]))
    assert sorted(done.tolist()) == [False, False, True]
    assert suffixes.equal_bytes(data, np.array([0, 0]), np.array([120, 60]), np.array([60, 59])).tolist() == [True, False]


def test_many_parts_give_the_same(spark):
    rnd = random.Random(25)
    passages = [prose(rnd, 20) for _ in range(5)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(passages) if rnd.random() < 0.5 else prose(rnd, 12) for _ in range(4))) for i in range(80)], "doc_id long, text string")
    one, two = [sorted(map(tuple, suffixes.without_repeats(docs, part_bytes=n).collect())) for n in (1 << 30, 1000)]
    assert one == two and any(r[2] for r in one)


def test_lists_in_any_case_and_single_labels(spark):
    log = [("B.org", "ads", "add", at(2024, 1, 1)), ("b.org", "ads", "remove", at(2024, 1, 5)), ("localhost", "x", "add", at(2024, 1, 1)), ("org", "y", "add", at(2024, 1, 1))]
    caps = [(1, "b.org", at(2024, 1, 2)), (2, "a.b.org", at(2024, 1, 6)), (3, "localhost", at(2024, 1, 6)), (4, "my.localhost", at(2024, 1, 6))]
    entries = spark.createDataFrame(log, "domain string, category string, action string, at timestamp")
    captures = spark.createDataFrame(caps, "page_id long, host string, fetched_at timestamp")
    assert sorted((r.page_id, r.domain) for r in urls.judged(captures, entries).where("blocked").collect()) == [(1, "b.org"), (3, "localhost")]
    odd = captures.select("*", F.lit(1).alias("HOST"), F.lit(2).alias("host ")).toDF("page_id", "host", "fetched_at", "HOST", "extra")
    assert urls.judged(odd, entries).count() == 4 and urls.judged(captures.limit(0), entries).count() == 0 and urls.judged(captures, entries.limit(0)).where("blocked").count() == 0


def test_as_of_merge_against_definition(spark):
    rnd = random.Random(31)
    domains = ["b.org", "a.b.org", "x.a.b.org", "c.net", "localhost", "hot.io", ".".join(["long" * 500, "io"])]
    when = lambda: at(2024, 1, 1 + rnd.randrange(9), rnd.choice([0, 0, 12, 23]), 0, rnd.choice([0, 0, 59]))
    log = [(rnd.choice(domains), rnd.choice("pqrs"), rnd.choice(["add", "add", "remove"]), when()) for _ in range(200)]
    log += [("hot.io", rnd.choice("pqrstuv"), rnd.choice(["add", "remove"]), when()) for _ in range(300)] + log[:20] + [("c.net", "p", "keep", when()), ("c.net", None, "add", when()), (None, "p", "add", when()), ("c.net", "p", "add", None)]
    caps = [(i, rnd.choice([*domains, "w." + rnd.choice(domains), "hot.io", "none.org", "", None]), rnd.choice([when(), when(), None])) for i in range(600)]
    caps += caps[:5] + [(1000 + i, "hot.io", at(2024, 1, 4)) for i in range(300)]
    entries = spark.createDataFrame(log, "domain string, category string, action string, at timestamp")
    got = urls.judged(spark.createDataFrame(caps, "page_id long, host string, fetched_at timestamp"), entries).collect()
    spans = []
    known = {r for r in log if None not in r and r[2] in ("add", "remove")}
    for d, c in {(r[0], r[1]) for r in known}:
        own = sorted((r[3], r[2]) for r in known if r[:2] == (d, c))
        spans += [(d, c, a, b) for (a, act), (b, _) in zip(own, [*own[1:], (at(2100, 1, 1), "")], strict=True) if act == "add" and b > a]

    def deciding(host, time):
        found = [(-len(d), a, c, d) for d, c, a, b in spans if host and time and (host == d or ("." in d and host.endswith("." + d))) and a <= time < b]
        return (True, min(found)[3], min(found)[2], min(found)[1]) if found else (False, None, None, None)

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*c, *deciding(c[1], c[2]))) for c in caps)
    stretches = sorted((r["domain"], r["from"], r["until"] or at(2100, 1, 1)) for r in urls.turns(urls.intervals(entries)).collect())
    assert len(stretches) > 60 and all(x[1] < x[2] and (x[0] != y[0] or x[2] <= y[1]) for x, y in zip(stretches, stretches[1:]))


def test_weight_zero_leaves_its_share_to_others(spark, tmp_path):
    import duckdb

    weights = dict(mixing.WEIGHTS, source="CASE source WHEN 'src0' THEN 0 ELSE 1 END")
    rows = [(i, "a b c d", "en", "src0" if i < 300 else "src2") for i in range(600)] + [(1000 + i, "a b c d", "en", "src1") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/d")
    got = mixing.mixture(df, (3, 4), 1, weights=weights)
    assert got.agg(F.sum("n_tokens")).first()[0] == 4 * 900 and got.where("source = 'src0'").count() == 0
    want = duckdb.sql(mixing.sql(f"read_parquet('{tmp_path}/d/*.parquet')", (3, 4), 1, weights=weights)).fetchall()
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens").collect()) == sorted(map(repr, want))


def test_a_hub_and_a_chain_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1400)}}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_are_swept(spark):
    import glob

    with store.scope() as tables:
        kept = [store.written(spark.range(3).toDF("x"), f"sweep{i}") for i in range(3)][-1]
        store.removed(spark, tables, keep=1)
    folder = store.shared_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and len(glob.glob(f"{folder}/sweep*")) == 1


def test_calls_in_threads_keep_their_own_tables(spark):
    """Several near-duplicate searches and a removal of repeats, at once in one session, give what each gives alone."""
    from concurrent.futures import ThreadPoolExecutor

    rnd = random.Random(29)
    base = [prose(rnd, 60) for _ in range(6)]
    docs = spark.createDataFrame([(i, base[i % 6] + " " + prose(rnd, i % 3)) for i in range(60)], "doc_id long, text string")
    ran = {"near": lambda: simhash.near_groups(docs), "one": lambda: alike.one_of_each(docs), "suffixes": lambda: suffixes.without_repeats(docs)}
    result = lambda name: sorted(map(repr, ran[name]().collect()))
    alone = {name: result(name) for name in ran}
    names = ["near", "one", "near", "suffixes", "near"]
    with ThreadPoolExecutor(len(names)) as pool:
        assert list(pool.map(result, names)) == [alone[n] for n in names]


def test_rows_are_known_by_their_place(spark):
    """Rows without an id or of one id, of one text or of texts alike, are their own: each loses what it shares, and no more."""
    rnd = random.Random(30)
    shared = prose(rnd, 30)
    rows = [(None, "q" * 200), (None, "q" * 200), (7, "q" * 200 + "x"), (7, "z" * 300), (7, shared), (None, shared + " end"), (None, shared)] + [(None, "lone " + prose(rnd, 40)) for _ in range(50)]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), part_bytes=500).collect())
    n = len(shared.encode())
    want = [("None", 200, 200)] * 2 + [("7", 201, 0), ("7", 300, 0), ("7", n, 0), ("None", n + 4, n), ("None", n, n)] + [("None", len(t.encode()), 0) for _, t in rows[7:]]
    assert got == sorted(want)
