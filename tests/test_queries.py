"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gatewarden.operators import lookups
from gatewarden.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "conversations", "labels", "benchmark", "embeddings")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_every_call_is_in_some_reply(spark, tmp_path):
    rows = [(e, 7 if e % 3 else e % 5) for e in range(1, 9000, 7)]  # one hot user, ids beyond the first block
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    kept, denied = [QUERIES[f"tool_gate_reply_{k}"](spark, str(tmp_path)).collect() for k in ("kept", "denied")]
    single = {r.event_id: r.decision for r in QUERIES["tool_gate"](spark, str(tmp_path)).collect()}
    assert len(single) == len(rows) == len(kept) + len(denied)
    assert {int(r.id[1:]) for r in kept} == {e for e, d in single.items() if d != "deny"}
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name, got in (("kept", kept), ("denied", denied)):
        found = con.execute(SQL[f"tool_gate_reply_{name}"])
        names = [c[0] for c in found.description]
        assert sorted(repr([r[c] for c in names]) for r in got) == sorted(repr(list(r)) for r in found.fetchall())


def test_blocks_hold_the_whole_text(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["", None, "short", "x" * 21, "  long\n" + "é " * 3000 + "end", "a\"b" * 50, "tail" * 9, None]) for i in (i, i + 61)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["chat_to_messages"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in got if r.type == "text"}
    assert {i: t for i, t in rows if i % 3 and t} == {i: t for i, t in texts.items() if t}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(SQL["chat_to_messages"])
    names = [c[0] for c in found.description]
    assert sorted(repr([r[c] for c in names]) for r in got) == sorted(repr(list(r)) for r in found.fetchall())


def test_every_event_goes_through_the_log(spark, tmp_path):
    spark.createDataFrame([(e, e % 7) for e in range(50)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["audit_log_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(int(r.request_id) for r in got) == list(range(50))


def test_compatibility_forms_are_the_librarys(spark, tmp_path):
    import unicodedata

    texts = ["ﬁne ①②", "ｆｕｌｌ　ｗｉｄｔｈ", "e\u0301 é Å Å", "plain ascii", "", None, "한글 각", "㎏ ½ ² ﷺ", "日本語", "a\u0327\u0301", "\u2126 \u212b", "ſt ǆ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "'en' lang", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.norm for r in QUERIES["normalize_nfkc"](spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in range(1, 10)} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts) if 1 <= i < 10}
    if os.path.isdir(FOLDER):
        from gatewarden.plans.registry import prompts

        raw = {r.doc_id: r.text for r in prompts(spark, FOLDER).collect()}
        got = {r.doc_id: r.norm for r in QUERIES["normalize_nfkc"](spark, FOLDER).collect()}
        assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in raw.items()}


def test_a_cache_by_its_definition(spark):
    import random
    from datetime import datetime, timedelta

    from gatewarden.operators.lookups import cache_outcomes

    rnd, rows = random.Random(3), []
    now = datetime(2024, 1, 1)
    for i in range(3000):
        now += timedelta(seconds=rnd.choice([0, 1, 5, 30]))
        rows.append((i, rnd.randrange(3), f"k{min(rnd.randrange(40), rnd.randrange(40))}", now))
    caches, want = {}, {}
    for i, c, k, t in rows:
        mine = caches.setdefault(c, {})  # key: (put in, last use)
        hit = k in mine and (t - mine[k][0]).total_seconds() < 200
        if not hit:
            mine.pop(k, None)
            if len(mine) >= 8:
                expired = [x for x in mine if (t - mine[x][0]).total_seconds() >= 200]
                gone = min(expired, key=lambda x: mine[x][0]) if expired else min(mine, key=lambda x: mine[x][1])
                del mine[gone]
        mine[k] = (mine[k][0] if hit else t, i)
        want[i] = hit
    got = cache_outcomes(spark.createDataFrame(rows, "i long, c int, k string, t timestamp"), "c", "k", "t", "i", 8, 200.0).collect()
    hits = {r.i: r.hit for r in got}
    assert len(hits) == 3000 and sum(hits.values()) > 300 and sum(hits[i] != want[i] for i in want) <= 3  # of entries put in at one time any may go first


def test_schema_references_and_refusals(spark):
    from pyspark.sql import functions as F

    from gatewarden.functions.jsonshape import schema_errors

    errors = lambda text, schema: spark.range(1).select(schema_errors(F.parse_json(F.lit(text)), schema).alias("e")).first().e
    schema = {"$defs": {"a": {"type": "array", "items": {"$ref": "#/$defs/b"}}, "b": {"enum": [{"x": 1, "y": 2}, "q"]}}, "properties": {"l": {"$ref": "#/$defs/a"}, "no": False}}
    assert errors('{"l": [{"y":2,"x":1}, "q"]}', schema) == [] and errors('{"l": ["q", 3]}', schema) == ["/l/items: is not one of the values allowed"]
    assert errors('{"no": 1}', schema) == ["/no: no value is allowed"] and errors("5", {"not": {"multipleOf": 2.5}}) == [": fits what is excluded"]
    assert errors("0.3", {"multipleOf": 0.1}) == [] and errors('{"a":1,"b":"x"}', {"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}) == ["/*: is not of type integer"]
    assert errors('{"it\'s": 1, "a.b": 2}', {"required": ["it's", 'say "x"'], "properties": {"it's": {"type": "string"}, "a.b": {"maximum": 1}}}) == [': lacks the property say "x"', "/it's: is not of type string", "/a.b: is greater than the maximum"]
    assert errors('"b"', {"enum": ["a", "b"], "const": "a"}) == [": is not one of the values allowed"]
    for bad in ({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}, {"$ref": "http://x/y"}, {"unevaluatedItems": False}, {"oneOf": [{"$ref": "#"}, {}], "items": {"$ref": "#"}}):
        with pytest.raises(NotImplementedError):
            errors("1", bad)


def test_masked_arguments_are_json(spark):
    """Random nested values with escapes and addresses: the text stays JSON, and equals a walk over its strings."""
    import json
    import random
    import re

    from pyspark.sql import functions as F

    from gatewarden.functions.jsonshape import mask_strings
    from gatewarden.rules import default_entities

    rnd, mail = random.Random(4), dict((r.entity, r.pattern) for r in default_entities())["EMAIL"]
    bits = ["\n", '"', "\\", "@", "bob@example.com", "é", "a", ":", "\t", "{", "日", " ", "carl@b.io", "\b", "/"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7)))

    def value(depth):
        kind = rnd.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rnd.randint(0, 4))]
        if kind == 5:
            return {text(): value(depth - 1) for _ in range(rnd.randint(0, 4))}
        return [text(), rnd.randint(-9, 9), None, text()][kind]

    def walked(v):
        if isinstance(v, str):
            return re.sub(mail, "[EMAIL]", v)
        return [walked(x) for x in v] if isinstance(v, list) else {k: walked(x) for k, x in v.items()} if isinstance(v, dict) else v

    values = [value(4) for _ in range(400)] + [{"to": "hi\nbob@example.com"}, "x" * 50_000 + "\\ a@b.io"]
    raw = [json.dumps(v, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for v in values]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, t string").select("i", mask_strings(F.col("t"), default_entities(), {"EMAIL"}).alias("t")).collect()
    changed = 0
    for r in rows:
        assert json.loads(r.t) == walked(values[r.i])
        changed += walked(values[r.i]) != values[r.i]
    assert changed > 50


def test_routes_by_prefix(spark):
    """First route that fits, by definition; and no loop over pairs in the plan of many routes."""
    import random

    from gatewarden.operators import lookups

    rnd = random.Random(5)
    name = lambda n: "".join(rnd.choice("ab*") for _ in range(n))
    routes = [(i, name(rnd.randint(0, 4)) + rnd.choice(["", "*"]), f"b{i}", [f"f{i}"] if i % 2 else None) for i in range(60)]
    models = [name(rnd.randint(0, 6)) for _ in range(200)] + [None, "", "*"]
    fits = lambda p, m: m.startswith(p[:-1]) if p.endswith("*") else m == p
    want = {}
    for i, m in enumerate(models):
        hit = None if m is None else next((r for r in routes if fits(r[1], m)), None)
        want[i] = ("d", ["d"]) if hit is None else (hit[2], [hit[2], *(hit[3] or [])])
    table = spark.createDataFrame(routes, "ord int, pattern string, backend string, fallback array<string>")
    requests = spark.createDataFrame(list(enumerate(models)), "i int, model string")
    got = {r.i: (r.backend, r.chain) for r in lookups.routed(requests, table, "d").collect()}
    assert got == want
    many = spark.range(200_000).selectExpr("cast(id as int) ord", "concat('m', id, if(id % 2 = 0, '*', '')) pattern", "'b' backend", "array('c') fallback")
    plan = lookups.routed(requests, many, "d")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_without_a_time_are_listed_last(spark):
    from datetime import datetime

    from gatewarden.operators.lookups import listed

    rows = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, None), (3, datetime(2024, 1, 2)), (4, None)], "i int, t timestamp")
    assert sorted((r.place, r.i) for r in listed(rows, "t", "i").collect()) == [(1, 3), (2, 1), (3, 2), (4, 4)]
    by = listed(rows.selectExpr("*", "i % 2 k"), "t", "i", "k").collect()
    assert sorted((r.k, r.place, r.i) for r in by) == [(0, 1, 2), (0, 2, 4), (1, 1, 3), (1, 2, 1)]


@pytest.mark.parametrize("strict", [False, True])
def test_many_spans_by_sweep(spark, strict):
    """Clusters match as the whole text does; twenty thousand spans of one text take seconds."""
    import random
    import time

    from gatewarden.operators import evaluate

    rnd = random.Random(6)
    span = lambda: (rnd.choice("AB"), a := rnd.randrange(900), a + rnd.choice([0, 1, 3, 9]))
    texts = [(i, [span() for _ in range(rnd.choice([0, 3, 60]))], [span() for _ in range(rnd.choice([0, 2, 60]))]) for i in range(12)] + [(20, None, [("A", 0, 2)]), (21, [("A", 0, 2)], None)]
    schema = "id int, detected array<struct<entity: string, start: int, end: int>>, gold array<struct<entity: string, start: int, end: int>>"
    df = spark.createDataFrame(texts, schema)
    got = sorted(map(repr, evaluate.outcomes(df, ["id"], strict=strict).collect()))
    want = []
    for i, found, gold in texts:
        found, gold, used = found or [], gold or [], set()
        for k, (e, a, b) in enumerate(found):
            fits = [j for j, (f, x, y) in enumerate(gold) if j not in used and e == f and ((a, b) == (x, y) if strict else a < y and x < b)]
            used |= set(fits[:1])
            want.append((i, "tp" if fits else "fp", e, a, b, k))
        want += [(i, "fn", *g, j) for j, g in enumerate(gold) if j not in used]
    assert sorted(map(repr, map(tuple, evaluate.outcomes(df, ["id"], strict=strict).collect()))) == sorted(map(repr, want)) and got
    big = [("A", 5 * i, 5 * i + 4) for i in range(20_000)]
    rows = spark.createDataFrame([(1, big, big[::-1])], schema)
    began = time.time()
    assert {r.kind: r["count"] for r in evaluate.outcomes(rows, ["id"], strict=strict).groupBy("kind").count().collect()} == {"tp": 20_000}
    assert time.time() - began < 30


def test_percentiles_by_ranges(spark):
    import random

    from gatewarden.operators.audit import rank_percentiles

    rnd, points = random.Random(7), {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(10_000), 7, None])) for _ in range(4000)] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    at = lambda vs, p: sorted(vs)[int(len(vs) * p)]
    for keys in (["k"], []):
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault((k,) if keys else (), []).append(v)
        want = sorted(repr((*k, *[at(vs, p) for p in points.values()])) for k, vs in groups.items())
        for ranges in (2, 64):
            assert sorted(repr(tuple(r)) for r in rank_percentiles(df, "v", points, keys, ranges).collect()) == want
    assert rank_percentiles(df.limit(0), "v", points).collect() in ([], [(None,) * 4])


def test_percentiles_of_rows_in_any_order(spark):
    """Rows that are dealt out anew whenever they are read; between machines, parts of a shuffle come in any order too."""
    import random
    import secrets

    from gatewarden.operators.audit import rank_percentiles

    def mixed(batches):
        for b in batches:
            yield b.assign(to=[secrets.randbelow(2**31) for _ in range(len(b))])

    rnd, points = random.Random(3), {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = [(k, rnd.randrange(30_000)) for k in ("a", "b", None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v long").mapInPandas(mixed, "k string, v long, to long").repartition(4, "to").drop("to")
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for keys in (["k"], []):
            groups = {}
            for k, v in rows:
                groups.setdefault((k,) if keys else (), []).append(v)
            want = sorted(repr((*k, *[sorted(vs)[int(len(vs) * p)] for p in points.values()])) for k, vs in groups.items())
            for _ in range(2):
                assert sorted(repr(tuple(r)) for r in rank_percentiles(df, "v", points, keys).collect()) == want
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_schemas_that_refer_to_themselves(spark):
    """A tree of values by a schema that comes back to itself, fifty levels deep and more; and lists by alternatives."""
    import json
    import random

    from pyspark.sql import functions as F

    from gatewarden.functions.jsonshape import schema_errors

    tree = {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}, "next": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/link"}]}}, "$defs": {"link": {"allOf": [{"$ref": "#"}, {"required": ["name"]}]}}}

    def good(x, link=False):
        if not isinstance(x, dict) or not isinstance(x.get("v"), int) or (link and "name" not in x):
            return False
        if "kids" in x and not (isinstance(x["kids"], list) and all(map(good, x["kids"]))):
            return False
        return "next" not in x or x["next"] is None or good(x["next"], True)

    rnd = random.Random(8)

    def value(depth):
        x = {"v": rnd.choice([1, 1, 1, 1, 1, 1, 1, "x"]), "name": "n"}
        if depth and rnd.random() < 0.8:
            x["kids"] = [value(depth - 1) for _ in range(rnd.randint(0, 2))]
        if depth and rnd.random() < 0.4:
            x["next"] = rnd.choice([None, value(depth - 1), value(depth - 1)])
        if rnd.random() < 0.1:
            del x["name"]
        return x

    deep = lambda last: json.loads('{"v":1,"kids":[' * 55 + last + "]}" * 55)
    values = [value(4) for _ in range(150)] + [deep('{"v":2}'), deep('{"v":"no"}'), 5, []]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", schema_errors(F.parse_json("t"), tree).alias("e")).collect()}
    assert {i: not e for i, e in got.items()} == {i: good(v) for i, v in enumerate(values)} and 20 < sum(map(good, values)) < 140
    assert got[151] == ["/kids/items" * 55 + "/v: is not of type integer"]


def test_more_schema_keywords(spark):
    from pyspark.sql import functions as F

    from gatewarden.functions.jsonshape import schema_errors

    cases = [
        ({"if": {"properties": {"a": {"const": 1}}}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {'{"a":1,"b":2}': [], '{"a":1}': [": lacks the property b"], '{"a":2}': [": lacks the property c"]}),
        ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "null"}}, {'["x",1,null]': [], '[1]': ["/items/0: is not of type string"], '["x","y",3]': ["/items/1: is not of type integer", "/items: is not of type null"], "{}": []}),
        ({"contains": {"minimum": 5}, "maxContains": 1}, {"[1,6]": [], "[1]": [": contains too few items that fit"], "[6,7]": [": contains too many items that fit"]}),
        ({"dependentRequired": {"a": ["b"]}}, {'{"a":1,"b":1}': [], "{}": [], '{"a":1}': [": lacks the property b, which a asks for"]}),
        ({"propertyNames": {"maxLength": 2}}, {'{"ab":1}': [], '{"abc":1}': [": has a property whose name does not fit"]}),
    ]
    for schema, values in cases:
        df = spark.createDataFrame([(t,) for t in values], "t string")
        assert {r.t: r.e for r in df.select("t", schema_errors(F.parse_json("t"), schema).alias("e")).collect()} == values


def test_only_tables_of_few_rows_and_bytes_are_broadcast(spark):
    few = spark.range(10).selectExpr("id", "repeat('x', 1000) AS text", "array(id) AS ids", "timestamp_seconds(id) AS at")
    sent = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert sent(lookups.small(few)) and sent(lookups.small(few.limit(0)))
    assert not sent(lookups.small(few, rows=9)) and not sent(lookups.small(few, size=5000))
