"""Guards on streams against plain ledgers and against batch, however rows fall into batches."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gatewarden.operators import ledger, sse
from gatewarden.operators.tools import ToolGate
from gatewarden.streaming import guards

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def stamp(t):
    return (START + timedelta(seconds=t)).isoformat()


def streamed(spark, tmp_path, name, batches, schema):
    """Rows (dicts) as a stream of files, one a batch."""
    source = tmp_path / name
    source.mkdir()
    for k, rows in enumerate(batches):
        (source / f"{k:04}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))


def ran(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


def shuffled(rnd, rows, near):
    """Rows in batches, out of order by at most so many seconds, some of them twice."""
    late = sorted(rows + [r for r in rows if rnd.random() < 0.15], key=lambda r: r["t"] + rnd.uniform(0, near))
    cuts = sorted(rnd.sample(range(1, len(late)), 2))
    return [[{**r, "at": stamp(r["t"])} for r in late[a:b]] for a, b in zip([0, *cuts], [*cuts, len(late)], strict=True)]


def test_quota_stream_equals_a_ledger(spark, tmp_path):
    rnd, rows = random.Random(1), []
    for i in range(160):
        kind = rnd.choice(["request"] * 8 + ["limit", "reset"])
        rows.append({"id": f"{i:04}", "api_key": rnd.randrange(3), "t": 7 * i + rnd.randrange(5), "kind": kind, "tokens": rnd.choice([0, 5, 40]) if kind == "request" else rnd.choice([None, 60, 200])})
    spent, limit, want = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        k = r["api_key"]
        if r["kind"] == "limit":
            limit[k] = r["tokens"]
        elif r["kind"] == "reset":
            spent[k] = 0
        else:
            want[r["id"]] = limit.get(k) is None or spent.get(k, 0) < limit[k]
            spent[k] = spent.get(k, 0) + r["tokens"] * want[r["id"]]
    end = [{"id": "end", "api_key": 9, "at": stamp(10_000), "kind": "request", "tokens": 0, "t": 0}]
    source = streamed(spark, tmp_path, "in", [*shuffled(rnd, rows, 60), end], "id string, api_key int, at timestamp, kind string, tokens long")
    of = lambda kind: source.where(F.col("kind") == kind).drop("kind")
    got = ran(spark, guards.quota_stream(of("request"), of("limit").withColumnRenamed("tokens", "token_limit"), of("reset").drop("tokens"), "2 minutes"), tmp_path, "quota")
    assert {r.id: r.admitted for r in got if r.api_key < 9} == want and len([r for r in got if r.api_key < 9]) == len(want) and set(want.values()) == {True, False}


def test_quota_stream_equals_the_batch_form(spark, tmp_path):
    rnd = random.Random(3)
    rows = [{"id": f"{i:04}", "api_key": rnd.randrange(4), "t": 5 * i, "tokens": rnd.randrange(50)} for i in range(80)]
    limits = [(0, 100), (1, 1000), (2, 0)]
    df = spark.createDataFrame([(r["id"], r["api_key"], r["t"], r["tokens"]) for r in rows], "id string, api_key int, t int, tokens long")
    batch = ledger.admitted(df, spark.createDataFrame(limits, "api_key int, token_limit long"), F.floor(F.col("t") / 50), ["t"]).collect()
    both = [{**r, "kind": "request", "at": stamp(r["t"])} for r in rows]
    first = [{"id": f"l{k}", "api_key": k, "at": stamp(-1), "kind": "limit", "tokens": n} for k, n in limits]
    end = [{"id": "end", "api_key": 9, "at": stamp(10_000), "kind": "request", "tokens": 0}]
    source = streamed(spark, tmp_path, "in", [first + both[:40], both[40:], end], "id string, api_key int, at timestamp, kind string, tokens long")
    of = lambda kind: source.where(F.col("kind") == kind).drop("kind")
    got = ran(spark, guards.quota_stream(of("request"), of("limit").withColumnRenamed("tokens", "token_limit")), tmp_path, "quota_batch")
    assert {r.id: r.admitted for r in got if r.api_key < 9} == {r.id: r.admitted for r in batch}


def test_lockouts_equal_a_ledger(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for i in range(220):
        rows.append({"id": f"{i:04}", "username": rnd.choice("uuuv"), "t": (rows[-1]["t"] if rows else 0) + rnd.choice([5, 30, 200, 1200]), "success": rnd.random() < 0.12})
    state, want = {}, {}
    for r in rows:
        failures, until = state.get(r["username"], ([], 0))
        failures = [t for t in failures if r["t"] - t < 900]
        until = 0 if r["t"] >= until else until
        if until:
            want[r["id"]] = ("refused", len(failures))
        elif r["success"]:
            failures = []
            want[r["id"]] = ("ok", 0)
        else:
            failures.append(r["t"])
            until = r["t"] + 900 if len(failures) >= 4 else 0
            want[r["id"]] = ("locked" if until else "failed", len(failures))
        state[r["username"]] = failures, until
    end = [{"id": "end", "username": "z", "at": stamp(10**6), "success": True}]
    source = streamed(spark, tmp_path, "in", [*shuffled(rnd, rows, 60), end], "id string, username string, at timestamp, success boolean")
    got = ran(spark, guards.lockout_stream(source, 4, 15, "2 minutes"), tmp_path, "locks")
    mine = [r for r in got if r.username != "z"]
    assert {r.id: (r.outcome, r.failures) for r in mine} == want and len(mine) == len(want)
    assert {o for o, _ in want.values()} == {"ok", "failed", "locked", "refused"}


def reply(rnd, denied):
    """Events of a reply with calls in pieces, in one or two rounds."""
    delta = lambda call: "data: " + json.dumps({"choices": [{"delta": {"tool_calls": [call]}}]})
    out = [": hello", 'data: {"choices":[{"delta":{"content":"hi"}}]}']
    for k in range(rnd.randint(1, 2)):
        name = "delete_user" if denied and k == 0 else "search"
        out += [delta({"index": 1, "id": "b", "function": {"name": name}}), delta({"index": 0, "id": "a", "function": {"name": "look", "arguments": '{"x"'}}), "data: not json", delta({"index": 0, "function": {"arguments": ": 1}"}}), delta({"index": 3, "function": {"arguments": "nameless"}})]
        out.append('data: {"choices":[{"delta":{},"finish_reason":"tool_calls"}]}')
    return [*out, 'data: {"choices":[{"delta":{"content":"bye"}}]}', "data: [DONE]"]


def test_gated_streams_equal_batch_for_every_cutting(spark, tmp_path):
    rnd, gate = random.Random(5), ToolGate(deny=("delete_*",))
    replies = {f"r{i}": reply(rnd, i % 2 == 1) for i in range(6)}
    chunks = []
    for r, events in replies.items():
        text, at, seq = "".join(e + rnd.choice(["\n\n", "\r\n\r\n"]) for e in events) + rnd.choice(["", "tail"]), 0, 0
        while at < len(text):
            step = rnd.choice([1, 7, 40, 400])
            chunks.append({"request_id": r, "seq": seq, "chunk": text[at : at + step], "last": at + step >= len(text)})
            at, seq = at + step, seq + 1
    rnd.shuffle(chunks)
    cuts = sorted(rnd.sample(range(1, len(chunks)), 2))
    batches = [chunks[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunks)], strict=True)]
    schema = "request_id string, seq int, chunk string, last boolean"
    got = ran(spark, guards.gated_stream(streamed(spark, tmp_path, "in", batches, schema), gate), tmp_path, "gated")
    whole = sse.reassembled(spark.createDataFrame([tuple(c.values()) for c in chunks], schema))
    want = {(r.request_id, k, e) for r in sse.gated(whole, gate).collect() for k, e in enumerate(r.events)}
    assert {(r.request_id, r.i, r.event) for r in got} == want
    ends = {r.request_id: r.event for r in got if r.denied}
    assert set(ends) == {"r1", "r3", "r5"} and all("tool `delete_user` is on the deny list" in e and e.endswith("data: [DONE]\n\n") for e in ends.values())
    assert not any(r.event.startswith("data: [DONE]") for r in got if r.request_id in ends)


def test_calls_are_merged_by_index():
    held = {}
    assert guards.merged_calls('data: {"choices":[{"delta":{"tool_calls":[{"index":2,"id":"x","function":{"name":"a","arguments":"{"}},{"function":{"name":"z"}}]}}]}', held) == []
    done = guards.merged_calls('data: {"choices":[{"delta":{"tool_calls":[{"index":2,"function":{"arguments":"}"}}]},"finish_reason":"tool_calls"}]}', held)
    assert done == [{"index": 0, "id": "", "name": "z", "arguments": "{}"}, {"index": 2, "id": "x", "name": "a", "arguments": "{}"}] and held == {}
    assert guards.merged_calls("data: 5\ndata: {\"choices\": 3}\n: note\ndata: [DONE]", held) == [] and held == {}


def test_spend_counts_once(spark, tmp_path):
    """A reply that comes again, and a batch that is run again after a failure, change no total."""
    rows = [{"request_id": f"r{i}", "api_key": i % 3, "tokens": 10 + i} for i in range(9)]
    path, schema = str(tmp_path / "ledger"), "request_id string, api_key int, tokens long"
    source = streamed(spark, tmp_path, "in", [rows[:5], [*rows[4:], rows[0], rows[8]]], schema)
    q = guards.spend_sink(source, path, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    total = lambda: {r.api_key: r.total for r in ledger.usage(guards.spend_ledger(spark, path, schema).withColumn("ts", F.lit(0))).collect()}
    want = {k: sum(r["tokens"] for r in rows if r["api_key"] == k) for k in range(3)}
    assert total() == want
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    last.unlink()  # as if the driver had died before the batch was noted
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    q = guards.spend_sink(streamed_again(spark, tmp_path, schema), path, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert total() == want


def streamed_again(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
