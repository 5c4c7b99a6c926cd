import json

from pyspark.sql import functions as F

from gatewarden.operators import ledger, sse
from gatewarden.streaming import live


def test_batch_reassembly(spark):
    rows = [("r", 1, 'data: {"choices":[{"delta":{"content":"a ssn"}}]}\n'), ("r", 2, "\ndata: [DONE]\r\n\r\ntail"), ("s", 1, ": c\n\n")]
    got = {r.request_id: r for r in sse.reassembled(spark.createDataFrame(rows, "request_id string, seq int, chunk string")).collect()}
    assert got["r"].events == ['data: {"choices":[{"delta":{"content":"a ssn"}}]}', "data: [DONE]"] and got["r"].rest == "tail" and got["s"].rest == ""


def test_window_of_placeholders():
    entries = {"[EMAIL_1]": "a@b.io"}
    out, pending = "", ""
    for ch in "x [EMAIL_1] [no] [" + "y" * 70 + "] [EMAIL_1":
        part, pending = live.restore_window(pending, ch, entries)
        out += part
    assert out == "x a@b.io [no] [" + "y" * 70 + "] " and pending == "[EMAIL_1"


def test_stream_equals_batch(spark, tmp_path):
    source, events = tmp_path / "in", ["data: one", ": two", "data: [DONE]"]
    source.mkdir()
    text = "".join(e + "\n\n" for e in events) + "rest"
    cuts = [text[i : i + 5] for i in range(0, len(text), 5)]
    for i, c in enumerate(cuts):
        (source / f"{i:03}.json").write_text(json.dumps({"request_id": "r", "seq": i, "chunk": c, "last": i == len(cuts) - 1}) + "\n")
    chunks = spark.readStream.schema("request_id string, seq int, chunk string, last boolean").option("maxFilesPerTrigger", 4).json(str(source))
    q = live.reassemble(chunks).writeStream.format("memory").queryName("events").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.event for r in spark.table("events").collect()) == sorted([*events, "rest"])


def test_quota_equals_a_ledger(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, rnd.randrange(4), i, rnd.randrange(50)) for i in range(400)]
    limits = {0: 100, 1: 1000, 2: 0}
    df = spark.createDataFrame(rows, "event_id int, api_key int, t int, tokens long")
    got = ledger.admitted(df, spark.createDataFrame(list(limits.items()), "api_key int, token_limit long"), F.floor(F.col("t") / 50), ["t"]).collect()
    spent, want = {}, {}
    for i, k, _, n in rows:
        want[i] = k not in limits or spent.get(k, 0) < limits[k]
        spent[k] = spent.get(k, 0) + n * want[i]
    assert {r.event_id: r.admitted for r in got} == want


def test_restored_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pieces = ["to [REDACT", "ED_EMAIL_1] ple", "ase [x"]
    for i in (2, 0, 1):
        (source / f"{i}.json").write_text(json.dumps({"request_id": "r", "seq": i, "text": pieces[i], "last": i == 2}) + "\n")
    rows = spark.readStream.schema("request_id string, seq int, text string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    vaults = spark.createDataFrame([("r", {"[REDACTED_EMAIL_1]": "a@b.io"}), ("s", {"[X_1]": "y"})], "request_id string, vault map<string, string>")
    q = live.restore(rows, vaults).writeStream.format("memory").queryName("restored").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted("".join(r.text for r in spark.table("restored").collect())) == sorted("to a@b.io please [x")


def test_windows_of_placeholders_at_every_cut():
    """The same by characters, one after another."""
    import random

    def plain(text, entries):
        out, pending = [], ""
        for ch in text:
            if not pending:
                if ch == "[":
                    pending = ch
                else:
                    out.append(ch)
                continue
            pending += ch
            if ch == "]":
                out.append(entries.get(pending, pending))
                pending = ""
            elif len(pending.encode()) >= live.WINDOW:
                out.append(pending)
                pending = ""
        return "".join(out), pending

    rnd, entries = random.Random(4), {"[A_1]": "x", "[B_2]": "[y]"}
    for _ in range(400):
        text = "".join(rnd.choice(["[A_1]", "[B_2]", "[", "]", "é", "日" * rnd.randrange(25), "ab", "[none]", "z" * rnd.randrange(70)]) for _ in range(rnd.randrange(12)))
        out, pending, at = "", "", 0
        while at < len(text):
            step = rnd.randrange(1, 30)
            part, pending = live.restore_window(pending, text[at : at + step], entries)
            out, at = out + part, at + step
        assert (out, pending) == plain(text, entries)


def test_counts_of_a_hot_user_by_definition(spark):
    import random
    from datetime import datetime, timedelta

    rnd, rows, now = random.Random(5), [], datetime(2024, 1, 1)
    for i in range(900):
        now += timedelta(seconds=rnd.choice([1, 20, 90, 1000]))
        rows.append((i, "u" if rnd.random() < 0.8 else "v", now, rnd.random() < 0.1))
    df = spark.createDataFrame(rows, "attempt_id int, username string, attempted_at timestamp, success boolean")
    near = lambda a, b: a[1] == b[1] and timedelta(0) <= a[2] - b[2] < timedelta(minutes=15)
    got = {r.attempt_id: r.n for r in ledger.recent_counts(df, "username", 15, "n").collect()}
    assert got == {a[0]: sum(near(a, b) for b in rows[: a[0] + 1]) for a in rows}
    want = {}
    for a in rows:
        if not a[3]:
            last = max((b[0] for b in rows[: a[0]] if b[1] == a[1] and b[3]), default=-1)
            want[a[0]] = sum(near(a, b) and not b[3] and b[0] > last for b in rows[: a[0] + 1])
    assert {r.attempt_id: r.recent for r in ledger.lockouts(df, 4).collect()} == want
