"""Guards on live streams: the tool gate, quotas, login locks, and spend that counts once.

Rows of a key are taken in the order of their time: they wait in the state until the watermark has passed them, so late and
repeated rows, and how rows fall into batches, change nothing. Rows that come after the watermark has passed their time are dropped, as everywhere.
Decisions themselves are columns, the same as in batch; state only keeps what came before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatewarden.operators.sse import deny_event
from gatewarden.operators.tools import ToolGate
from gatewarden.streaming.live import IDLE_MS, InOrder, split_events


class ByTime(StatefulProcessor):
    """Rows (key, at_us: microseconds, id) handed to ``taken`` in the order of time, then id, once the watermark has passed them.

    Of rows with one id, those that wait together, the first in that order counts. State: the rows that wait, and what
    ``taken`` carries over (null: it is as at first). A timer stands for every time at which rows wait.
    """

    waiting, carried = "at_us long", "none string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", self.waiting)
        self.state = handle.getValueState("carried", self.carried)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = {"long": int, "string": str, "boolean": bool}  # whole numbers come as floats where some are null
        fields = [(n, made[kind]) for n, kind in (f.split() for f in self.waiting.split(", "))]
        for part in rows:
            for row in zip(*[[None if pd.isna(v) else kind(v) for v in part[n]] for n, kind in fields], strict=True):
                self.rows.appendValue(row)
                self.handle.registerTimer(row[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [tuple(r) for r in self.rows.get()]
        due = sorted((r for r in held if r[0] < until), key=lambda r: r[:2])
        if not due:
            return
        rest = [r for r in held if r[0] >= until]
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        seen, once = set(), []
        for r in due:
            if r[1] not in seen:
                seen.add(r[1])
                once.append(r)
        carried, out = self.taken(tuple(self.state.get()) if self.state.exists() else None, once)
        if carried is None:
            self.state.clear()
        else:
            self.state.update(carried)
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=[f.split()[0] for f in self.out.split(", ")])

    def taken(self, carried: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _by_time(rows: DataFrame, key: str, at: str, late: str, processor: ByTime) -> DataFrame:
    timed = rows.withWatermark(at, late).withColumn("at_us", F.unix_micros(F.col(at).cast("timestamp")))
    return timed.groupBy(key).transformWithStateInPandas(processor, processor.out, "append", "eventTime")


class Quota(ByTime):
    """Requests, changes of the limit and resets of one key. State: tokens spent since the last reset, the limit, and whether there is one."""

    waiting, carried = "at_us long, id string, kind string, tokens long", "spent long, most long, limited boolean"

    def __init__(self, key_type: str) -> None:
        self.out = f"api_key {key_type}, id string, admitted boolean, spent_before long"

    def taken(self, carried: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        spent, most, limited = carried or (0, 0, False)
        out = []
        for _, name, kind, tokens in rows:
            if kind == "limit":
                most, limited = tokens or 0, tokens is not None
            elif kind == "reset":
                spent = 0
            else:
                admitted = not limited or spent < most
                out.append((name, admitted, spent))
                spent += (tokens or 0) * admitted
        return (spent, most, limited), out


def quota_stream(requests: DataFrame, changes: DataFrame | None = None, resets: DataFrame | None = None, late: str = "5 minutes") -> DataFrame:
    """api_key, id, admitted, spent_before of a stream of requests (api_key, id, at, tokens).

    ``changes`` (api_key, id, at, token_limit; null clears the limit) and ``resets`` (api_key, id, at) are streams too. A request is
    checked before it runs against what was admitted since the key's last reset; refused ones spend nothing. Of things at one time the smaller id is first; ids are texts,
    and differ between the three streams. Keys without a limit are not limited.
    """
    fields = lambda df, kind, tokens: df.select("api_key", "at", F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), tokens.cast("long").alias("tokens"))
    rows = fields(requests, "request", F.col("tokens"))
    if changes is not None:
        rows = rows.unionByName(fields(changes, "limit", F.col("token_limit")))
    if resets is not None:
        rows = rows.unionByName(fields(resets, "reset", F.lit(0)))
    return _by_time(rows, "api_key", "at", late, Quota(requests.schema["api_key"].dataType.simpleString()))


class Locks(ByTime):
    """Login attempts of one user. State: times of the failures that still count, and until when the account is locked (0: it is not)."""

    waiting, carried = "at_us long, id string, success boolean", "failures string, until long"

    def __init__(self, most: int, minutes: int) -> None:
        self.most, self.span = most, minutes * 60_000_000
        self.out = "username string, id string, outcome string, failures int"

    def taken(self, carried: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        failures, until = (json.loads(carried[0]), carried[1]) if carried else ([], 0)
        out = []
        for at, name, success in rows:
            if until and at >= until:
                until = 0
            failures = [t for t in failures if at - t < self.span]
            if until:
                outcome = "refused"
            elif success:
                outcome, failures = "ok", []
            else:
                failures.append(at)
                locked = len(failures) >= self.most
                until = at + self.span if locked else 0
                outcome = "locked" if locked else "failed"
            out.append((name, outcome, len(failures)))
        if until or failures:  # what is kept goes by itself when it no longer counts
            self.handle.registerTimer(max(until, failures[-1] + self.span if failures else 0) // 1000 + 1)
            return (json.dumps(failures), until), out
        return None, out

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.state.exists():
            failures, until = self.state.get()
            if until <= now and all(t + self.span <= now for t in json.loads(failures)):
                self.state.clear()


def lockout_stream(attempts: DataFrame, most: int = 10, minutes: int = 15, late: str = "5 minutes") -> DataFrame:
    """username, id, outcome (ok, failed, locked, refused) and failures that count, of a stream of attempts (username, id, at, success).

    So many failures within the minutes lock the account for as long; attempts at a locked account are refused and do not count. A success clears the
    failures. A lock ends by its time, and state of accounts without failures that count goes.
    """
    rows = attempts.select(F.col("username").cast("string").alias("username"), "at", F.col("id").cast("string").alias("id"), "success")
    return _by_time(rows, "username", "at", late, Locks(most, minutes))


CALL = "struct<index: bigint, id: string, name: string, arguments: string>"
COLLECTED = f"request_id string, i long, event string, calls array<{CALL}>, ended boolean"


def merged_calls(event: str, held: dict[int, list[str | None]]) -> list[dict[str, Any]]:
    """Takes an event's deltas of calls into ``held``, by index; the calls that a finish in it completes, in the order of their index."""
    out: list[dict[str, Any]] = []
    for line in event.splitlines():
        if not line.startswith("data:"):
            continue
        try:
            data = json.loads(line[5:].strip())
        except ValueError:
            continue
        choices = data.get("choices") if isinstance(data, dict) else None
        for choice in choices if isinstance(choices, list) else ():
            delta = choice.get("delta") if isinstance(choice, dict) else None
            calls = delta.get("tool_calls") if isinstance(delta, dict) else None
            for call in calls if isinstance(calls, list) else ():
                if not isinstance(call, dict):
                    continue
                index = call.get("index")
                mine = held.setdefault(index if isinstance(index, int) and not isinstance(index, bool) and index >= 0 else 0, [None, None, ""])
                function = call.get("function") if isinstance(call.get("function"), dict) else {}
                for place, value in enumerate((call.get("id"), function.get("name"))):
                    mine[place] = value if isinstance(value, str) else mine[place]
                mine[2] += function["arguments"] if isinstance(function.get("arguments"), str) else ""
            if isinstance(choice, dict) and choice.get("finish_reason") == "tool_calls":
                out += [{"index": i, "id": x[0] or "", "name": x[1], "arguments": x[2] or "{}"} for i, x in sorted(held.items()) if x[1] is not None]
                held.clear()
    return out


class Collecting(InOrder):
    """Chunks to events with the calls that each completes. State besides what is carried over: calls by index, and the number of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.calls = handle.getMapState("calls", "index long", "id string, name string, arguments string", IDLE_MS)
        self.count = handle.getValueState("count", "n long", IDLE_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, text, ended = self.taken(rows)
        events, rest = split_events(rest + text)
        if ended and rest:
            events.append(rest)
        self.kept(rest, ended)
        n = self.count.get()[0] if self.count.exists() else 0
        held = {int(k[0]): list(v) for k, v in self.calls.iterator()} if self.calls.exists() else {}
        before = set(held)
        out = [(key[0], n + k, event, merged_calls(event, held), ended and k == len(events) - 1) for k, event in enumerate(events)]
        if ended and not out:
            out = [(key[0], n, None, [], True)]
        if ended:
            self.calls.clear()
            self.count.clear()
        else:
            for index in before - set(held):
                self.calls.removeKey((index,))
            for index, call in held.items():
                self.calls.updateValue((index,), tuple(call))
            self.count.update((n + len(events),))
        if out:
            yield pd.DataFrame(out, columns=["request_id", "i", "event", "calls", "ended"])


class Forwarding(StatefulProcessor):
    """Events in order until one is refused; in its place the event that ends the stream, and nothing after it.

    State: whether the stream was ended by the gate. It goes with the end of the reply.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shut = handle.getValueState("shut", "shut boolean", IDLE_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shut, out, over = self.shut.exists(), [], False
        for row in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.i):
            over = over or bool(row.ended)
            if shut or (row.event is None and row.denial is None):
                continue
            shut = row.denial is not None
            out.append((key[0], row.i, row.denial if shut else row.event, shut))
        if over:
            self.shut.clear()
        elif shut:
            self.shut.update((True,))
        if out:
            yield pd.DataFrame(out, columns=["request_id", "i", "event", "denied"])

    def close(self) -> None:
        pass


def judged_calls(calls: Column, gate: ToolGate) -> Column:
    """The event that ends a stream if the gate denies any of the calls, else null. Sanitizing counts as allowed here."""
    reasons = F.transform(calls, lambda c: F.when(gate.decision(c["name"], c["arguments"])["decision"] == "deny", gate.decision(c["name"], c["arguments"])["reason"]))
    found = F.filter(reasons, lambda r: r.isNotNull())
    return F.when(F.size(found) > 0, deny_event(found))


def gated_stream(chunks: DataFrame, gate: ToolGate) -> DataFrame:
    """request_id, i, event, denied of a stream of chunks (request_id, seq, chunk, last), in append mode.

    Calls are merged by index over events; at each finish they are judged by the gate's columns. An event whose calls are denied is
    replaced by the event that ends the stream, and what comes after it is dropped, in later batches too.
    """
    events = chunks.groupBy("request_id").transformWithStateInPandas(Collecting(), COLLECTED, "append", "processingTime")
    judged = events.select("request_id", "i", "event", "ended", F.when(F.size("calls") > 0, judged_calls(F.col("calls"), gate)).alias("denial"))
    return judged.groupBy("request_id").transformWithStateInPandas(Forwarding(), "request_id string, i long, event string, denied boolean", "append", "processingTime")


def spend_sink(used: DataFrame, path: str, checkpoint: str):
    """Writes a stream of spend (request_id, api_key, tokens and others) as a ledger in which every reply counts once.

    Each batch writes a folder of its own (``batch=<id>``) anew, so one that is run again after a failure changes nothing; replies that came in
    an earlier batch are told apart when the ledger is read (``spend_ledger``).
    """

    def batch(df: DataFrame, number: int) -> None:
        df.dropDuplicates(["request_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return used.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def spend_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger's rows, one a reply: that of its first batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    names = [c for c in rows.columns if c not in ("request_id", "batch")]
    first = rows.groupBy("request_id").agg(F.min_by(F.struct(*names), F.struct("batch", *names)).alias("r"))
    return first.select("request_id", "r.*")
