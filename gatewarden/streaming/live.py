"""The same operations on streams: replies reassembled and restored chunk by chunk, rates by window, rules rebuilt by batch. Limits kept as state are in ``guards``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatewarden.operators.audit import verdict_rates

EVENTS = "request_id string, event string"
PIECES = "request_id string, text string"
WINDOW = 64
IDLE_MS = 24 * 3600 * 1000


def split_events(buffer: str) -> tuple[list[str], str]:
    """Events ended by a blank line, and what is left."""
    parts = re.split(r"\r\n\r\n|\n\n", buffer)
    return parts[:-1], parts[-1]


class InOrder(StatefulProcessor):
    """Pieces (request_id, seq from 0, last) put in order across batches.

    State: what the subclass carries over, the next seq, pieces that came early, and the seq of the last piece. It
    goes when a reply ends, and when nothing came for ``IDLE_MS``, so replies that never end do not pile up.
    """

    column = "chunk"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "carried string, next long, early string, last long", IDLE_MS)

    def taken(self, rows: Iterator[pd.DataFrame]) -> tuple[str, str, bool]:
        """What was carried over, the text that is in order now, and whether the reply has ended."""
        carried, after, early, last = self.state.get() if self.state.exists() else ("", 0, "{}", -1)
        held = {int(k): v for k, v in json.loads(early).items()}
        for part in rows:
            for seq, text, end in zip(part["seq"], part[self.column], part["last"], strict=True):
                held[int(seq)] = text
                last = int(seq) if end else last
        text = ""
        while after in held:
            text += held.pop(after)
            after += 1
        self._next = (after, json.dumps(held), last)
        return carried, text, 0 <= last < after

    def kept(self, carried: str, ended: bool) -> None:
        if ended:
            self.state.clear()
        else:
            self.state.update((carried, *self._next))

    def close(self) -> None:
        pass


class Reassembly(InOrder):
    """Chunks to events; carried over: the text after the last blank line, which goes out as it is at the end."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, text, ended = self.taken(rows)
        events, rest = split_events(rest + text)
        if ended and rest:
            events.append(rest)
        self.kept(rest, ended)
        if events:
            yield pd.DataFrame({"request_id": [key[0]] * len(events), "event": events})


def reassemble(chunks: DataFrame) -> DataFrame:
    """A stream of chunks as a stream of events, in update or append mode."""
    return chunks.groupBy("request_id").transformWithStateInPandas(Reassembly(), EVENTS, "append", "processingTime")


def restore_window(pending: str, text: str, entries: dict[str, str]) -> tuple[str, str]:
    """What may go out now, and what may still become a placeholder (kept back, at most WINDOW bytes).

    Bracket by bracket: one that is not closed within WINDOW bytes is no placeholder.
    """
    out: list[str] = []
    text = pending + text
    at = 0
    while (start := text.find("[", at)) >= 0:
        out.append(text[at:start])
        stop = text.find("]", start, start + WINDOW)
        whole = text[start : stop + 1] if stop >= 0 else text[start : start + WINDOW]
        size = 0
        for end, ch in enumerate(whole, 1):
            size += len(ch.encode())
            if size >= WINDOW and ch != "]":
                break
        else:
            if stop < 0:  # all that is left, and short enough
                return "".join(out), text[start:]
        closed = stop >= 0 and end == len(whole)
        out.append(entries.get(whole, whole) if closed else whole[:end])
        at = start + end
    return "".join([*out, text[at:]]), ""


class Restoring(InOrder):
    """Pieces of text with placeholders restored; carried over: the text of an open bracket.

    Each piece comes with its request's ``vault`` (placeholders and originals). What is open at the end goes out if ``emit_rest``.
    """

    column = "text"

    def __init__(self, emit_rest: bool = True) -> None:
        self.emit_rest = emit_rest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}

        def noted() -> Iterator[pd.DataFrame]:
            for part in rows:
                for vault in part["vault"]:
                    if vault is not None and len(vault):
                        known.update(vault if isinstance(vault, dict) else dict(vault))
                        break
                yield part

        pending, text, ended = self.taken(noted())
        out, pending = restore_window(pending, text, known) if known else (pending + text, "")
        if ended and self.emit_rest:
            out += pending
        self.kept(pending, ended)
        if out:
            yield pd.DataFrame({"request_id": [key[0]], "text": [out]})


def restore(pieces: DataFrame, vaults: DataFrame, emit_rest: bool = True) -> DataFrame:
    """A stream of pieces with the placeholders of their request's vault (request_id, vault: map) restored.

    Vaults are a table that the stream is joined with; no task holds those of other requests.
    """
    both = pieces.join(vaults.select("request_id", "vault"), "request_id", "left")
    return both.groupBy("request_id").transformWithStateInPandas(Restoring(emit_rest), PIECES, "append", "processingTime")


def block_rates(entries: DataFrame, at: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Rates of blocks by window; entries later than ``late`` are left out and windows are emitted once closed."""
    return verdict_rates(entries.withWatermark(at, late), at, width)


def attempt_rates(attempts: DataFrame, minutes: int = 15, step: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Failed attempts by user in sliding windows, for alarms on streams."""
    by = attempts.withWatermark("attempted_at", late).where("not success").groupBy("username", F.window("attempted_at", f"{minutes} minutes", step).alias("w"))
    return by.agg(F.count("*").alias("n")).select("username", F.col("w.start").alias("start"), "n")


def guarded_stream(requests: DataFrame, build, apply, path: str, checkpoint: str):
    """Runs requests through an engine that is built anew for every batch, so a changed rule file takes effect.

    ``build()`` returns an engine; if it raises, the engine before it goes on. Each batch writes a folder of its own
    (``batch=<id>``) anew, so a batch that is run again after a failure doubles nothing.
    """
    held = {"engine": build()}

    def batch(df: DataFrame, number: int) -> None:
        try:
            held["engine"] = build()
        except (ValueError, OSError):
            pass
        apply(held["engine"], df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
