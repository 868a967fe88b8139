"""Alerts as they occur: sessions, escalations and limits of a stream of detections.

Rows may come in any order within the watermark.  They wait in the state until
the watermark has passed them, and are then taken in order of event time, by an
event-time timer; so the rows that come out are those of the batch form, however
the input was cut into batches.  A key's state goes when nothing can belong to
it any more.  Keys share buckets, and waiting rows lie there as chunks in order
of time, so calls to the state are by buckets and chunks, not by rows or keys.
Needs the RocksDB state store.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.severity import SEVERITIES
from ..operators import store, triage


#: Buckets that the keys of a stream share; each is one group of the state.
BUCKETS = 512

#: Rows of a bucket in a chunk of what waits or comes out, at most.
CHUNK = 100_000


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """A fold over each key's rows in order of (ts, event_id), each taken once the watermark has passed it.

    ``waiting``: DDL of the rows that wait; ts (seconds) and event_id come first.
    ``kept``: DDL of the carried state.  ``out``: names of the columns that come out behind the key.
    """

    key: str
    waiting: str
    kept: str
    out: tuple[str, ...]

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        """The state behind a row, and what comes out for it."""
        raise NotImplementedError

    def until(self, state: Any) -> float | None:
        """The second behind which the state is no longer needed; None if it is not needed now."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "first double, part string", "packed binary")
        self.state = handle.getMapState("kept", "key string", self.kept)
        self.names = [self.key, *(c.split()[0] for c in self.waiting.split(", "))]

    def _wait(self, rows: pa.Table) -> None:
        """Rows into chunks, known by their first time."""
        rows = rows.sort_by("ts")
        for begin in range(0, len(rows), CHUNK):
            self.rows.updateValue((rows["ts"][begin].as_py(), uuid.uuid4().hex), (_packed(rows.slice(begin, CHUNK)),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, gathered, size = math.inf, [], 0
        for pdf in rows:
            gathered.append(pa.Table.from_pandas(pdf[self.names], preserve_index=False))
            first, size = min(first, pdf["ts"].min()), size + len(pdf)
            if size >= CHUNK:
                self._wait(pa.concat_tables(gathered, promote_options="permissive"))
                gathered, size = [], 0
        if gathered:
            self._wait(pa.concat_tables(gathered, promote_options="permissive"))
        self.handle.registerTimer(max(math.ceil(first * 1e3), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=[self.key, *self.out])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        stored = {k[0]: tuple(v) for k, v in self.state.iterator()} if self.state.exists() else {}
        states, touched, out, after = dict(stored), set(), [], math.inf
        chunks = list(self.rows.keys()) if self.rows.exists() else []
        if later := [first for first, _ in chunks if first * 1e3 > watermark]:
            after = min(later) * 1e3
        if now := [at for at in chunks if at[0] * 1e3 <= watermark]:
            rows = pa.concat_tables([pa.ipc.open_stream(self.rows.getValue(at)[0]).read_all() for at in now], promote_options="permissive")
            rows = rows.sort_by([("ts", "ascending"), ("event_id", "ascending")])
            for at in now:
                self.rows.removeKey(at)
            due = int((rows["ts"].to_numpy() * 1e3 <= watermark).sum())
            if due < len(rows):
                self._wait(rows.slice(due))
                after = min(after, rows["ts"][due].as_py() * 1e3)
            for begin in range(0, due, CHUNK):
                piece = rows.slice(begin, min(CHUNK, due - begin))
                for name, *row in zip(*(piece[c].to_pylist() for c in self.names)):
                    states[name], found = self.step(states[name] if name in states else self.start(), tuple(row))
                    touched.add(name)
                    out.append((name, *found))
                yield pd.DataFrame(out, columns=[self.key, *self.out])
                out = []
        for name, state in states.items():
            end = self.until(state)
            end = watermark if end is None else math.floor(end * 1e3) + 1
            if end > watermark:
                after = min(after, end)
                if name in touched:
                    self.state.updateValue((name,), state)
            elif name in stored:
                self.state.removeKey((name,))
        if after < math.inf:
            self.handle.registerTimer(max(math.ceil(after), watermark + 1))
        yield pd.DataFrame(columns=[self.key, *self.out])

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    buckets = rows.withColumn("bucket", F.pmod(F.xxhash64(processor.key), BUCKETS).cast("int")).groupBy("bucket")
    return buckets.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def _priority(peak: int, count: int, hosts: int, top: float) -> str:
    """The band of ``triage.priority_score`` for running values, without an intel hit."""
    w, total = triage.PRIORITY_WEIGHTS, sum(triage.PRIORITY_WEIGHTS.values())
    volume = 0.0 if count <= 1 else min(1.0, math.log1p(count - 1) / math.log1p(triage.VOLUME_SATURATION))
    spread = 0.0 if hosts <= 1 else min(1.0, (hosts - 1) / (triage.SPREAD_SATURATION - 1))
    parts = {"severity": triage.SEVERITY_WEIGHT[SEVERITIES[peak]], "volume": volume, "spread": spread, "intel": 0.0, "confidence": max(0.0, min(1.0, top))}
    raw = 0.0
    for name, weight in w.items():
        raw += weight / total * parts[name]
    return next((band for floor, band in triage.BANDS if raw >= floor), "P5")


class _Triage(InOrder):
    key, waiting = "fingerprint", "ts double, event_id long, severity string, score double, host string, suppressed boolean"
    kept = "session_start double, last double, count long, peak int, top double, hosts array<string>, priority string"
    out = ("event_id", "ts", "session_start", "count", "priority", "is_new", "escalated", "forwarded")

    def __init__(self, window: float, at: str) -> None:
        self.window, self.at = window, at

    def start(self) -> tuple:
        return (None, None, 0, 0, 0.0, [], None)

    def until(self, state: tuple) -> float | None:
        return None if state[1] is None else state[1] + self.window

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        ts, event_id, severity, score, host, silent = row
        begin, last, count, peak, top, hosts, before = state
        if last is None or ts - last > self.window:
            begin, count, peak, top, hosts, before = ts, 0, 0, score, [], None
        # more hosts than saturate the spread change nothing
        hosts = list(hosts) + [host] if host is not None and host not in hosts and len(hosts) < triage.SPREAD_SATURATION else list(hosts)
        count, peak, top = count + 1, max(peak, SEVERITIES.index(severity)), max(top, score)
        priority = _priority(peak, count, len(hosts), top)
        escalated = before is not None and priority <= self.at < before and not silent
        forwarded = (before is None or escalated) and not silent
        # a suppressed alert is closed: what follows is new
        after = (begin, None if silent else ts, count, peak, top, hosts, priority)
        return after, (event_id, ts, begin, count, priority, before is None, escalated, forwarded)


def stream_alerts(detections: DataFrame, window: float = triage.DEDUP_WINDOW, at: str = "P2", late: str = "1 hour") -> DataFrame:
    """(fingerprint, event_id, ts, session_start, count, priority, is_new, escalated, forwarded) of each detection, once the watermark has passed it.

    detections: fingerprint, event_id, event_time, severity, score, host and, if
    there, suppressed.  The rows are those of ``triage_sessions`` and
    ``escalations``; a session is named by its first time, so its number needs
    no memory.  The state of a fingerprint is a session's sums and at most 25
    hosts, and goes when the watermark is a window behind its last detection.
    """
    silent = F.coalesce("suppressed", F.lit(False)) if "suppressed" in detections.columns else F.lit(False)
    ts = (F.unix_micros("event_time") / F.lit(1e6)).alias("ts")
    rows = detections.withWatermark("event_time", late).select("fingerprint", "event_time", ts, "event_id", "severity", F.col("score").cast("double").alias("score"), "host", silent.alias("suppressed"))
    schema = "fingerprint string, event_id long, ts double, session_start double, count long, priority string, is_new boolean, escalated boolean, forwarded boolean"
    return _in_order(rows, _Triage(window, at), schema)


class _Limit(InOrder):
    waiting, kept, out = "ts double, event_id long", "admitted array<double>, lost long, last double", ("event_id", "admitted", "dropped")

    def __init__(self, key: str, per_minute: int) -> None:
        self.key, self.per_minute = key, per_minute

    def start(self) -> tuple:
        return ([], 0, None)

    def until(self, state: tuple) -> float:
        return state[2] + store.MINUTE

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        times, lost, last = state
        lost = 0 if last is None or row[0] - last > store.MINUTE else lost
        recent = deque(t for t in times if t >= row[0] - store.MINUTE)
        admitted = len(recent) < self.per_minute
        if admitted:
            recent.append(row[0])
        lost += not admitted
        return (list(recent), lost, row[0]), (row[1], admitted, lost)


def stream_rate_limit(alerts: DataFrame, per_minute: int, key: str, late: str = "1 minute") -> DataFrame:
    """(key, event_id, admitted, dropped) as ``rate_limited`` gives them, once the watermark has passed an alert; keys are strings.

    The state of a key is its last admitted times, and goes a minute after its last alert.
    """
    rows = alerts.withWatermark("event_time", late).select(key, "event_time", (F.unix_micros("event_time") / F.lit(1e6)).alias("ts"), "event_id")
    return _in_order(rows, _Limit(key, per_minute), f"{key} string, event_id long, admitted boolean, dropped long")
