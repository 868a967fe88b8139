"""The batch columns over streams.

Times are event times with a watermark; rows later than it are dropped.  Sinks
are idempotent: what a batch wrote is replaced if the batch runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.checkpoints import new_path
from ..functions.parsing import normalize_events, parse_lines
from ..functions.predicates import run_hunts
from ..operators import graph, rules
from .keyed import KeyedTable

LATE = "1 hour"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they appear; path is a folder of files, or one file."""
    # a pattern that means the path itself: a stream takes the path of a file as a folder otherwise
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """(line) of text files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")


def run_every(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str, mode: str = "append") -> StreamingQuery:
    """A query that goes on, with a micro-batch each ``interval`` (``10 seconds``); what came meanwhile is one batch."""
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there in micro-batches and stop."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own under ``folder``, replaced if it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def parsed_events(lines: DataFrame, year: int | None = None) -> DataFrame:
    """The normalised events of a stream of lines of any format; lines that fail to parse go."""
    return normalize_events(parse_lines(lines, year=year).select("event.*"))


def stream_detections(events: DataFrame) -> DataFrame:
    """Rule detections, stateless."""
    return rules.rule_detections(events)


def stream_append(events: DataFrame, time: str = "event_time", key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_triage(detections: DataFrame, gap: str = "1 hour", time: str = "event_time", late: str = LATE) -> DataFrame:
    """Alerts by fingerprint and session: count, times and peak score.  A gap equal to the window still joins."""
    sessions = detections.withWatermark(time, late).groupBy("fingerprint", F.session_window(time, gap))
    return sessions.agg(F.count("*").alias("count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.max("score").alias("max_score")).drop("session_window")


def hunt_sink(folder: str, hunts: Mapping[str, Column | str]) -> Callable[[DataFrame, int], None]:
    """The counts of every hunt over each batch."""
    write = batch_sink(folder)
    return lambda batch, batch_id: write(run_hunts(batch, hunts), batch_id)


_SEEN = {"first_seen": "min", "last_seen": "max"}


def graph_tables(spark: SparkSession, root: str) -> tuple[KeyedTable, KeyedTable]:
    """The tables of nodes and of edges under ``root``, made if they are not there."""
    nodes = KeyedTable(spark, f"{root}/nodes", ["node"], {"event_count": "sum", **_SEEN})
    edges = KeyedTable(spark, f"{root}/edges", ["src", "dst", "type"], {"weight": "sum", **_SEEN})
    nodes.create("node string, event_count long, first_seen double, last_seen double")
    edges.create("src string, dst string, type string, weight long, first_seen double, last_seen double")
    return nodes, edges


def graph_sink(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """Merges a batch's nodes and edges into their tables; a batch that runs again changes neither."""
    nodes, edges = graph_tables(spark, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        nodes.merge(graph.graph_nodes(batch), batch_id)
        edges.merge(graph.graph_edges(batch), batch_id)

    return write


STREAM_STATE = "minute long, rate long, ports array<long>, procs array<string>, bytes long, seen int, means array<double>, vars array<double>"


def stream_statistical(events: DataFrame, z_threshold: float = 3.5, alpha: float = 0.05, min_buckets: int = 5) -> DataFrame:
    """(host, event_id, ts, z_max) of events above their host's baseline; keyed state for each host.

    The state is that of one minute and four running means and variances; events
    of a batch are taken in order of time, minute by minute, and one of a minute
    that is closed counts in the open one.  Needs the RocksDB state store.
    """
    import numpy as np
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    def so_far(values: pd.Series, known: list) -> np.ndarray:
        """How many different values there are up to each row, with those known before; nulls count nothing."""
        new = values.notna() & ~values.isin(known) & ~values.duplicated()
        return len(known) + new.cumsum().to_numpy()

    class Baseline(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("host", STREAM_STATE)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            minute, rate, ports, procs, size, seen, mean, var = self.state.get() if self.state.exists() else (None, 0, [], [], 0, 0, [0.0] * 4, [1.0] * 4)
            ports, procs, mean, var = list(ports), list(procs), np.array(mean), np.array(var)
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            # an event that comes late counts in the minute that is open
            batch["minute"] = (batch["ts"] // 60).astype("int64").clip(lower=minute)
            out = [pd.DataFrame({"host": [], "event_id": [], "ts": [], "z_max": []})]
            for now, part in batch.groupby("minute", sort=True):
                if minute is not None and now != minute:
                    closed = np.array([rate, len(ports), len(procs), size], dtype=float)
                    delta = closed - mean
                    mean, var = (closed, np.ones(4)) if seen == 0 else (mean + alpha * delta, (1 - alpha) * (var + alpha * delta**2))
                    seen, rate, ports, procs, size = seen + 1, 0, [], [], 0
                figures = np.column_stack([rate + np.arange(1, len(part) + 1), so_far(part["dst_port"], ports), so_far(part["process"], procs), size + part["bytes_sent"].fillna(0).cumsum()])
                if seen >= min_buckets:
                    z = ((figures - mean) / np.sqrt(np.maximum(var, 1e-6))).max(axis=1)
                    hot = z > z_threshold
                    out.append(pd.DataFrame({"host": key[0], "event_id": part["event_id"][hot], "ts": part["ts"][hot], "z_max": z[hot]}))
                minute, rate, size = int(now), int(figures[-1, 0]), int(figures[-1, 3])
                ports = list({*ports, *map(int, part["dst_port"].dropna())})
                procs = list({*procs, *part["process"].dropna()})
            self.state.update((minute, rate, ports, procs, size, int(seen), mean.tolist(), var.tolist()))
            yield pd.concat(out).astype({"host": object, "event_id": "int64", "ts": float, "z_max": float})

        def close(self) -> None:
            pass

    needed = events.select("host", "event_id", "ts", "dst_port", "process", "bytes_sent")
    return needed.groupBy("host").transformWithStateInPandas(statefulProcessor=Baseline(), outputStructType="host string, event_id long, ts double, z_max double", outputMode="append", timeMode="none")


def folders(spark: SparkSession) -> tuple[str, str]:
    """A new result folder and a new checkpoint folder in the place that executors share."""
    return new_path(spark, "stream"), new_path(spark, "stream-state")
