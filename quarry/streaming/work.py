"""Steps of work as a stream: transitions, leases that run out by themselves, and the same over a table.

A step is ready, is claimed by a worker for a time (the lease), and ends or is tried again. Events are claim, heartbeat, finish and
fail (of the worker that holds the lease), hold, approve, reopen and cancel. A lease that isn't renewed runs out: at the next event of the step, or, where none comes, as soon as the watermark has
passed it (a timer). Either way the log says when it ran out, so that a stream in any number of batches and a replay of the whole
table (`replayed`) give the same log.

Each step's state is its last row; rows that come for a step in one batch are taken in the order of time, then id. Ended steps are
forgotten after a time to live; an event for one that is forgotten counts as the first of a new step.

Defined results: an event without a step, a kind or a time takes no part; one that its step's state doesn't allow is logged as
rejected and changes nothing; so is one that comes after a later one was taken in an earlier batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: From each state of a step the states that may follow, and states that end it.
TRANSITIONS = {
    "pending": ("ready", "skipped", "canceled"), "ready": ("running", "waiting_approval", "canceled"), "running": ("succeeded", "retry_wait", "waiting_approval", "failed", "canceled"),
    "retry_wait": ("ready", "failed", "canceled"), "waiting_approval": ("ready", "failed", "canceled"), "succeeded": (), "failed": ("ready", "canceled"), "skipped": (), "canceled": (),
}
ENDED = ("succeeded", "failed", "skipped", "canceled")
LOG = "step string, at timestamp, event string, before string, after string, worker string, attempt int, version long"
_LOG = LOG.replace("at timestamp", "at long")  # inside tasks, times are microseconds too: no zone of a session plays a part
STATE = "state string, worker string, until long, attempt int, version long, last long"  # times in microseconds


@dataclass
class Step:
    """A step's state; `take` and `run_out` give the rows of its log. Times are microseconds."""

    state: str = "ready"
    worker: str | None = None
    until: int | None = None
    attempt: int = 0
    version: int = 0
    last: int | None = None

    def _to(self, at: int, event: str, target: str, worker: str | None) -> tuple:
        before, self.state, self.version = self.state, target, self.version + 1
        if target != "running":
            self.worker = self.until = None
        return at, event, before, target, worker, self.attempt, self.version

    def run_out(self, now: int, most: int) -> list[tuple]:
        if self.state != "running" or self.until is None or self.until > now:
            return []
        return [self._to(self.until, "lease_expired", "retry_wait" if self.attempt < most else "failed", self.worker)]

    def take(self, at: int, kind: str, worker: str | None, seconds: float, most: int) -> list[tuple]:
        if self.last is not None and at < self.last:
            return [(at, f"{kind} rejected", self.state, self.state, worker, self.attempt, self.version)]
        out, self.last = self.run_out(at, most), at
        target = {"claim": "running", "finish": "succeeded", "fail": "retry_wait" if self.attempt < most else "failed", "cancel": "canceled", "heartbeat": "running", "hold": "waiting_approval", "approve": "ready", "reopen": "ready"}.get(kind)
        if kind in ("finish", "fail", "heartbeat"):
            allowed = self.state == "running" and worker == self.worker
        elif kind == "claim":
            allowed = self.state in ("ready", "retry_wait")  # what waits to be tried again is ready for who claims it
        else:
            allowed = target in TRANSITIONS[self.state] and {"approve": "waiting_approval", "reopen": "failed"}.get(kind, self.state) == self.state
        if target is None or not allowed:
            return [*out, (at, f"{kind} rejected", self.state, self.state, worker, self.attempt, self.version)]
        if kind in ("claim", "heartbeat"):
            self.worker, self.until = worker, at + int(max(10.0, seconds) * 1_000_000)
        if kind == "heartbeat":
            return [*out, (at, kind, "running", "running", worker, self.attempt, self.version)]
        self.attempt += kind == "claim"
        return [*out, self._to(at, kind, target, worker)]


def _log(step: str, rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["at", "event", "before", "after", "worker", "attempt", "version"])
    found.insert(0, "step", step)
    return found.astype({"attempt": "int32", "version": "int64"})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    types = {"step": text, "at": long, "event": text, "before": text, "after": text, "worker": text, "attempt": pa.int32(), "version": long}
    columns = zip(*rows) if rows else ((),) * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _valid(events: DataFrame) -> DataFrame:
    given = events.select("step", "ts", "id", "kind", "worker", F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return given.where("step IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL")


class Leases(StatefulProcessor):
    """State of each step in the store, with a timer at the end of its lease, and one for forgetting it."""

    def __init__(self, most: int, forget_s: float):
        self.most, self.forget = most, forget_s

    def init(self, handle) -> None:
        self.handle = handle
        self.store = handle.getValueState("step", STATE)

    def _load(self) -> Step:
        if not self.store.exists():
            return Step()
        state, worker, until, attempt, version, last = self.store.get()
        time = lambda x: None if x is None or pd.isna(x) else int(x)
        return Step(state, worker, time(until), int(attempt), int(version), time(last))

    def _keep(self, step: Step) -> None:
        self.store.update((step.state, step.worker, step.until, step.attempt, step.version, step.last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if step.until is not None:
            self.handle.registerTimer(step.until // 1000)
        elif step.state in ENDED:
            self.handle.registerTimer(step.last // 1000 + int(self.forget * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, log = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            log += step.take(r.at, r.kind, r.worker, r.seconds, self.most)
        self._keep(step)
        yield _log(key[0], log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step = self._load()
        log = step.run_out(timerValues.getCurrentWatermarkInMs() * 1000, self.most)
        if step.state in ENDED and not log:
            self.store.clear()
        else:
            self._keep(step)
        yield _log(key[0], log)

    def close(self) -> None:
        pass


def _timed(log: DataFrame) -> DataFrame:
    return log.withColumn("at", F.timestamp_micros("at"))


def leased(events: DataFrame, most: int = 3, late: str = "0 seconds", forget_s: float = 86_400.0) -> DataFrame:
    """The log of a stream of events (step, ts, id, kind, worker, seconds): LOG's columns. most: attempts of a step."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = _valid(events).withWatermark("ts", late)
    return _timed(given.groupBy("step").transformWithStateInPandas(Leases(most, forget_s), _LOG, "append", "eventTime"))


def replayed(events: DataFrame, most: int = 3, until: str | None = None) -> DataFrame:
    """The same log of a table of events: a step's events lie together, in order, and are taken one by one, so that a task holds the state
    of one step however many there are or however many events it has. until: the time by which leases that were never renewed run
    out (the latest event's, if none is given)."""
    given = _valid(events)
    now = given.sparkSession.range(1).select(F.unix_micros(F.lit(until).cast("timestamp"))).first()[0] if until else given.agg(F.max("at")).first()[0]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, step = None, Step()
        for rows in batches:
            log = []
            for key, at, kind, worker, seconds in zip(*(rows.column(c).to_pylist() for c in ("step", "at", "kind", "worker", "seconds"))):
                if key != name:
                    log += [(name, *r) for r in step.run_out(now, most)]
                    name, step = key, Step()
                log += [(name, *r) for r in step.take(at, kind, worker, seconds, most)]
            yield _batch(log)
        yield _batch([(name, *r) for r in step.run_out(now, most)])

    ordered = given.repartition("step").sortWithinPartitions("step", "at", F.col("id").asc_nulls_last())
    return _timed(ordered.select("step", "at", "kind", "worker", "seconds").mapInArrow(replay, _LOG))


def outcome(log: DataFrame) -> DataFrame:
    """A row for each step: state, attempts, version, and how many leases ran out and events were rejected."""
    last = F.max_by("after", F.struct("version", "at"))
    return log.groupBy("step").agg(
        last.alias("state"), F.max("attempt").alias("attempts"), F.max("version").alias("version"),
        F.count_if(F.col("event") == "lease_expired").alias("expired"), F.count_if(F.col("event").endswith("rejected")).alias("rejected"),
    )


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, as Parquet files in a folder; what a stopped run has written isn't written again."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
