"""Lifecycle of a streaming query: start once, shut down idempotently, supervised restarts, callback, metrics."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .config import BadStatus, Config, EngineError, FailedCommit, ProcessingFailure, ProcessingTimeout, Status, allowed, terminal
from .control import Admission, Commits, Snapshots


class Metrics(StreamingQueryListener):
    """Named gauges from query progress: ``name.topic-partition`` values come from df.observe."""

    def __init__(self, reporters=()):
        self.gauges, self.reporters = {}, list(reporters)

    @staticmethod
    def name(base: str, topic: str, part: int, sub: int | None = None) -> str:
        return f"{base}.{topic}-{part}" + (f".{sub}" if sub is not None else "")

    def record(self, name: str, value) -> None:
        self.gauges[name] = value
        for r in self.reporters:
            r(name, value)

    def remove(self, name: str) -> None:
        self.gauges.pop(name, None)

    def onQueryStarted(self, event):
        self.record("running", 1)

    def onQueryProgress(self, event):
        p = event.progress
        self.record("poll.records", p.numInputRows)
        self.record("poll.rate", p.inputRowsPerSecond)
        for name, row in (p.observedMetrics or {}).items():
            for k, v in row.asDict().items():
                self.record(f"{name}.{k}", v)

    def onQueryTerminated(self, event):
        self.record("running", 0)


def observed(log: DataFrame) -> DataFrame:
    return log.observe("log", F.count(F.lit(1)).alias("records"), F.max("off").alias("consumed_offset"), F.min(F.octet_length("value")).alias("min_size"), F.max(F.octet_length("value")).alias("max_size"), F.avg(F.octet_length("value")).alias("avg_size"))


class Stopped(EngineError):
    """A batch came after the shutdown had begun; it is not processed and comes again after a restart."""


class Engine:
    """Runs ``sink(batch, batch_id)`` over a streaming frame under a checkpoint.

    A failure of the sink that is not a task's own is retried up to
    ``consumer.commit.retries`` times in a row from the last checkpoint; a batch that
    succeeds resets the count. Delivery is at least once: a restart replays the last
    unfinished batch.

    ``commit(offsets)`` gets the sources' end offsets of whole batches, at most once a
    commit interval and once more at the end. ``admission`` with ``queued(batch)``
    ({(topic, part, subpartition): bytes}) is brought up to date after each batch.
    ``snapshot`` is computed in the background where the configuration says so.

    Shutdown goes in stages: no new batch is begun, and the one in flight may end within
    ``worker.shutdown.timeout.ms`` (closed gracefully); then it is interrupted and may
    end within the same time again (not gracefully); beyond that the engine leaves it
    (cannot stop). ``interrupt`` ends the waiting (closing interrupted).
    """

    TICK = 0.1

    def __init__(self, stream: DataFrame, sink: Callable, config: Config, checkpoint: str, on_shutdown: Callable | None = None, reporters=(), commit: Callable | None = None, admission: Admission | None = None, queued: Callable | None = None, snapshot: Callable | None = None):
        self.stream, self.sink, self.config, self.checkpoint, self.on_shutdown = stream, sink, config, checkpoint, on_shutdown
        self.metrics, self._lock, self._done = Metrics([*config.reporters, *reporters]), threading.RLock(), threading.Event()
        self.status, self.cause, self.query, self._failures, self._stop = None, None, None, 0, False
        self.commits = Commits(commit, config["consumer.commit.interval.ms"], config["consumer.commit.retries"]) if commit else None
        self.admission, self.queued = admission, queued
        if admission:
            admission.record = self.metrics.record
        own = config.snapshot_arguments()
        self.snapshots = Snapshots(snapshot, self.metrics.record, **own) if snapshot and own is not None else None
        self._begun, self._ended, self._interrupted = -1, None, threading.Event()
        self._to(Status.CREATED)

    def _to(self, status: Status) -> None:
        with self._lock:
            if not allowed(self.status, status):
                raise BadStatus(f"{self.status} cannot become {status}")
            self.status = status

    def start(self) -> None:
        self._to(Status.STARTING)
        self.stream.sparkSession.streams.addListener(self.metrics)
        self.metrics.record("worker.threads", self.config["worker.threads.num"])
        self._launch()
        if self.snapshots:
            self.snapshots.start()
        self._to(Status.STARTED)
        threading.Thread(target=self._watch, daemon=True).start()

    def _launch(self) -> None:
        def each(batch, i):
            with self._lock:
                if self._stop:
                    raise Stopped(f"batch {i}")
                self._begun = i
            self.sink(batch, i)
            if self.admission and self.queued:
                self.admission.update(self.queued(batch))
            self._failures = 0

        ms = self.config["consumer.poll.timeout.ms"]
        self.query = self.stream.writeStream.foreachBatch(each).option("checkpointLocation", self.checkpoint).trigger(processingTime=f"{ms} milliseconds").start()

    def _offsets(self):
        """End offsets of the last whole batch, by source; None before the first."""
        p = self.query.lastProgress
        return [s["endOffset"] for s in json.loads(p.json)["sources"]] if p else None

    def _watch(self) -> None:
        while self._ended is None:
            try:
                if self.query.awaitTermination(self.TICK):
                    break
            except Exception as e:
                if self._stop:
                    break
                text = str(e)
                own = next((k for k in (ProcessingFailure, ProcessingTimeout) if k.__name__ in text), None)
                self._failures += 1
                if own or self._failures > self.config["consumer.commit.retries"]:
                    self._fail(own or FailedCommit, text, e)
                    break
                self._launch()
                continue
            if self.commits and not self._stop:
                try:
                    self.commits.offer(self._offsets())
                except Exception as e:
                    self._fail(FailedCommit, str(e), e)
                    break
        if not self._stop:
            self._stop = True
            self._end()
        while self._ended is None:
            time.sleep(self.TICK / 2)
        self._close()

    def _fail(self, kind, text: str, cause: Exception) -> None:
        self.cause = kind(text)
        self.cause.__cause__ = cause

    def _settled(self) -> bool:
        """No batch is in flight: the last one that was begun is in the query's progress, or the query has ended."""
        if not self.query.isActive:
            return True
        p = self.query.lastProgress
        return self._begun < 0 or bool(p) and p.batchId >= self._begun

    def _within(self, seconds: float, done: Callable[[], bool]) -> bool:
        end = time.monotonic() + seconds
        while not done():
            if time.monotonic() >= end or self._interrupted.is_set():
                return False
            time.sleep(self.TICK / 2)
        return True

    def _end(self) -> None:
        seconds = self.config["worker.shutdown.timeout.ms"] / 1000
        end = Status.CLOSED_GRACEFULLY if self._within(seconds, self._settled) else Status.CLOSED_NOT_GRACEFULLY
        stopper = threading.Thread(target=self._halt, daemon=True)
        stopper.start()
        if not self._within(max(seconds, self.TICK), lambda: not stopper.is_alive()):
            end = Status.CANNOT_STOP_THREADS
        self._ended = Status.CLOSING_INTERRUPTED if self._interrupted.is_set() else end

    def _halt(self) -> None:
        try:
            self.query.stop()
        except Exception as e:  # a query that had already failed
            self.metrics.record("stop.error", str(e))

    def _close(self) -> None:
        with self._lock:
            if self.status is Status.STARTED:
                self._to(Status.SHUTDOWN)
            self._to(Status.CLOSING)
        end = self._ended
        if self.snapshots:
            self.snapshots.stop()
        if self.commits and end is not Status.CANNOT_STOP_THREADS:
            try:
                self.commits.offer(self._offsets(), final=True)
            except Exception as e:
                if self.cause is None:
                    self._fail(FailedCommit, str(e), e)
        self.stream.sparkSession.streams.removeListener(self.metrics)
        self.metrics.remove("worker.threads")
        if self.on_shutdown:
            self.on_shutdown(self.cause)
        self._to(end)
        self._done.set()

    def shutdown(self, cause: EngineError | None = None, wait: bool = True) -> None:
        """Idempotent; does nothing before start. Waits for the terminal status unless told otherwise, as a sink must."""
        with self._lock:
            if self.status is Status.CREATED or self._stop or terminal(self.status):
                return
            self._stop, self.cause = True, self.cause or cause
            if self.status is Status.STARTED:
                self._to(Status.SHUTDOWN)
        threading.Thread(target=self._end, daemon=True).start()
        if wait:
            self.wait(3 * self.config["worker.shutdown.timeout.ms"] / 1000 + 5)

    def interrupt(self) -> None:
        """Ends the waiting of a shutdown."""
        self._interrupted.set()

    def wait(self, timeout_s: float | None = None) -> Status:
        self._done.wait(timeout_s)
        return self.status
