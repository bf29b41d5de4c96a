"""What stands beside a running query on the driver: admission by queue size, periodic commits, background snapshots.

All of it holds one entry per sub-partition or less, never records.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.flow import SUB, queue_limits, total_budget

logger = logging.getLogger(__name__)


def collected(sizes: DataFrame) -> dict:
    """What ``flow.queue_sizes`` gives as {(topic, part, subpartition): bytes}: a row per sub-partition."""
    return {tuple(r[c] for c in SUB): r["size"] for r in sizes.collect()}


class Admission:
    """Says which partitions a source may read on. The source looks at the file ``path`` before each batch.

    The budget is shared evenly by all registered sub-partitions. A partition pauses
    when one of its queues reaches its share, or when all queues together reach the
    budget; it resumes when the budget is free and none of its queues is above the
    resume ratio of a share. The file is replaced whole, so a reader never sees half of it.
    """

    def __init__(self, path: str, total_bytes: int, registered, resume_ratio: float = 0.9, record: Callable = lambda name, value: None):
        self.path, self.total, self.ratio, self.record = path, total_bytes, resume_ratio, record
        self.registered, self.paused = set(map(tuple, registered)), set()
        self.update({})

    @classmethod
    def of(cls, config, path: str, memory_bytes: int, registered, record: Callable = lambda name, value: None) -> Admission:
        return cls(path, total_budget(memory_bytes, config["queue.total.size.heap.ratio"]), registered, config["queue.resume.ratio"], record)

    def update(self, sizes: dict) -> set:
        """sizes: {(topic, part, subpartition): bytes}; queues that it leaves out are empty. Gives the paused (topic, part)."""
        sizes = dict.fromkeys(self.registered, 0) | sizes
        pause, resume = queue_limits(self.total, len(sizes), self.ratio)
        all_, largest = sum(sizes.values()), defaultdict(int)
        for (topic, part, _), n in sizes.items():
            largest[topic, part] = max(largest[topic, part], n)
        over = all_ >= self.total
        self.paused = {p for p, n in largest.items() if over or n >= pause or (p in self.paused and n > resume)}
        self._write()
        for topic, part in largest:
            self.record(f"paused.{topic}-{part}", int((topic, part) in self.paused))
        for name, value in (("queues.total.size", all_), ("queue.pause.limit", pause), ("queue.resume.limit", resume)):
            self.record(name, value)
        return self.paused

    def _write(self) -> None:
        own = f"{self.path}.{os.getpid()}"
        with open(own, "w") as f:
            json.dump(sorted(self.paused), f)
        os.replace(own, self.path)


def paused_partitions(path: str | None) -> set:
    """What ``Admission`` wrote; nothing is paused where there is no file yet."""
    if not path or not os.path.exists(path):
        return set()
    with open(path) as f:
        return set(map(tuple, json.load(f)))


class Commits:
    """Hands the end of the last whole batch to ``commit`` when more than the interval has passed since the last time.

    A failure is tried again at the next interval; ``retries`` failures in a row may
    pass, one more is raised. Equal offsets are not committed twice.
    """

    def __init__(self, commit: Callable, interval_ms: int, retries: int, clock: Callable = time.monotonic):
        self.commit, self.interval, self.retries, self.clock = commit, interval_ms / 1000, retries, clock
        self.at, self.done, self.failures = clock(), None, 0

    def due(self) -> bool:
        return self.clock() - self.at > self.interval

    def offer(self, offsets, final: bool = False) -> bool:
        if offsets is None or offsets == self.done or not (final or self.due()):
            return False
        self.at = self.clock()
        try:
            self.commit(offsets)
        except Exception:
            self.failures += 1
            if self.failures > self.retries or final:
                raise
            return False
        self.done, self.failures = offsets, 0
        return True


class Snapshots:
    """Opt-in: a background thread that computes {(topic, part): number of ranges} every ``delay_ms``.

    Keeps the last ``max_size`` of each partition, none older than ``max_age_ms``;
    ``worst`` is the one with most ranges, the latest of equals. Slow computations are
    warned of, failing ones end the thread.
    """

    def __init__(self, compute: Callable[[], dict], record: Callable = lambda name, value: None, delay_ms: int = 10000, warn_ms: int = 10000, max_age_ms: int | None = None, max_size: int = 100, clock: Callable = time.monotonic):
        self.compute, self.record, self.delay, self.warn, self.clock = compute, record, delay_ms / 1000, warn_ms / 1000, clock
        self.max_age = (11 * delay_ms if max_age_ms is None else max_age_ms) / 1000
        self.kept: dict = defaultdict(lambda: deque(maxlen=max_size))
        self._stop, self._thread, self._lock = threading.Event(), None, threading.Lock()

    def once(self) -> None:
        start = self.clock()
        found = self.compute()
        took = self.clock() - start
        with self._lock:
            for p, ranges in found.items():
                self.kept[p].append((self.clock(), ranges))
        self.record("snapshots.compute.ms", int(took * 1000))
        if took > self.warn:
            logger.warning("snapshots took %d ms", took * 1000)

    def worst(self, partition: tuple):
        with self._lock:
            fresh = [(n, at) for at, n in self.kept.get(partition, ()) if self.clock() - at <= self.max_age]
        return max(fresh)[0] if fresh else None

    def start(self) -> Snapshots:
        def run():
            while not self._stop.is_set():
                self.once()
                self._stop.wait(self.delay)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(5)
