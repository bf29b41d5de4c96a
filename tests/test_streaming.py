import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.sources.records import GeneratedLog
from logweave.streaming.config import BadStatus, Config, FailedCommit, ProcessingFailure, Status
from logweave.streaming.engine import Engine
from logweave.streaming.tasks import Task, merge_streams, run_stateful, run_stateless

CONFIG = {"consumer.topics": "generated", "record.key.weigher": "string", "record.value.weigher": "string", "consumer.poll.timeout.ms": 50, "worker.shutdown.timeout.ms": 30000}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def log(spark):
    spark.dataSource.register(GeneratedLog)
    return lambda **options: spark.readStream.format("generated_log").options(**options).load()


class Collect:
    def __init__(self, want, fail=lambda n: False):
        self.rows, self.batches, self.want, self.fail, self.calls, self.full = [], {}, want, fail, 0, threading.Event()

    def __call__(self, batch, i):
        got = [(r["part"], r["off"]) for r in batch.collect()]
        self.calls += 1
        if self.fail(self.calls):
            raise ValueError("sink")
        self.batches[i] = got
        self.rows += got
        if len(set(self.rows)) >= self.want:
            self.full.set()


EVERY = [(p, o) for p in range(2) for o in range(25)]


def test_engine_delivers_in_order_and_shuts_down(log, tmp_path):
    sink, causes = Collect(50), []
    e = Engine(log(rows=25), sink, Config(CONFIG), str(tmp_path), causes.append)
    e.shutdown()  # nothing before start
    assert e.status is Status.CREATED
    e.start()
    with pytest.raises(BadStatus):
        e.start()
    assert sink.full.wait(60)
    e.shutdown()
    e.shutdown()
    assert e.wait(30) is Status.CLOSED_GRACEFULLY and causes == [None] and e.cause is None
    assert sorted(sink.rows) == EVERY
    assert all(len(b) <= 20 for b in sink.batches.values())
    for p in range(2):
        assert [o for q, o in sink.rows if q == p] == list(range(25))


def test_a_new_engine_goes_on_from_the_checkpoint(log, tmp_path):
    first = Collect(50)
    e = Engine(log(rows=25), first, Config(CONFIG), str(tmp_path))
    e.start()
    assert first.full.wait(60)
    e.query.processAllAvailable()  # the last batch is committed
    e.shutdown()
    second = Collect(30)
    e = Engine(log(rows=40), second, Config(CONFIG), str(tmp_path))
    e.start()
    assert second.full.wait(60)
    e.shutdown()
    assert sorted(second.rows) == [(p, o) for p in range(2) for o in range(25, 40)]


def test_engine_restarts_after_a_failed_sink(log, tmp_path):
    sink, causes = Collect(50, lambda n: n in (2, 3)), []
    e = Engine(log(rows=25), sink, Config(CONFIG), str(tmp_path), causes.append)
    e.start()
    assert sink.full.wait(90)
    e.shutdown()
    assert causes == [None] and sorted(set(sink.rows)) == EVERY


def test_engine_gives_up_after_the_retries(log, tmp_path):
    sink, causes = Collect(50, lambda n: n > 1), []
    e = Engine(log(rows=25), sink, Config(CONFIG | {"consumer.commit.retries": 2}), str(tmp_path), causes.append)
    e.start()
    assert e.wait(90) is Status.CLOSED_GRACEFULLY
    assert isinstance(causes[0], FailedCommit) and sink.calls == 4


class Fails(Task):
    def process(self, record, state):
        if record["off"] == 14:
            raise ValueError("no")
        return ()


def test_a_failed_record_closes_the_engine_at_once(log, tmp_path):
    sink, causes = Collect(50), []
    e = Engine(run_stateless(log(rows=25), Fails), sink, Config(CONFIG), str(tmp_path), causes.append)
    e.start()
    assert e.wait(90) is Status.CLOSED_GRACEFULLY
    assert isinstance(causes[0], ProcessingFailure) and max(o for _, o in sink.rows) < 14


def test_metrics_follow_progress(log, tmp_path):
    sink, said = Collect(50), []
    e = Engine(log(rows=25), sink, Config(CONFIG), str(tmp_path), reporters=[lambda n, v: said.append(n)])
    e.start()
    assert sink.full.wait(60)
    e.shutdown()
    assert "poll.records" in said and "poll.records" in e.metrics.gauges
    assert e.metrics.name("paused", "t", 1, 2) == "paused.t-1.2"


class Sums(Task):
    """Refuses offset 12 until the next timer has run; keeps a sum per sub-partition."""

    def accept(self, record, state):
        return record["off"] != 12 or "opened" in state

    def process(self, record, state):
        state["sum"] = str(int(state.get("sum", 0)) + record["off"])
        return [(record["part"], record["off"], int(state["sum"]))]

    def punctuate(self, now_ms, state):
        state["opened"] = "1"
        return ()


def test_stateful_tasks_gate_and_keep_state(spark, log, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = []
    out = run_stateful(log(rows=25), Sums, "part int, off bigint, total bigint", keys=("topic", "part"), punctuate_ms=200)
    done = threading.Event()

    def sink(batch, i):
        rows.extend(tuple(r) for r in batch.collect())
        if len(rows) >= 50:
            done.set()

    q = out.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(processingTime="100 milliseconds").start()
    try:
        assert done.wait(120), (rows, q.exception())
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for p in range(2):
        assert [(o, t) for q_, o, t in rows if q_ == p] == [(o, o * (o + 1) // 2) for o in range(25)]


def test_merged_streams_hold_every_record(spark, log, tmp_path):
    one = log(rows=8, topic="l").withColumn("ts", F.timestamp_seconds("off"))
    two = log(rows=5, topic="r").withColumn("ts", F.timestamp_seconds("off"))
    q = merge_streams(one, two).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        got = sorted((r["topic"], r["part"], r["off"]) for r in spark.table("merged").collect())
    finally:
        q.stop()
    assert got == sorted((t, p, o) for t, n in (("l", 8), ("r", 5)) for p in range(2) for o in range(n))


class Own(Task):
    """Remembers keys and types in its own fields; fails on offset 3; holds 5 until a timer."""

    def init(self, subpartition, options):
        self.key, self.seen = subpartition, set()

    def accept(self, record, state):
        assert isinstance(record["ts"], datetime) and isinstance(record["value"], str), record
        return record["off"] != 5 or "open" in state

    def process(self, record, state):
        self.seen.add(record["part"])
        if record["off"] == 3:
            raise ValueError("no")
        return [(record["off"], str(self.key), sorted(self.seen) == [record["part"]])]

    def punctuate(self, now_ms, state):
        state["open"] = "1"
        return ()


def _collect(out, path, want, seconds=120):
    rows, done = [], threading.Event()

    def sink(batch, i):
        rows.extend(batch.collect())
        if len(rows) >= want:
            done.set()

    q = out.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", path).trigger(processingTime="100 milliseconds").start()
    return q, rows, done


def test_tasks_keys_types_and_dead_letters(spark, log, tmp_path):
    """Two keys in one Spark partition have a task each; a held record keeps its types; a failed one becomes a dead letter."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = log(rows=8).withColumn("ts", F.timestamp_seconds("off"))
    out = run_stateful(stream, Own, "o bigint, task string, alone boolean", keys=("topic", "part"), punctuate_ms=300, guarantee="none")
    q, rows, done = _collect(out, str(tmp_path), 16)
    try:
        assert done.wait(120), (rows, q.exception())
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["record_part"], r["record_off"]) for r in rows) == [(p, o) for p in range(2) for o in range(8)]
    for r in rows:
        dead = r["record_off"] == 3
        assert r["record_ok"] is not dead and (r["record_error"] == "ValueError: no") is dead
        assert dead or (r["o"], r["alone"], r["task"]) == (r["record_off"], True, str(("generated", r["record_part"])))


class Holds(Task):
    def accept(self, record, state):
        return record["off"] < 4

    def process(self, record, state):
        return [(record["off"],)]


def test_an_idle_key_times_out(spark, log, tmp_path):
    """No record follows the held one: a timer ends the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q, rows, _ = _collect(run_stateful(log(rows=6, partitions=1), Holds, "o bigint", keys=("topic", "part"), timeout_ms=1500), str(tmp_path), 99)
    try:
        with pytest.raises(Exception, match="ProcessingTimeout"):
            q.awaitTermination(90)
            raise AssertionError("still running")
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r["o"] for r in rows] == [0, 1, 2, 3]
