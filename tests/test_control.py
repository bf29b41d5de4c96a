import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from logweave.operators import flow
from logweave.sources import kafka
from logweave.sources.records import GeneratedLog
from logweave.streaming.config import Config, ConfigError, FailedCommit, Status
from logweave.streaming.control import Admission, Commits, Snapshots, collected, paused_partitions
from logweave.streaming.engine import Engine
from logweave.streaming.tasks import Task, run_stateful

CONFIG = {"consumer.topics": "generated", "record.key.weigher": "string", "record.value.weigher": "string", "consumer.poll.timeout.ms": 50, "worker.shutdown.timeout.ms": 20000}
SUBS = [("t", 0, 0), ("t", 0, 1), ("t", 1, 0), ("t", 1, 1)]
said = []


def reporter(name, value):
    said.append(name)


@pytest.fixture
def log(spark):
    spark.dataSource.register(GeneratedLog)
    return lambda **options: spark.readStream.format("generated_log").options(**options).load()


def test_admission_pauses_and_resumes(tmp_path):
    gauges = {}
    a = Admission(str(tmp_path / "c"), 400, SUBS, 0.5, gauges.__setitem__)
    assert a.paused == paused_partitions(a.path) == set()
    assert a.update({("t", 0, 1): 100}) == {("t", 0)}  # a share is 100
    assert gauges["paused.t-0"] == 1 and gauges["paused.t-1"] == 0 and gauges["queue.pause.limit"] == 100 and gauges["queue.resume.limit"] == 50
    assert a.update({("t", 0, 1): 51}) == {("t", 0)}  # not yet at the resume limit
    assert a.update({("t", 0, 1): 50}) == set()
    assert a.update({s: 90 for s in SUBS} | {("t", 9, 9): 4}) == {("t", 0), ("t", 1)}  # a share is 80 now
    assert a.update({("t", 9, 9): 400}) == {("t", 0), ("t", 1), ("t", 9)}  # the whole budget
    assert paused_partitions(a.path) == a.paused and gauges["queues.total.size"] == 400
    assert a.update({}) == set() and paused_partitions(None) == paused_partitions(str(tmp_path / "none")) == set()


def test_admission_agrees_with_the_query(spark, tmp_path):
    sizes = {("t", 0, 0): 120, ("t", 0, 1): 10, ("t", 1, 0): 89}
    queued = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "topic string, part int, subpartition int, weight long")
    reg = spark.createDataFrame(SUBS, "topic string, part int, subpartition int")
    df = flow.queue_sizes(queued, reg)
    assert collected(df) == dict.fromkeys(SUBS, 0) | sizes
    a = Admission(str(tmp_path / "c"), 400, SUBS)
    want = {(r["topic"], r["part"]) for r in flow.pause_resume(df, 400).where("pause").collect()}
    assert a.update(sizes) == want == {("t", 0)}


def test_a_paused_partition_is_not_read(log, tmp_path):
    """The engine tells queue sizes to the source: partition 0 stands still while its queue is full."""
    control, seen, full = str(tmp_path / "control"), [], threading.Event()
    a = Admission(control, 1000, [("generated", 0, 0), ("generated", 1, 0)])

    def sink(batch, i):
        seen.append(sorted((r["part"], r["off"]) for r in batch.collect()))
        if sum(map(len, seen)) == 120:
            full.set()

    queued = lambda batch: {("generated", 0, 0): 900 if 1 <= len(seen) < 4 else 0}
    e = Engine(log(rows=60, maxOffsetsPerTrigger=10, control=control), sink, Config(CONFIG), str(tmp_path / "ck"), admission=a, queued=queued)
    e.start()
    assert full.wait(90)
    e.shutdown()
    assert e.status is Status.CLOSED_GRACEFULLY and e.metrics.gauges["paused.generated-0"] == 0
    parts = [{p for p, _ in b} for b in seen if b]
    # a batch that was planned before the pause may still come
    assert {1} in parts[1:5] and {0} in parts[4:]
    assert sorted(x for b in seen for x in b) == [(p, o) for p in range(2) for o in range(60)]


def test_commits_keep_the_interval_and_count_failures():
    now, done, fail = [0.0], [], [False]

    def commit(x):
        if fail[0]:
            raise OSError("no")
        done.append(x)

    c = Commits(commit, 1000, 1, lambda: now[0])
    now[0] = 1.0
    assert not c.offer("a")  # strictly more than the interval
    now[0] = 1.1
    assert c.offer("a") and not c.offer("b") and not c.offer(None)
    now[0], fail[0] = 3.0, True
    assert not c.offer("b")
    now[0], fail[0] = 5.0, False
    assert c.offer("b") and c.failures == 0
    assert not c.offer("b", final=True) and c.offer("c", final=True) and done == ["a", "b", "c"]
    fail[0] = True
    now[0] = 7.0
    assert not c.offer("d")
    now[0] = 9.0
    with pytest.raises(OSError):
        c.offer("d")


def test_the_engine_commits_offsets(log, tmp_path):
    done, full = [], threading.Event()
    e = Engine(log(rows=25), lambda b, i: (b.count(), i == 2 and full.set()), Config(CONFIG | {"consumer.commit.interval.ms": 0}), str(tmp_path), commit=done.append)
    e.start()
    assert full.wait(60)
    e.query.processAllAvailable()
    e.shutdown()
    assert done[-1] == [{"0": 25, "1": 25}] and len(done) == len(set(map(str, done)))


def test_failed_commits_close_the_engine(log, tmp_path):
    def commit(x):
        raise OSError("no broker")

    e = Engine(log(rows=25), lambda b, i: b.count(), Config(CONFIG | {"consumer.commit.interval.ms": 0, "consumer.commit.retries": 0}), str(tmp_path), commit=commit)
    e.start()
    assert e.wait(60) is Status.CLOSED_GRACEFULLY and isinstance(e.cause, FailedCommit)


def _slow(batches):
    for b in batches:
        time.sleep(60)
        yield b


def _closing(log, tmp_path, sink, ms, then=None):
    begun, end = threading.Event(), []

    def own(batch, i):
        begun.set()
        sink(batch, i)

    e = Engine(log(rows=25), own, Config(CONFIG | {"worker.shutdown.timeout.ms": ms}), str(tmp_path), end.append)
    e.start()
    assert begun.wait(60)
    time.sleep(0.5)
    start = time.monotonic()
    e.shutdown(wait=then is None)
    if then:
        then(e)
    status = e.wait(30)
    assert end == [None]
    return status, time.monotonic() - start


def test_the_batch_in_flight_may_end(log, tmp_path):
    ended = []
    status, _ = _closing(log, tmp_path, lambda b, i: (time.sleep(2), ended.append(i)), 20000)
    assert status is Status.CLOSED_GRACEFULLY and ended == [0]


def test_a_job_in_flight_is_interrupted(log, tmp_path):
    status, took = _closing(log, tmp_path, lambda b, i: b.mapInPandas(_slow, b.schema).count(), 4000)
    assert status is Status.CLOSED_NOT_GRACEFULLY and 3.5 < took < 30


def test_what_cannot_be_stopped_is_left(log, tmp_path):
    free = threading.Event()
    status, took = _closing(log, tmp_path, lambda b, i: free.wait(20), 700)
    free.set()
    assert status is Status.CANNOT_STOP_THREADS and took < 10


def test_the_waiting_can_be_interrupted(log, tmp_path):
    free = threading.Event()
    status, took = _closing(log, tmp_path, lambda b, i: free.wait(20), 15000, lambda e: e.interrupt())
    free.set()
    assert status is Status.CLOSING_INTERRUPTED and took < 10


def test_snapshots():
    now, gauges, found = [0.0], {}, {("t", 0): 3}
    s = Snapshots(lambda: dict(found), gauges.__setitem__, delay_ms=1000, max_size=2, clock=lambda: now[0])
    assert s.worst(("t", 0)) is None
    for t, n in enumerate((5, 3, 4)):
        now[0], found["t", 0] = float(t), n
        s.once()
    assert s.worst(("t", 0)) == 4  # the first is no longer kept
    now[0] = 12.5
    assert s.worst(("t", 0)) == 4 and "snapshots.compute.ms" in gauges
    now[0] = 13.5
    assert s.worst(("t", 0)) is None  # older than eleven delays
    ran = threading.Event()
    s = Snapshots(lambda: (ran.set(), {})[1], delay_ms=10).start()
    assert ran.wait(10)
    s.stop()


def test_config_acts(spark, tmp_path):
    own = CONFIG | {"record.value.weigher": "logweave.operators.weigher:byte_array", "metric.reporters": f"{__name__}:reporter", "worker.task.a": "1", "worker.sleep.ms": "7", "punctuator.interval.ms": "9"}
    c = Config(own)
    assert c.task_arguments() == {"options": {"a": "1"}, "guarantee": "at_least_once", "timeout_ms": 300000, "punctuate_ms": 9, "sleep_ms": 7}
    df = spark.createDataFrame([("", bytearray(b""))], "k string, v binary")
    assert df.select(c.weight(F.col("k"), F.col("v"), F.lit(""))).first()[0] == 312
    c.reporters[0]("x", 1)
    assert said[-1] == "x" and c.snapshot_arguments() is None
    on = Config(own | {"offsets-state.metric-infos.enabled": "true", "offsets-state.metric-infos.delay.ms": "5", "offsets-state.last-metric-infos.max.size": "3"})
    assert on.snapshot_arguments() == {"delay_ms": 5, "max_size": 3}
    for bad in ({"record.key.weigher": "nowhere:x"}, {"record.key.weigher": "logweave.operators.weigher:SMALL"}, {"metric.reporters": "x"}):
        with pytest.raises(ConfigError):
            Config(own | bad)
    a = Admission.of(Config(own | {"queue.total.size.heap.ratio": 0.25}), str(tmp_path / "control"), 800, SUBS)
    assert a.total == 200 and a.ratio == 0.9


class Third(Task):
    """Refuses its head twice; takes it at the third offer."""

    def accept(self, record, state):
        state["offers"] = str(int(state.get("offers", 0)) + 1)
        return int(state["offers"]) > 2

    def process(self, record, state):
        return [(record["off"], int(state["offers"]))]


def test_a_refused_head_is_offered_again(spark, log, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, done = [], threading.Event()
    out = run_stateful(log(rows=1, partitions=1), Third, "o bigint, offers int", keys=("topic", "part"), sleep_ms=100)
    q = out.writeStream.foreachBatch(lambda b, i: (rows.extend(b.collect()), rows and done.set())).option("checkpointLocation", str(tmp_path)).trigger(processingTime="100 milliseconds").start()
    try:
        assert done.wait(60), q.exception()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [tuple(r) for r in rows] == [(0, 3)]


def test_kafka_options_and_envelope(spark):
    c = Config(CONFIG | {"consumer.topics": "a,b", "consumer.kafka.bootstrap.servers": "h:1", "consumer.kafka.auto.offset.reset": "earliest"})
    assert kafka.kafka_options(c) == {"kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "earliest", "includeHeaders": "true"}
    got = kafka.kafka_options(c, {("a", 0): 7}, [("a", 0), ("a", 1), ("b", 0)])["startingOffsets"]
    assert json.loads(got) == {"a": {"0": 7, "1": -2}, "b": {"0": -2}}
    assert json.loads(kafka.starting_offsets("latest", {("a", 0): 7}, [("b", 0)])) == {"a": {"0": 7}, "b": {"0": -1}}
    with pytest.raises(ValueError):
        kafka.kafka_options(Config(CONFIG | {"consumer.kafka.auto.offset.reset": "none"}))
    raw = spark.sql("SELECT binary('k') AS key, CAST(NULL AS BINARY) AS value, 't' AS topic, 3 AS partition, 9L AS offset, timestamp_seconds(5) AS timestamp, 0 AS timestampType, array(named_struct('key', 'h', 'value', binary('v'))) AS headers")
    r = kafka.envelope(raw).first()
    assert (r["topic"], r["part"], r["off"], r["key"], r["value"], r["headers"][0]["key"], bytes(r["headers"][0]["value"])) == ("t", 3, 9, "k", None, "h", b"v")
    assert kafka.envelope(raw.drop("headers"), text=False).first()["headers"] is None
