import pytest
from pyspark.sql import functions as F

from logweave.functions.hashing import murmur2
from logweave.operators import flow, offsets, partitioning as P, ranges as R, weigher as W
from logweave.streaming.config import Config, ConfigError, Guarantee, Status, allowed, terminal
from logweave.streaming.tasks import Task, run_stateless

BASE = {"consumer.topics": "a, b", "record.key.weigher": "string", "record.value.weigher": "string"}


def test_murmur2(spark):
    want = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "abc": 479470107}
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", murmur2(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] - (1 << 32) * (r["h"] >> 31) for r in rows} == want


@pytest.mark.parametrize("off,want", [([], []), ([1, 2, 5], [(1, 2), (5, 5)]), ([10, 11, 12, 20, 30, 31], [(10, 12), (20, 20), (30, 31)])])
def test_ranges(spark, off, want):
    df = spark.createDataFrame([("t", 0, o) for o in off], "topic string, part int, off long")
    assert sorted((r["lower"], r["upper"]) for r in R.from_offsets(df).collect()) == want


def test_commit(spark):
    cases = {0: (range(11), {0, 1, 2, 3, 4, 5}, 6), 1: (range(7), {0, 1, 2, 4, 5, 6}, 3), 2: (range(4), {1, 2, 3}, None), 3: ([*range(6), *range(10, 16)], {*range(6), 10, 11, 12}, 13)}
    rows = [("t", p, o, o in ok) for p, (c, ok, _) in cases.items() for o in c]
    got = {r["part"]: r["commit_offset"] for r in offsets.commit_offsets(spark.createDataFrame(rows, "topic string, part int, off long, ok boolean")).collect()}
    assert {p: got.get(p) for p in cases} == {p: w for p, (*_, w) in cases.items()}


def test_weights(spark):
    for k, v, b, s in ((0, 0, 280, 344), (1, 0, 288, 352), (3, 4, 296, 360), (111, 222, 616, 680)):
        df = spark.createDataFrame([("x" * k, "y" * v)], "k string, v string")
        byte = lambda c: W.byte_array(F.col(c).cast("binary"))
        r = df.select(W.record(byte("k"), byte("v"), F.lit("")).alias("b"), W.record(W.string(F.col("k")), W.string(F.col("v")), F.lit("")).alias("s")).first()
        assert tuple(r) == (b, s)


def test_subpartitions(spark):
    df = spark.createDataFrame([("a", 1, 0, "k")], "topic string, part int, off long, key string")
    with pytest.raises(Exception, match="Invalid subpartition: 3"):
        P.assign_subpartitions(df, _Fixed(3)).collect()


class _Fixed(P.Partitioner):
    def subpartition(self):
        return F.lit(3)


def test_merge(spark):
    rows = [("l", 0, t) for t in (10, 50, 70, 130, 150)] + [("r", 0, t) for t in (30, 90, 110, 120, 140)] + [("l", 1, t) for t in (40, 90, 20, 200)]
    got = flow.time_merge(spark.createDataFrame(rows, "topic string, part int, ts long"), "l", "r").collect()
    assert sorted((r["part"], r["ts"]) for r in got) == [(0, t) for t in (10, 30, 50, 70, 90, 110, 120, 130, 140)]


class Fails(Task):
    def process(self, record, state):
        if record["off"] == 144:
            raise ValueError("no")
        return ()


def test_guarantees(spark):
    df = spark.range(205).select(F.col("id").alias("off"))
    out = run_stateless(df, Fails, "none")
    assert out.where("NOT ok").select("off").collect()[0][0] == 144 and out.count() == 205
    with pytest.raises(Exception, match="ProcessingFailure"):
        run_stateless(df, Fails).collect()


def test_config():
    c = Config(BASE | {"logweave.worker.threads.num": "4", "worker.threads.num": "2", "consumer.kafka.x": "1", "worker.task.y": "2"})
    assert c["worker.threads.num"] == 4 and c["consumer.topics"] == ["a", "b"] and c["worker.processing.guarantee"] is Guarantee.AT_LEAST_ONCE
    assert c.source_options() == {"x": "1", "enable.auto.commit": "false"} and c.task_options() == {"y": "2"}
    for bad in ({}, BASE | {"queue.resume.ratio": 2}, BASE | {"consumer.kafka.enable.auto.commit": "true"}, BASE | {"worker.processing.guarantee": "often"}):
        with pytest.raises(ConfigError):
            Config(bad)


def test_statuses():
    assert allowed(None, Status.CREATED) and allowed(Status.CLOSING, Status.CLOSED_GRACEFULLY) and not allowed(Status.STARTED, Status.STARTING)
    assert terminal(Status.CANNOT_STOP_THREADS) and not terminal(Status.SHUTDOWN)


def test_queues_without_rows(spark):
    queued = spark.createDataFrame([("a", 0, 0, 60), ("a", 0, 1, 10), ("b", 0, 0, 30)], "topic string, part int, subpartition int, weight long")
    assigned = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "topic string, part int")
    sizes = flow.queue_sizes(queued, P.enumerate_subpartitions(assigned, P.Partitioner(2)))
    now = flow.pause_resume(sizes, 300)  # six queues of 50
    assert {(r["topic"], r["pause"], r["resume"]) for r in now.collect()} == {("a", True, False), ("b", False, True), ("c", False, True)}
    before = assigned.withColumn("paused", F.lit(True))
    assert {(r["topic"], r["paused"]) for r in flow.fold_paused(before, now.where("topic <> 'c'")).collect()} == {("a", True), ("b", False), ("c", False)}


def test_order_duplicates_and_limits(spark):
    log = spark.createDataFrame([("t", 0, i % 2, 9 - i) for i in range(10)], "topic string, part int, subpartition int, off long")
    rows = P.in_order(log, 2).rdd.glom().collect()
    for part in rows:
        for s_ in (0, 1):
            offs = [r["off"] for r in part if r["subpartition"] == s_]
            assert offs == sorted(offs)
    assert sum(any(r["subpartition"] == 0 for r in p) for p in rows) == 1
    ranges = spark.createDataFrame([("t", 0, 1, 0, 4, 10), ("t", 0, 2, 4, 6, 11), ("t", 0, 3, 8, 9, 9), ("t", 0, 4, 20, 21, 12)], "topic string, part int, seq int, lower long, upper long, consumed_at long")
    assert {r["seq"] for r in offsets.out_of_order(ranges).collect()} == {2, 3}
    assert flow.queue_limits(100, 3) == (33, 29) and flow.queue_limits(100, 0) == (100, 90) and flow.total_budget(1001, 0.5) == 500
    with pytest.raises(Exception, match="lower is above upper"):
        R.checked(spark.createDataFrame([(2, 1)], "lower long, upper long")).collect()


def test_header_weights(spark):
    cases = [([("1", "1")], 392), ([("123", "1234")], 392), ([("1", "123456789")], 400), ([("123456789", "123456789")], 408), ([("1", "1")] * 2, 504), ([("1", "1"), ("1", "1"), ("12345678", "12345678")], 616), ([("1", "1"), ("1", "1"), ("123456789", "123456789")], 632)]
    for heads, want in cases:
        df = spark.createDataFrame([([(k, v.encode()) for k, v in heads],)], "h array<struct<key: string, value: binary>>")
        zero = W.byte_array(F.lit("").cast("binary"))
        got = df.select(W.record(W.bytes_object(F.lit("").cast("binary")), W.bytes_object(F.lit("").cast("binary")), F.lit(""), F.col("h")).alias("w"), W.record(zero, zero, F.lit(""), F.col("h")).alias("raw")).first()
        assert want in tuple(got), (heads, want, got)
