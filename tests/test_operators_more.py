"""Golden values of weights, ranges, offsets and limits, and operators that no registered query reaches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave.functions.time import age, older_than
from logweave.operators import flow, offsets, partitioning as P, ranges as R, weigher as W
from logweave.sources.records import RECORD, offsets_json, start_at, subscribe

TPO = "topic string, part int, off long"


@pytest.mark.parametrize(
    "heads,want",
    [("1:1", 392), ("123:1234", 392), ("1234:123", 392), ("1:123456789", 400), ("123456789:1", 400), ("123456789:123456789", 408), ("1:1,1:1", 504), ("1:1,1:1,12345678:12345678", 616), ("1:1,1:1,123456789:123456789", 632), ("", 280)],
)
def test_header_weights(spark, heads, want):
    pairs = [tuple(x.split(":")) for x in heads.split(",") if x]
    df = spark.createDataFrame([([(k, bytearray(v.encode())) for k, v in pairs],)], "h array<struct<key: string, value: binary>>")
    empty = W.byte_array(F.lit("").cast("binary"))
    assert df.select(W.record(empty, empty, F.lit(""), F.col("h"))).first()[0] == want


def test_bytes_weights_and_nulls(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS n, binary('12345678') AS b")
    r = df.select(W.bytes_object(F.col("b")), W.bytes_object(F.col("n").cast("binary")), W.byte_array(F.col("n").cast("binary")), W.string(F.col("n")), W.headers(F.lit(None).cast(RECORD["headers"].dataType))).first()
    assert tuple(r) == (48, 0, 0, 0, 40)


@pytest.mark.parametrize("off,want", [([1], [(1, 1)]), ([1, 3, 5], [(1, 1), (3, 3), (5, 5)]), ([1, 4, 5], [(1, 1), (4, 5)]), ([1, 2, 3], [(1, 3)]), ([1, 2, 3, 5], [(1, 3), (5, 5)]), ([1, 2, 3, 5, 6, 7], [(1, 3), (5, 7)])])
def test_ranges(spark, off, want):
    got = R.from_offsets(spark.createDataFrame([("t", 0, o) for o in off], TPO))
    assert sorted((r["lower"], r["upper"]) for r in got.collect()) == want


def test_overlap(spark):
    consumed = spark.createDataFrame([("t", 0, 10, 20)], "topic string, part int, lower long, upper long")
    want = {(0, 10): 10, (0, 15): 10, (0, 20): 10, (0, 30): 10, (10, 10): 10, (10, 20): 10, (15, 20): 15, (15, 30): 15, (20, 20): 20, (20, 30): 20, (0, 9): None, (21, 30): None}
    added = spark.createDataFrame([("t", 0, *x) for x in want], consumed.schema)
    assert {(r["lower"], r["upper"]): r["existing"] for r in R.min_existing(consumed, added).collect()} == want
    got = offsets.duplicate_consumed(consumed, added).where("upper = 30 AND lower = 15").first()
    assert got["error"] == "Offset: 15 for partition: t-0 was consumed before"


@pytest.mark.parametrize("done,limit,want", [({2, 3, 5, 6, 7}, 7, 1), ({1}, 7, 2), ({1, 2}, 7, 3), ({1, 2, 3}, 8, 5), ({1, 2, 3, 5}, 8, 6), ({1, 2, 3, 5, 6}, 8, 7), ({1, 2, 3}, 7, None)])
def test_timeouts(spark, done, limit, want):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    rows = [("t", 0, o, o in done, at(3 if o < 4 else 7)) for o in (1, 2, 3, 5, 6, 7)]
    df = spark.createDataFrame(rows, f"{TPO}, ok boolean, consumed_at timestamp_ntz")
    got = offsets.timed_out(df, F.lit(at(limit)).cast("timestamp_ntz"), "0 SECONDS").collect()
    assert [r["off"] for r in got] == ([want] if want else [])


@pytest.mark.parametrize("chunk,done,want", [([(0, 5), (10, 15)], set(), None), ([(0, 5), (10, 15)], set(range(4)), 4), ([(0, 5), (10, 15)], set(range(6)), 6), ([(0, 5), (10, 15)], {*range(6), 10, 11, 12}, 13), ([(0, 5), (10, 15)], {*range(16)}, 16)])
def test_commit_points(spark, chunk, done, want):
    rows = [("t", 0, o, o in done) for a, b in chunk for o in range(a, b + 1)]
    for some in (rows, rows[::-1]):
        got = offsets.commit_offsets(spark.createDataFrame(some, f"{TPO}, ok boolean")).collect()
        assert [r["commit_offset"] for r in got] == ([want] if want else [])


def test_out_of_order(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("t", 0, 1, 0, 5, at(1)), ("t", 0, 2, 6, 9, at(2)), ("t", 0, 3, 9, 12, at(3)), ("t", 0, 4, 13, 14, at(1)), ("t", 1, 1, 0, 1, at(9))]
    got = offsets.out_of_order(spark.createDataFrame(rows, "topic string, part int, seq int, lower long, upper long, consumed_at timestamp")).collect()
    assert sorted(r["seq"] for r in got) == [3, 4]


def test_limits():
    assert flow.queue_limits(1000, 3) == (333, 299) and flow.queue_limits(1000, 0, 0.5) == (1000, 500)
    assert flow.total_budget(1001, 0.5) == 500 and flow.total_budget(10, 0) == 0
    with pytest.raises(ValueError):
        flow.total_budget(10, 1.5)


def test_fold_paused(spark):
    before = spark.createDataFrame([("t", 0, True), ("t", 1, True), ("t", 2, False), ("t", 3, True)], "topic string, part int, paused boolean")
    now = spark.createDataFrame([("t", 0, False, False), ("t", 1, False, True), ("t", 2, True, False), ("t", 4, True, False)], "topic string, part int, pause boolean, resume boolean")
    got = {r["part"]: r["paused"] for r in flow.fold_paused(before, now).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_subpartition_progress(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("t", 0, 1, o, s, at(o + d)) for o in range(4) for d, s in enumerate(("accepting", "accepted", "processing", "processed")) if d < 4 - o]
    r = flow.subpartition_progress(spark.createDataFrame(rows, "topic string, part int, subpartition int, off long, stage string, at timestamp")).first()
    assert (r["accepting_offset"], r["accepted_offset"], r["processing_offset"], r["processed_offset"], r["processing_at"]) == (3, 2, 1, 0, at(3))


def test_order_within_a_subpartition(spark):
    rows = [("t", p, o, o % 3) for o in range(50, 0, -1) for p in range(2)]
    got = P.in_order(spark.createDataFrame(rows, f"{TPO}, subpartition int"), 5).withColumn("task", F.spark_partition_id()).collect()
    by = {}
    for r in got:
        by.setdefault((r["part"], r["subpartition"]), []).append((r["task"], r["off"]))
    for x in by.values():
        assert len({t for t, _ in x}) == 1 and [o for _, o in x] == sorted(o for _, o in x)
    assert len(by) == 6


def test_subscribe_and_start(spark):
    a, b = spark.range(3).select(F.lit(0).alias("part"), F.col("id").alias("off")), spark.range(2).select(F.lit(0).alias("part"), F.col("id").alias("off"), F.lit("v").alias("value"))
    log = subscribe({"a": a, "b": b})
    assert sorted((r["topic"], r["off"], r["value"]) for r in log.collect()) == [("a", 0, None), ("a", 1, None), ("a", 2, None), ("b", 0, "v"), ("b", 1, "v")]
    done = spark.createDataFrame([("a", 0, 2)], "topic string, part int, commit_offset long")
    places = lambda d: sorted((r["topic"], r["off"]) for r in d.collect())
    assert places(start_at(log, "earliest", done)) == [("a", 2), ("b", 0), ("b", 1)] and places(start_at(log, "latest", done)) == [("a", 2)]
    assert start_at(log, "latest").count() == 0 and start_at(log).count() == 5
    with pytest.raises(ValueError):
        subscribe({})
    assert offsets_json({1: 2, 0: 3}) == '{"0": 3, "1": 2}'


def test_ages(spark):
    r = spark.sql("SELECT timestamp_seconds(10) AS a, timestamp_seconds(40) AS b").select(older_than(F.col("a"), "30 seconds", F.col("b")), older_than(F.col("a"), "29 seconds", F.col("b")), age(F.col("a"), F.col("b")), older_than(F.col("a"), "1 day")).first()
    assert tuple(r) == (False, True, timedelta(seconds=30), True)


def test_checked_ranges(spark):
    good = spark.createDataFrame([("t", 0, 1, 1), ("t", 0, 2, 5)], "topic string, part int, lower long, upper long")
    assert R.checked(good).count() == 2
    with pytest.raises(Exception):
        R.checked(good.withColumn("upper", F.col("lower") - 1)).collect()


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_blocks_change_nothing(spark, block):
    """Ranges and queue sizes by blocks of offsets against plain Python, with gaps, block ends."""
    import random

    rng = random.Random(block)
    offs = {p: sorted(rng.sample(range(p, 150), 60 + 30 * p)) for p in range(3)} | {3: list(range(128)), 4: [63], 5: [0, 1, 6, 7, 8, 13, 14, 127]}
    rows = [("t", p, o, o % 2, rng.randrange(1, 9)) for p, x in offs.items() for o in x]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"{TPO}, subpartition int, weight long")
    want = []
    for p, x in offs.items():
        for o in x:
            if want and want[-1][0] == p and want[-1][2] == o - 1:
                want[-1][2] = o
            else:
                want.append([p, o, o])
    assert sorted([r["part"], r["lower"], r["upper"]] for r in R.from_offsets(df, block=block).collect()) == want
    sizes, sums = {}, {}
    for _, p, o, s, w in sorted(rows):
        sums[p, s] = sums.get((p, s), 0) + w
        sizes[p, o] = sums[p, s]
    assert {(r["part"], r["off"]): r["size"] for r in flow.queue_growth(df, block).collect()} == sizes
