"""Operators that go by blocks of offsets, with tiny blocks, against plain Python."""

import random

import pytest

from logweave.operators import ranges as R

SCHEMA = "topic string, part int, lower long, upper long"


def pick(rng, n, high, width):
    out = []
    for _ in range(n):
        a = rng.randrange(-high, high)
        out.append((a, a + rng.randrange(width)))
    return out


def islands(covered):
    out = []
    for x in sorted(covered):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return sorted(map(tuple, out))


def rows(df):
    return sorted((r["lower"], r["upper"]) for r in df.collect())


def frame(spark, pairs):
    return spark.createDataFrame([("t", 0, *x) for x in pairs] + [("u", 1, 3, 4)], SCHEMA)


@pytest.mark.parametrize("block", [1, 8, 64])
def test_coalesce_and_subtract(spark, block):
    rng = random.Random(block)
    for n, high, width in ((12, 30, 7), (25, 40, 4), (8, 30, 40)):
        a, b = pick(rng, n, high, width), pick(rng, n, high, width)
        covered = {x for lo, hi in a for x in range(lo, hi + 1)}
        gone = {x for lo, hi in b for x in range(lo, hi + 1)}
        got = R.coalesce(frame(spark, a + a[:2]), block=block)
        assert rows(got.where("topic = 't'")) == islands(covered), (n, high, width)
        assert rows(got.where("topic = 'u'")) == [(3, 4)]
        apart = R.coalesce(frame(spark, a), block=block)
        removed = spark.createDataFrame([("t", 0, *x) for x in b], SCHEMA)
        got = R.subtract(apart, removed, block=block)
        assert rows(got.where("topic = 't'")) == islands(covered - gone)
        assert rows(got.where("topic = 'u'")) == [(3, 4)]


def test_strict_coalesce_sees_overlaps_across_blocks(spark):
    long_one = frame(spark, [(0, 20), (21, 30)])
    assert rows(R.coalesce(long_one, strict=True, block=4).where("topic = 't'")) == [(0, 30)]
    with pytest.raises(Exception, match="ranges overlap"):
        R.coalesce(frame(spark, [(0, 20), (15, 16)]), strict=True, block=4).collect()


@pytest.mark.parametrize("block", [1, 4])
def test_searches(spark, block):
    rng = random.Random(block)
    own = islands({x for lo, hi in pick(rng, 12, 40, 5) for x in range(lo, hi + 1)})
    points = spark.createDataFrame([("t", 0, x) for x in range(-50, 50)] + [("v", 0, 1)], "topic string, part int, x long")
    get = lambda df: {(r["topic"], r["x"]): (r["lower"], r["upper"]) for r in df.collect()}
    floor, ceiling = get(R.floor_range(frame(spark, own), points, block=block)), get(R.ceiling_range(frame(spark, own), points, block=block))
    assert len(floor) == len(ceiling) == 101
    for x in range(-50, 50):
        assert floor["t", x] == max((r for r in own if r[0] <= x), default=(None, None)), x
        assert ceiling["t", x] == min((r for r in own if r[0] >= x), default=(None, None)), x
    assert floor["v", 1] == ceiling["v", 1] == (None, None)


@pytest.mark.parametrize("block", [1, 5])
def test_numbers(spark, block):
    rng = random.Random(block)
    off = rng.sample(range(200), 60)
    df = spark.createDataFrame([("t", 0, o) for o in off] + [("u", 0, 7)], "topic string, part int, off long")
    got = {(r["topic"], r["off"]): r["n"] for r in R.numbered(df, "off", "n", block=block).collect()}
    assert got == {("t", o): i for i, o in enumerate(sorted(off))} | {("u", 7): 0}


def test_empty_tables(spark):
    none, points = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "topic string, part int, x long")
    assert R.coalesce(none).count() == R.subtract(none, none).count() == R.floor_range(none, points).count() == R.min_existing(none, none).count() == 0
