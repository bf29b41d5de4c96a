from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logweave.streaming.ordering import merge_by_time, round_robin

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "topic string, part int, off long, ts timestamp, key string"


@pytest.fixture
def replay(spark, tmp_path):
    """Runs a stateful operator over rows given batch by batch; its output, batch by batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def run(batches, operator, stop_after=None):
        out = []
        for i, rows in enumerate(batches):
            spark.createDataFrame([(t, p, o, datetime.fromtimestamp(s, timezone.utc) if s is not None else None, k) for t, p, o, s, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            got = []
            # a new query for each batch: state comes from the checkpoint, as after a restart
            q = operator(stream).writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            out.append(got)
        return out

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_round_robin_goes_on_across_batches(replay):
    batches = [[("t", p, o, 0, None) for p in range(2) for o in range(a, b)] for a, b in ((0, 4), (4, 5), (5, 11))]
    got = [r for b in replay(batches, lambda s: round_robin(s, {("t", 0): 3, ("t", 1): 2})) for r in b]
    assert sorted((r["part"], r["off"], r["subpartition"]) for r in got) == [(p, o, o % (3 - p)) for p in range(2) for o in range(11)]
    with pytest.raises(ValueError):
        round_robin(None, 0)


def test_merge_gates_and_orders(replay):
    left, right = [10, 50, 70, 130, 150], [30, 90, 110, 120, 140]
    rows = lambda t, p, x, a=0: [(t, p, a + i, s, f"{t}{s}") for i, s in enumerate(x)]
    batches = [rows("l", 0, left[:2]) + rows("l", 1, [40, 90, 20, 200]) + [("l", 0, 90, None, "no time"), ("x", 0, 0, 5, "other")], rows("r", 0, right[:2]), rows("l", 0, left[2:], 2) + rows("r", 0, right[2:], 2)]
    got = replay(batches, lambda s: merge_by_time(s, "l", "r"))
    at = [[int(r["ts"].replace(tzinfo=timezone.utc).timestamp()) for r in b] for b in got]
    assert at == [[], [10, 30, 50], [70, 90, 110, 120, 130, 140]]
    assert all(r["key"] == f"{r['topic']}{s}" and r["part"] == 0 for b, x in zip(got, at, strict=True) for r, s in zip(b, x, strict=True))


def test_merge_ties_and_late_records(replay):
    batches = [[("l", 0, 0, 10, "a"), ("r", 0, 0, 10, "b"), ("l", 0, 1, 10, "c")], [("r", 0, 1, 5, "late")]]
    got = replay(batches, lambda s: merge_by_time(s, "l", "r"))
    assert [[r["key"] for r in b] for b in got] == [["a", "c", "b"], ["late"]]
    with pytest.raises(ValueError):
        merge_by_time(None, "l", "l")
