"""Stateful operators over a streaming log: a round robin that goes on across batches, and a merge of two topics by event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .tasks import plain


class _Dealer(StatefulProcessor):
    """Keeps how many records of a topic partition have been dealt. The counter is never reset."""

    def __init__(self, count, columns):
        self.count, self.columns = count, columns

    def init(self, handle):
        self.dealt = handle.getValueState("dealt", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("off", kind="stable")
        n = self.dealt.get()[0] if self.dealt.exists() else 0
        count = self.count.get(tuple(key), 1) if isinstance(self.count, dict) else self.count
        pdf["subpartition"] = [(n + i) % count for i in range(len(pdf))]
        self.dealt.update((n + len(pdf),))
        yield pdf[[*self.columns, "subpartition"]].astype({"subpartition": "int32"})

    def close(self):
        pass


def round_robin(log: DataFrame, count: int | dict) -> DataFrame:
    """The streaming form of ``RoundRobin``: the n-th record of a topic partition goes to n modulo count, n kept in state.

    count is a number or {(topic, partition): number}, 1 for others. Replayed batches
    get equal numbers, as the state is that of the batch before. Needs the RocksDB
    state store.
    """
    if any(c < 1 for c in (count.values() if isinstance(count, dict) else [count])):
        raise ValueError("count must be at least 1")
    out = T.StructType([*log.schema.fields, T.StructField("subpartition", T.IntegerType())])
    return log.groupBy("topic", "part").transformWithStateInPandas(_Dealer(count, log.columns), out, "append", "None")


class _Merger(StatefulProcessor):
    """Holds the records that the other side has not reached yet, and the latest time of each side."""

    def __init__(self, left, right, schema, time):
        self.sides, self.schema, self.columns, self.time = (left, right), schema, schema.fieldNames(), time

    def init(self, handle):
        kind = self.schema[self.time].dataType
        self.held = handle.getListState("held", T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(self.schema.fields)]))
        self.last = handle.getMapState("last", "topic string", T.StructType([T.StructField("at", kind)]))

    def handleInputRows(self, key, rows, timerValues):
        new = [{c: plain(v) for c, v in r.items()} for b in rows for r in b[self.columns].to_dict("records")]
        new = [r for r in new if r["topic"] in self.sides and r[self.time] is not None]
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        for r in new:
            if r["topic"] not in last or r[self.time] > last[r["topic"]]:
                last[r["topic"]] = r[self.time]
        for k, v in last.items():
            self.last.updateValue((k,), (v,))
        held = [dict(zip(self.columns, x, strict=True)) for x in self.held.get()] if self.held.exists() else []
        every = sorted([*held, *new], key=lambda r: (r[self.time], r["topic"], r["off"]))
        n = 0
        if len(last) == 2:
            reached = min(last.values())
            n = sum(r[self.time] <= reached for r in every)
        if every[n:]:
            self.held.put([tuple(r[c] for c in self.columns) for r in every[n:]])
        else:
            self.held.clear()
        yield pd.DataFrame(every[:n], columns=self.columns)

    def close(self):
        pass


def merge_by_time(log: DataFrame, left: str, right: str, time: str = "ts") -> DataFrame:
    """Two co-partitioned topics of a streaming log in one order of event time per partition.

    A record goes out once the other topic of its partition has reached its time; those
    that go out together are ordered by time, then topic, then offset, and what is ahead
    of the slower topic waits in state, across batches and restarts. While one topic is
    empty nothing of its partition goes out. A record that comes behind what has gone
    out already follows at once. Rows without a time and of other topics are left out.
    Needs the RocksDB state store.
    """
    if left == right:
        raise ValueError("two topics are required")
    return log.groupBy("part").transformWithStateInPandas(_Merger(left, right, log.schema, time), log.schema, "append", "None")
