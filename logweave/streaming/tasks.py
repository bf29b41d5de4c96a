"""User tasks: stateless over Arrow batches, or one stateful task per sub-partition with a gate and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, TimeoutError as FutureTimeout

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .config import ProcessingFailure, ProcessingTimeout


class Task:
    """What a user writes. All calls for one sub-partition are serial.

    ``process`` returns the outputs of one record (0 to n tuples), or a Future of them
    for asynchronous work; raising is a failure. ``state`` is a dict of strings kept
    per sub-partition.
    """

    def init(self, subpartition: tuple, options: dict) -> None: ...

    def accept(self, record: dict, state: dict) -> bool:
        return True

    def process(self, record: dict, state: dict):
        raise NotImplementedError

    def punctuate(self, now_ms: int, state: dict):
        return ()

    def close(self) -> None: ...


def _status(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])


def run_stateless(log: DataFrame, factory: Callable[[], Task], guarantee: str = "at_least_once", timeout_s: float = 300.0) -> DataFrame:
    """The records plus ok and error. Futures of a batch run together; one not done in time fails the query, whatever the guarantee."""
    schema = _status(log.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = factory()
        task.init((), {})
        try:
            for pdf in batches:
                got, ok, error = [], [], []
                for r in pdf.to_dict("records"):
                    try:
                        got.append(task.process(r, {}))
                    except Exception as e:  # reported below under the guarantee
                        got.append(e)
                for x in got:
                    try:
                        if isinstance(x, Exception):
                            raise x
                        if isinstance(x, Future):
                            x.result(timeout_s)
                        ok.append(True)
                        error.append(None)
                    except FutureTimeout as e:
                        raise ProcessingTimeout("a record was not reported in time") from e
                    except Exception as e:
                        if guarantee.lower() == "at_least_once":
                            raise ProcessingFailure(str(e)) from e
                        ok.append(False)
                        error.append(f"{type(e).__name__}: {e}")
                yield pdf.assign(ok=ok, error=error)
        finally:
            task.close()

    return log.mapInPandas(run, schema)


#: Columns beside a task's own outputs when results are asked for: where the row comes from and how its record ended.
RESULT = "topic string, part int, off long, ok boolean, error string"


class Processor(StatefulProcessor):
    """Runs a Task per sub-partition. Records are taken in offset order; a refused head waits in list state with all behind it.

    Held records keep the log's types. Under the guarantee ``none`` a failed record
    gives a dead letter: a row with its place, ok = false and the error, its outputs
    null. A head that waits longer than ``timeout_ms`` fails the query, also where its
    key gets no more records: a timer looks at it. A refused head is offered again after
    ``sleep_ms``, with the next records or with the next punctuation, whichever is first.
    """

    def __init__(self, factory, schema, output, options=None, punctuate_ms=0, timeout_ms=0, guarantee="at_least_once", sleep_ms=0):
        self.factory, self.schema, self.output, self.options = factory, schema, output, options or {}
        self.columns = schema.fieldNames()
        self.punctuate_ms, self.timeout_ms, self.guarantee, self.sleep_ms = punctuate_ms, timeout_ms, guarantee.lower(), sleep_ms

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("at", T.LongType()), *(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(self.schema.fields))]))
        self.state = handle.getMapState("state", "k string", "v string")
        self.tasks = {}

    def _task(self, key) -> Task:
        key = tuple(key)
        if key not in self.tasks:
            self.tasks[key] = self.factory()
            self.tasks[key].init(key, self.options)
        return self.tasks[key]

    def _row(self, out, record=None, error=None):
        if self.guarantee != "none":
            return tuple(out)
        place = [(record or {}).get(c) for c in ("topic", "part", "off")]
        return (*out, *place, error is None, error)

    def _run(self, key, records, now):
        """Take the longest accepted prefix; (outputs, what stays)."""
        task = self._task(key)
        state = {k[0]: v[0] for k, v in self.state.iterator()} if self.state.exists() else {}
        before, out, i = dict(state), [], 0
        width = len(self.output) - (5 if self.guarantee == "none" else 0)
        while i < len(records) and task.accept(records[i][1], state):
            r = records[i][1]
            try:
                got = task.process(r, state)
                out += [self._row(x, r) for x in (got.result(self.timeout_ms / 1000 or None) if isinstance(got, Future) else got or ())]
            except FutureTimeout as e:
                raise ProcessingTimeout(f"offset {r.get('off')} of {tuple(key)}") from e
            except Exception as e:
                if self.guarantee == "at_least_once":
                    raise ProcessingFailure(f"offset {r.get('off')} of {tuple(key)}: {e}") from e
                out.append(self._row([None] * width, r, f"{type(e).__name__}: {e}"))
            i += 1
        rest = records[i:]
        if rest and self.timeout_ms and now - rest[0][0] > self.timeout_ms:
            raise ProcessingTimeout(f"offset {rest[0][1].get('off')} of {tuple(key)}")
        return out, rest, state, before

    def _save(self, rest, state, before):
        for k, v in state.items():
            if before.get(k) != v:
                self.state.updateValue((k,), (str(v),))
        for k in before.keys() - state.keys():
            self.state.removeKey((k,))
        if rest:
            self.held.put([(at, *(r[c] for c in self.columns)) for at, r in rest])
        else:
            self.held.clear()

    def _held(self):
        return [(x[0], dict(zip(self.columns, x[1:], strict=True))) for x in self.held.get()] if self.held.exists() else []

    def _timers(self, rest, now):
        """The next look at this key: a punctuation, another try of its refused head, or the moment that head is due."""
        at = [now + self.punctuate_ms] if self.punctuate_ms else []
        if rest and self.timeout_ms:
            at.append(max(rest[0][0] + self.timeout_ms + 1, now + 1))
        if rest and self.sleep_ms:
            at.append(now + self.sleep_ms)
        set_ = [int(x) for x in self.handle.listTimers()]
        if at and not any(now < x <= min(at) for x in set_):
            self.handle.registerTimer(min(at))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        new = pd.concat(list(rows)).sort_values("off")[self.columns]
        new = [{c: plain(v) for c, v in r.items()} for r in new.to_dict("records")]
        out, rest, state, before = self._run(key, self._held() + [(now, r) for r in new], now)
        self._save(rest, state, before)
        self._timers(rest, now)
        yield pd.DataFrame(out, columns=self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        out, rest, state, before = self._run(key, self._held(), now)
        due = int(state.get(PUNCTUATED, 0)) + self.punctuate_ms
        if self.punctuate_ms and now >= due:
            out += [self._row(x) for x in self._task(key).punctuate(now, state) or ()]
            state[PUNCTUATED] = str(now)
        self._save(rest, state, before)
        self._timers(rest, now)
        yield pd.DataFrame(out, columns=self.output)

    def close(self):
        for task in getattr(self, "tasks", {}).values():
            task.close()


#: The key under which a sub-partition's state keeps the time of its last punctuation.
PUNCTUATED = "_punctuated"


def plain(v):
    """A value as Python has it: what pandas makes of missing values, times and bytes goes back."""
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, np.generic):
        v = v.item()
    return None if v is pd.NaT or isinstance(v, float) and v != v else v


def run_stateful(log: DataFrame, factory, output: str, keys=("topic", "part", "subpartition"), **options) -> DataFrame:
    """Stateful tasks over a streaming log; ``output`` is the schema of what tasks return. Needs the RocksDB state store.

    Under the guarantee ``none`` the columns of ``RESULT`` follow, ``record_`` before
    each name: dead letters are the rows that are not ok.
    """
    schema = T._parse_datatype_string(output)
    if options.get("guarantee", "at_least_once").lower() == "none":
        schema = T.StructType([*schema.fields, *(T.StructField(f"record_{f.name}", f.dataType) for f in T._parse_datatype_string(RESULT).fields)])
    p = Processor(factory, log.schema, [f.name for f in schema.fields], **options)
    mode = "ProcessingTime" if any(options.get(x) for x in ("punctuate_ms", "timeout_ms", "sleep_ms")) else "None"
    return log.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="append", timeMode=mode)


def merge_streams(left: DataFrame, right: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Two streams as one, each with its own watermark; the slower one holds the global one back."""
    return left.withWatermark("ts", delay).unionByName(right.withWatermark("ts", delay))
