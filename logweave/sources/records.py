"""The record envelope, logs as a union of topics, and a partitioned log as a stream source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.ranges import numbered
from ..streaming.control import paused_partitions

HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
RECORD = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("headers", T.ArrayType(HEADER)),
])


def subscribe(logs: dict[str, DataFrame]) -> DataFrame:
    """One log of several topics (batch or streaming): each frame gets its topic's name."""
    out = None
    for topic, df in logs.items():
        df = df.withColumn("topic", F.lit(topic))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no topics")
    return out


def serialized_size(key="key", value="value"):
    return F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


def start_at(log: DataFrame, position: str = "earliest", committed: DataFrame | None = None) -> DataFrame:
    """Records from the committed offset on; partitions without one start at ``earliest`` or ``latest``."""
    if committed is None:
        return log if position == "earliest" else log.limit(0)
    j = log.join(committed.select("topic", "part", "commit_offset"), ["topic", "part"], "left")
    rest = F.lit(position == "earliest")
    return j.where(F.when(F.col("commit_offset").isNotNull(), F.col("off") >= F.col("commit_offset")).otherwise(rest)).drop("commit_offset")


def events_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The ``events`` table as a log: topic = event type, partition = user modulo, dense offsets; ok marks processed ones, so they have gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.col("event_type").alias("topic"), (F.col("user_id") % partitions).cast("int").alias("part"), "event_id", "ts", F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), (F.col("event_id") % 7 != 0).alias("ok"))
    return numbered(log, "event_id", "off").withColumn("off", F.col("off").cast("long")).drop("event_id")


class _Slice(InputPartition):
    def __init__(self, part: int, lo: int, hi: int):
        self.part, self.lo, self.hi = part, lo, hi


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.parts, self.rows, self.step = int(options.get("partitions", 2)), int(options.get("rows", 100)), int(options.get("maxoffsetspertrigger", options.get("maxOffsetsPerTrigger", 10)))
        self.topic, self.control = options.get("topic", "generated"), options.get("control")
        self.at = None

    def initialOffset(self):
        return {str(p): 0 for p in range(self.parts)}

    def latestOffset(self):
        # admission: at most ``step`` records of each partition beyond what was read last, none of a paused one; the end is a fact of the log
        paused = {str(p) for t, p in paused_partitions(self.control) if t == self.topic}
        self.at = {p: o if p in paused else min(o + self.step, self.rows) for p, o in (self.at or self.initialOffset()).items()}
        return self.at

    def partitions(self, start, end):
        self.at = {p: max(end[p], (self.at or end)[p]) for p in end}
        return [_Slice(int(p), start[p], end[p]) for p in end if end[p] > start[p]]

    def read(self, partition):
        for i in range(partition.lo, partition.hi):
            yield (self.topic, partition.part, i, f"key_{i}", f"value_{i}")

    def commit(self, end):
        pass


class GeneratedLog(DataSource):
    """A deterministic partitioned log for tests and demos: ``spark.readStream.format("generated_log")``.

    Options: partitions, rows (of each), topic, maxOffsetsPerTrigger, and control, the
    file on the driver in which ``Admission`` names the paused partitions.
    """

    @classmethod
    def name(cls):
        return "generated_log"

    def schema(self):
        return "topic string, part int, off bigint, key string, value string"

    def streamReader(self, schema):
        return _Reader(self.options)


def offsets_json(offsets: dict) -> str:
    return json.dumps({str(k): v for k, v in offsets.items()}, sort_keys=True)
