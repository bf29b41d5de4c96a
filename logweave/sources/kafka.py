"""Kafka as a source: options from the engine's configuration, and Spark's Kafka columns as the record envelope.

Needs Spark's Kafka connector on the class path; only ``load`` uses it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import RECORD

#: Fixed values of Spark's connector: what stands for a partition's first and next offset.
EARLIEST, LATEST = -2, -1
#: Consumer options that the connector itself owns.
NOT_PASSED = ("enable.auto.commit", "auto.offset.reset", "group.id")


def starting_offsets(position: str = "latest", committed: dict | None = None, partitions=()) -> str:
    """``startingOffsets``: a word, or JSON once offsets are committed. committed: {(topic, part): next offset}; ``partitions`` without one start at the position."""
    if position not in ("earliest", "latest"):
        raise ValueError(f"unknown position: {position}")
    if not committed:
        return position
    out: dict = {}
    for topic, part in sorted({*partitions, *committed}):
        out.setdefault(topic, {})[str(part)] = committed.get((topic, part), EARLIEST if position == "earliest" else LATEST)
    return json.dumps(out)


def kafka_options(config, committed: dict | None = None, partitions=()) -> dict:
    """Options of ``readStream.format("kafka")`` for a ``Config``; ``auto.offset.reset`` gives the start position."""
    own = config.source_options()
    position = own.get("auto.offset.reset", "latest")
    if position not in ("earliest", "latest"):
        raise ValueError(f"unsupported auto.offset.reset: {position}")
    passed = {f"kafka.{k}": v for k, v in own.items() if k not in NOT_PASSED and not k.startswith("monitoring.")}
    return passed | {"subscribe": ",".join(config["consumer.topics"]), "startingOffsets": starting_offsets(position, committed, partitions), "includeHeaders": "true"}


def envelope(raw: DataFrame, text: bool = True) -> DataFrame:
    """The connector's columns as ``RECORD``; key and value as text, or as they are."""
    as_is = lambda c: F.col(c).cast("string") if text else F.col(c)
    heads = F.col("headers").cast(RECORD["headers"].dataType) if "headers" in raw.columns else F.lit(None).cast(RECORD["headers"].dataType)
    return raw.select("topic", F.col("partition").cast("int").alias("part"), F.col("offset").cast("long").alias("off"), F.col("timestamp").alias("ts"), as_is("key").alias("key"), as_is("value").alias("value"), heads.alias("headers"))


def load(spark: SparkSession, config, committed: dict | None = None, partitions=(), text: bool = True) -> DataFrame:
    return envelope(spark.readStream.format("kafka").options(**kafka_options(config, committed, partitions)).load(), text)
