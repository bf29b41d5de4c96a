"""Sub-partitioning: strategies give a Column; a validated sub-partition is the unit of order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import murmur2
from .ranges import numbered


@dataclass(frozen=True)
class Partitioner:
    """``subpartition`` gives the Column; ``count`` the number per topic partition, a number or {(topic, partition): number}."""

    count: int | dict = 1
    default_count: int = 1

    def __post_init__(self):
        if any(c < 1 for c in (self.count.values() if isinstance(self.count, dict) else [self.count])):
            raise ValueError("count must be at least 1")

    def counts(self) -> Column:
        if not isinstance(self.count, dict):
            return F.lit(self.count)
        out = F.lit(self.default_count)
        for (t, p), n in self.count.items():
            out = F.when((F.col("topic") == t) & (F.col("part") == p), n).otherwise(out)
        return out

    def subpartition(self) -> Column:
        return F.lit(0)

    def assign(self, log: DataFrame) -> DataFrame:
        return log.withColumn("subpartition", self.subpartition().cast("int"))


class RoundRobin(Partitioner):
    """The n-th record of a topic partition, in offset order, goes to n modulo count; numbered by blocks of offsets."""

    def subpartition(self) -> Column:
        """As one window over a whole topic partition, for a caller that needs a Column; ``assign`` goes by blocks."""
        return (F.row_number().over(Window.partitionBy("topic", "part").orderBy("off")).cast("long") - 1) % self.counts()

    def assign(self, log: DataFrame) -> DataFrame:
        out = numbered(log.drop("subpartition"), "off", "_place", ("topic", "part"))
        return out.withColumn("subpartition", (F.col("_place") % self.counts()).cast("int")).drop("_place")


class Murmur2(Partitioner):
    """Murmur2 of ``key:partition`` with the sign bit cleared, modulo count; a null key is an error."""

    def subpartition(self) -> Column:
        key = F.when(F.col("key").isNull(), F.raise_error(F.lit("null key"))).otherwise(F.concat("key", F.lit(":"), F.col("part").cast("string")))
        return murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % self.counts()


@dataclass(frozen=True)
class Custom(Partitioner):
    """Any hash Column; the remainder keeps its sign, so a negative hash is rejected by validation."""

    hash_column: Column | None = field(default=None)

    def __post_init__(self):
        super().__post_init__()
        if self.hash_column is None:
            raise ValueError("a hash column is required")

    def subpartition(self) -> Column:
        return self.hash_column % self.counts()


def assign_subpartitions(log: DataFrame, partitioner: Partitioner, validate: bool = True) -> DataFrame:
    out = partitioner.assign(log)
    if validate:
        s = F.col("subpartition")
        out = out.withColumn("subpartition", F.when((s >= 0) & (s < partitioner.counts()), s).otherwise(F.raise_error(F.concat(F.lit("Invalid subpartition: "), s.cast("string"))).cast("int")))
    return out


def enumerate_subpartitions(partitions: DataFrame, partitioner: Partitioner) -> DataFrame:
    return partitions.select("topic", "part", F.explode(F.sequence(F.lit(0), partitioner.counts() - 1)).alias("subpartition"))


def in_order(log: DataFrame, n: int | None = None) -> DataFrame:
    """One shuffle that puts each sub-partition in one task, in offset order; a larger n is temporary re-scaling."""
    keys = ["topic", "part", "subpartition"]
    return (log.repartition(n, *keys) if n else log.repartition(*keys)).sortWithinPartitions(*keys, "off")


def assign_threads(subpartitions: DataFrame, threads: int) -> DataFrame:
    """Deal sub-partitions, sorted, round robin. The input is one row per sub-partition: metadata, not records."""
    if threads < 1:
        raise ValueError("threads must be at least 1")
    w = Window.orderBy("topic", "part", "subpartition")
    return subpartitions.withColumn("thread", ((F.row_number().over(w) - 1) % threads).cast("int"))


def tasks_per_thread(subpartitions: DataFrame, threads: int) -> DataFrame:
    return assign_threads(subpartitions, threads).groupBy("thread").agg(F.count("*").alias("tasks"))
