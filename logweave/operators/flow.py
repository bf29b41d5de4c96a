"""Backpressure, gating, time-aware merge, failure handling, and gauges over the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import BLOCK

TP = ("topic", "part")
SUB = (*TP, "subpartition")


def queue_limits(total_bytes: int, subpartitions: int, resume_ratio: float = 0.9) -> tuple[int, int]:
    """(pause, resume) limits of a queue."""
    pause = total_bytes // max(1, subpartitions)
    return pause, int(resume_ratio * pause)


def total_budget(memory_bytes: int, ratio: float = 0.5) -> int:
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    return int(memory_bytes * ratio)


def queue_sizes(queued: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """queued(topic, part, subpartition, weight) -> size per queue; with registered(topic, part, subpartition) empty queues too."""
    sizes = queued.groupBy(*SUB).agg(F.sum("weight").alias("size"))
    if registered is None:
        return sizes
    return registered.select(*SUB).join(sizes, list(SUB), "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def queue_growth(queued: DataFrame, block: int = BLOCK) -> DataFrame:
    """Size of a record's queue after its push.

    Sums run inside blocks of offsets, each on top of the whole blocks before it, so a
    long queue is the work of many tasks.
    """
    x = queued.withColumn("_b", F.floor(F.col("off") / block))
    before = Window.partitionBy(*SUB).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*SUB, "_b").agg(F.sum("weight").alias("_s")).withColumn("_s", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    own = Window.partitionBy(*SUB, "_b").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("size", F.sum("weight").over(own)).join(base, [*SUB, "_b"]).withColumn("size", F.col("size") + F.col("_s")).drop("_b", "_s")


def pause_resume(sizes: DataFrame, total_bytes: int, resume_ratio: float = 0.9) -> DataFrame:
    """Per topic partition: pause (a queue at its limit, or all queues at the budget) and resume (budget free and every queue at its resume limit or below).

    The budget is shared among all registered queues, so ``sizes`` has a row for the empty
    ones too. The total and the number of queues are one row, joined once.
    """
    t = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.greatest(F.lit(1), F.count("*")).alias("n"))
    per = sizes.groupBy(*TP).agg(F.max("size").alias("largest"))
    j = per.join(F.broadcast(t))
    pause = F.floor(F.lit(total_bytes) / F.col("n"))
    return j.select(*TP, "largest", ((F.col("total") >= total_bytes) | (F.col("largest") >= pause)).alias("pause"), ((F.col("total") < total_bytes) & (F.col("largest") <= F.floor(pause * resume_ratio))).alias("resume"))


def fold_paused(before: DataFrame, now: DataFrame) -> DataFrame:
    """Hysteresis: a paused partition stays so until it may resume. before(topic, part, paused) has all assigned partitions, now comes from pause_resume.

    A partition without a row in ``now`` has no queue that holds it back, so it resumes.
    """
    j = before.select(*TP, "paused").join(now.select(*TP, "pause", "resume"), list(TP), "full")
    resume, pause = F.coalesce("resume", F.lit(True)), F.coalesce("pause", F.lit(False))
    return j.select(*TP, F.when(F.coalesce("paused", F.lit(False)), ~resume).otherwise(pause).alias("paused"))


def accepted_prefix(log: DataFrame, accept: Column, keys=SUB) -> DataFrame:
    """Records up to the first refused one of each sub-partition: a refused head holds back the rest."""
    x = log.withColumn("_a", accept)
    stop = x.where("NOT _a").groupBy(*keys).agg(F.min("off").alias("_stop"))
    return x.join(stop, list(keys), "left").where("_stop IS NULL OR off < _stop").drop("_a", "_stop")


def time_merge(log: DataFrame, left: str, right: str) -> DataFrame:
    """Event-time merge of two co-partitioned topics: all records up to the earlier of the two topics' last times."""
    two = log.where(F.col("topic").isin(left, right))
    last = two.groupBy("part").agg(F.max(F.when(F.col("topic") == left, F.col("ts"))).alias("_l"), F.max(F.when(F.col("topic") == right, F.col("ts"))).alias("_r"))
    # null where one side is empty: nothing of the partition is emitted
    return two.join(last, "part").where((F.col("ts") <= F.col("_l")) & (F.col("ts") <= F.col("_r"))).drop("_l", "_r")


def apply_guarantee(results: DataFrame, guarantee: str) -> DataFrame:
    """results(..., ok): under ``none`` failures count as processed and go to the dead letters; under ``at_least_once`` they stay open."""
    g = guarantee.lower()
    if g not in ("none", "at_least_once"):
        raise ValueError(f"unknown guarantee: {guarantee}")
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    return results.withColumns({"dead_letter": failed & F.lit(g == "none"), "ok": ~failed | F.lit(g == "none")})


def partition_gauges(ledger: DataFrame, commits: DataFrame) -> DataFrame:
    c = ledger.groupBy(*TP).agg(F.max("off").alias("consumed_offset"))
    return c.join(commits.select(*TP, F.col("commit_offset").alias("committed_offset")), list(TP), "left")


def subpartition_gauges(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*SUB).agg(F.max("off").alias("accepted_offset"), F.max(F.when(F.col("ok"), F.col("off"))).alias("processed_offset"))


def subpartition_progress(events: DataFrame) -> DataFrame:
    """events(topic, part, subpartition, off, stage, at), stages accepting, accepted, processing and processed: the last offset of each stage, and the time of the last processing."""
    last = [F.max(F.when(F.col("stage") == s, F.col("off"))).alias(f"{s}_offset") for s in ("accepting", "accepted", "processing", "processed")]
    return events.groupBy(*SUB).agg(*last, F.max(F.when(F.col("stage") == "processing", F.col("at"))).alias("processing_at"))


def poll_stats(log: DataFrame, batch: Column, size: Column) -> DataFrame:
    """Per poll: records, bytes, and smallest, largest, mean record."""
    x = log.select(batch.alias("poll"), size.alias("s"))
    return x.groupBy("poll").agg(F.count("*").alias("records"), F.sum("s").alias("bytes"), F.min("s").alias("min_size"), F.max("s").alias("max_size"), F.avg("s").alias("avg_size"))


def worst_snapshot(snapshots: DataFrame, max_size: int = 100) -> DataFrame:
    """snapshots(topic, part, at, ranges): of the last ``max_size`` per partition the one with most ranges, the latest of equals."""
    w = Window.partitionBy(*TP).orderBy(F.col("at").desc())
    s = snapshots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_size)
    return s.groupBy(*TP).agg(F.max(F.struct("ranges", "at")).alias("m")).select(*TP, "m.at", "m.ranges")
