"""Offset state over a ledger of consumed records: topic, part, off, ok (processed), consumed_at where timeouts matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import older_than
from . import ranges as R

TP = ("topic", "part")


def consumed_ranges(batch: DataFrame, at) -> DataFrame:
    """Ranges of one poll, stamped once."""
    return R.from_offsets(batch).withColumn("consumed_at", at)


def duplicate_consumed(consumed: DataFrame, added: DataFrame) -> DataFrame:
    """First offset of each added range that was consumed before, with the error's text (a fixed value)."""
    d = R.min_existing(consumed, added).where("existing IS NOT NULL")
    return d.withColumn("error", F.concat(F.lit("Offset: "), F.col("existing").cast("string"), F.lit(" for partition: "), F.col("topic"), F.lit("-"), F.col("part").cast("string"), F.lit(" was consumed before")))


def out_of_order(consumed: DataFrame) -> DataFrame:
    """Ranges (with seq, their order of arrival) that do not ascend or whose time goes back."""
    w = Window.partitionBy(*TP).orderBy("seq")
    return consumed.withColumns({"_u": F.lag("upper").over(w), "_t": F.lag("consumed_at").over(w)}).where("_u >= lower OR _t > consumed_at").drop("_u", "_t")


def bad_processed(consumed: DataFrame, processed: DataFrame) -> DataFrame:
    """Reports that must fail: processed twice (checked first) or never consumed. consumed(topic, part, off), processed the same."""
    n = processed.groupBy(*TP, "off").agg(F.count("*").alias("n"))
    j = n.join(consumed.select(*TP, "off", F.lit(True).alias("_c")), [*TP, "off"], "left")
    return j.where("n > 1 OR _c IS NULL").select(*TP, "off", F.when(F.col("n") > 1, "was processed before").otherwise("was not consumed before").alias("error"))


def commit_offsets(ledger: DataFrame) -> DataFrame:
    """Per partition one past the last record before the first unprocessed one; no row where the first is unprocessed.

    Two partial aggregations; no window over the log, so a long partition is not one task's work.
    """
    a = ledger.groupBy(*TP).agg(F.min(F.when(~F.col("ok"), F.col("off"))).alias("first_open"))
    done = ledger.where("ok").join(a, list(TP)).where("first_open IS NULL OR off < first_open")
    return done.groupBy(*TP).agg((F.max("off") + 1).alias("commit_offset"))


def timed_out(ledger: DataFrame, now, timeout: str) -> DataFrame:
    """The lowest unprocessed offset of each partition, if it was consumed before now - timeout (strictly)."""
    head = ledger.where("NOT ok").groupBy(*TP).agg(F.min(F.struct("off", "consumed_at")).alias("h")).select(*TP, "h.off", "h.consumed_at")
    return head.where(older_than(F.col("consumed_at"), timeout, now))


def _with_commit(ledger: DataFrame) -> DataFrame:
    return ledger.join(commit_offsets(ledger), list(TP), "left")


def retained_after_commit(ledger: DataFrame) -> DataFrame:
    return _with_commit(ledger).where("commit_offset IS NULL OR off >= commit_offset").drop("commit_offset")


def uncommitted_total(ledger: DataFrame) -> DataFrame:
    """Processed records that a restart would read again."""
    return retained_after_commit(ledger).where("ok").agg(F.count("*").alias("uncommitted"))


def status_counts(ledger: DataFrame) -> DataFrame:
    """Counts of consumed and processed offsets and of their ranges."""
    c, p = (R.summary(R.from_offsets(x)).select(*TP, F.col("size").alias(f"{n}_offsets"), F.col("ranges").alias(f"{n}_ranges")) for n, x in (("consumed", ledger), ("processed", ledger.where("ok"))))
    return c.join(p, list(TP), "left").na.fill(0)
