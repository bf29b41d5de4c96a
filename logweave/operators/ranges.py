"""Closed integer ranges per key: islands, coalescing, subtraction, truncation, floor and ceiling search.

Windows are keyed by ``keys`` and a block of offsets, so a long partition is the work of
many tasks. What a block needs of the blocks before or after it, its base, is one row a
block; only those rows meet in one window a key. Searches are as-of joins by one union and
one window, so no range ever meets every other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("topic", "part")
#: Offsets that one task's window sees of a key; a long partition is the work of many tasks.
BLOCK = 1 << 20


def block_of(at: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(at) / block)


def with_base(x: DataFrame, per_block: DataFrame, keys=KEYS) -> DataFrame:
    """x(keys, _b, ...) with its block's base; both sides are dealt by key and block already, or the base is broadcast."""
    return x.join(per_block, [*keys, "_b"], "left")


def blocks(keys=KEYS):
    """Windows over one row a block: all blocks before, and the order of blocks."""
    w = Window.partitionBy(*keys).orderBy("_b")
    return w.rowsBetween(Window.unboundedPreceding, -1), w


def numbered(rows: DataFrame, by: str, name: str, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Number of each row within its key in the order of ``by``, from 0: its number in the block on top of the blocks before."""
    x = rows.withColumn("_b", block_of(by, block))
    before, _ = blocks(keys)
    base = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).select(*keys, "_b", F.sum("_n").over(before).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(by))
    return with_base(x.withColumn(name, own), base, keys).withColumn(name, F.coalesce("_n", F.lit(0)) + F.col(name) - 1).drop("_b", "_n")


def checked(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("upper", F.when(F.col("lower") <= F.col("upper"), F.col("upper")).otherwise(F.raise_error(F.lit("lower is above upper")).cast("long")))


def from_offsets(offsets: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Distinct offsets -> maximal closed ranges.

    Ranges are made inside blocks of offsets. Only those that touch an end of their
    block, two a block at most, meet in one window a key, where neighbours join.
    """
    w = Window.partitionBy(*keys, "_b").orderBy("off")
    x = offsets.select(*keys, "off", F.floor(F.col("off") / block).alias("_b"))
    x = x.withColumn("_g", F.col("off") - F.row_number().over(w)).groupBy(*keys, "_b", "_g").agg(F.min("off").alias("lower"), F.max("off").alias("upper"))
    inside = (F.col("lower") % block != 0) & ((F.col("upper") + 1) % block != 0)
    x = x.select(*keys, F.when(inside, F.col("_b")).alias("_b"), "lower", "upper")
    # one run of adjacent ranges has one "lower minus the lengths before it"; inside a block every range is its own
    e = Window.partitionBy(*keys, "_b").orderBy("lower")
    before = F.coalesce(F.sum(F.col("upper") - F.col("lower") + 1).over(e.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_g", F.when(F.col("_b").isNotNull(), F.col("lower")).otherwise(F.col("lower") - before))
    return x.groupBy(*keys, "_b", "_g").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper")).drop("_b", "_g")


def elements(ranges: DataFrame, descending: bool = False, keys=KEYS) -> DataFrame:
    seq = F.sequence("upper", "lower", F.lit(-1).cast("long")) if descending else F.sequence("lower", "upper")
    if not descending:
        return ranges.select(*keys, F.explode(seq).alias("off"))
    return ranges.select(*keys, F.posexplode(seq).alias("pos", "off"))


def coalesce(ranges: DataFrame, keys=KEYS, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Union of ranges: touching or overlapping ones merge; ``strict`` makes an overlap an error.

    A range opens a new one unless it touches what came before it in its block or, by the
    base, in an earlier block. What continues an earlier block, and the last that a block
    opens, two rows a block at most, meet in one window a key.
    """
    x = ranges.select(*keys, "lower", "upper", block_of("lower", block).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("lower", "upper")
    earlier, _ = blocks(keys)
    base = x.groupBy(*keys, "_b").agg(F.max("upper").alias("_m")).select(*keys, "_b", F.max("_m").over(earlier).alias("_m"))
    x = with_base(x, base, keys).withColumn("_m", F.greatest("_m", F.max("upper").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    if strict:
        x = x.withColumn("lower", F.when(F.col("_m") >= F.col("lower"), F.raise_error(F.lit("ranges overlap")).cast("long")).otherwise(F.col("lower")))
    x = x.withColumn("_g", F.when(F.col("_m") + 1 >= F.col("lower"), 0).otherwise(1))
    x = x.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*keys, "_b", "_g").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"))
    last = F.max("_g").over(Window.partitionBy(*keys, "_b"))
    x = x.select(*keys, "lower", "upper", "_g", F.when((F.col("_g") != 0) & (F.col("_g") != last), F.col("_b")).alias("_b"))
    opened = F.sum(F.when(F.col("_g") > 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "_b").orderBy("lower", "upper").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_g", F.when(F.col("_b").isNull(), opened).otherwise(F.col("_g")))
    return x.groupBy(*keys, "_b", "_g").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper")).drop("_b", "_g")


def subtract(ranges: DataFrame, removed: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """ranges minus removed, without exploding: a sweep over end points counts what covers each gap, block by block."""
    ends = lambda df, a, b: df.select(*keys, F.explode(F.array(F.struct(F.col("lower").alias("at"), F.lit(a).alias("x"), F.lit(b).alias("y")), F.struct((F.col("upper") + 1).alias("at"), F.lit(-a).alias("x"), F.lit(-b).alias("y")))).alias("e")).select(*keys, "e.*")
    p = ends(ranges, 1, 0).unionByName(ends(removed, 0, 1)).withColumn("_b", block_of("at", block))
    p = p.groupBy(*keys, "_b", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    earlier, order = blocks(keys)
    base = p.groupBy(*keys, "_b").agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"), F.min("at").alias("_at"))
    base = base.select(*keys, "_b", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_x", "_y")), F.lead("_at").over(order).alias("_at"))
    w = Window.partitionBy(*keys, "_b").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p = p.select(*keys, "_b", F.col("at").alias("lower"), F.lead("at").over(w).alias("upper"), F.sum("x").over(run).alias("x"), F.sum("y").over(run).alias("y"))
    p = with_base(p, base, keys).select(*keys, "lower", (F.coalesce("upper", "_at") - 1).alias("upper"), (F.col("x") + F.col("_x")).alias("x"), (F.col("y") + F.col("_y")).alias("y"))
    return coalesce(p.where("x > 0 AND y = 0").select(*keys, "lower", "upper"), keys, block=block)


def truncate(ranges: DataFrame, at: DataFrame, keys=KEYS) -> DataFrame:
    """Drop all elements up to at.max_element; a straddling range shrinks. Keys without a limit keep theirs."""
    j = ranges.join(at.select(*keys, "max_element"), list(keys), "left").where(F.col("max_element").isNull() | (F.col("upper") > F.col("max_element")))
    return j.select(*keys, F.greatest("lower", F.col("max_element") + 1).alias("lower"), "upper")


def _as_of(ranges: DataFrame, points: DataFrame, keys, forward: bool, block: int = BLOCK) -> DataFrame:
    """points(keys, x) with the range whose lower end is the last at or before x (or the first at or after).

    A block's base is the nearest range of the blocks before it (or after it).
    """
    null = lambda c: F.lit(None).cast(ranges.schema[c].dataType).alias(c)
    both = ranges.select(*keys, F.col("lower").alias("x"), F.lit(0).alias("q"), "lower", "upper").unionByName(points.select(*keys, F.col("x").cast("long").alias("x"), F.lit(1).alias("q"), null("lower"), null("upper")))
    both = both.select(*keys, block_of("x", block).alias("_b"), "x", "q", F.when(F.col("q") == 0, F.struct("lower", "upper")).alias("r"))
    order = lambda c: F.col(c).desc() if forward else F.col(c)
    nearest = F.last("r", ignorenulls=True)
    before = Window.partitionBy(*keys).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = both.groupBy(*keys, "_b").agg((F.min if forward else F.max)("r").alias("r")).select(*keys, "_b", nearest.over(before).alias("_r"))
    own = Window.partitionBy(*keys, "_b").orderBy(order("x"), "q").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*keys, "_b", "x", "q", nearest.over(own).alias("r")).where("q = 1")
    r = F.coalesce("r", "_r")
    return with_base(found, base, keys).select(*keys, "x", r["lower"].alias("lower"), r["upper"].alias("upper"))


def floor_range(ranges: DataFrame, points: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    return _as_of(ranges, points, keys, False, block)


def ceiling_range(ranges: DataFrame, points: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    return _as_of(ranges, points, keys, True, block)


def floor_element(ranges: DataFrame, points: DataFrame, keys=KEYS) -> DataFrame:
    """Greatest element at or below x, or null; ranges must not overlap."""
    return floor_range(ranges, points, keys).select(*keys, "x", F.when(F.col("upper").isNotNull(), F.least("x", "upper")).alias("element"))


def contains(ranges: DataFrame, points: DataFrame, keys=KEYS) -> DataFrame:
    return floor_range(ranges, points, keys).select(*keys, "x", F.coalesce(F.col("upper") >= F.col("x"), F.lit(False)).alias("contained"))


def min_existing(ranges: DataFrame, query: DataFrame, keys=KEYS) -> DataFrame:
    """Per query range (lower, upper) the smallest element that exists already, or null; ranges must not overlap.

    One search gives the range at or before the query's lower end and the start of the
    one that follows; a range below all others stands before each key's first.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    first = ranges.select(*keys).distinct().select(*keys, lowest.alias("lower"), lowest.alias("upper"))
    r = ranges.select(*keys, "lower", "upper").unionByName(first).withColumn("_b", block_of("lower"))
    base = r.groupBy(*keys, "_b").agg(F.min("lower").alias("_n")).select(*keys, "_b", F.lead("_n").over(blocks(keys)[1]).alias("_n"))
    ahead = F.lead("lower").over(Window.partitionBy(*keys, "_b").orderBy("lower"))
    r = with_base(r.withColumn("_next", ahead), base, keys).select(*keys, "lower", F.struct("upper", F.coalesce("_next", "_n").alias("next")).alias("upper"))
    f = _as_of(r, query.select(*keys, F.col("lower").alias("x")).distinct(), keys, False).select(*keys, F.col("x").alias("lower"), F.col("upper").alias("_f"))
    j = query.join(f, [*keys, "lower"])
    return j.select(*keys, "lower", "upper", F.when(F.col("_f.upper") >= F.col("lower"), F.col("lower")).when(F.col("_f.next") <= F.col("upper"), F.col("_f.next")).alias("existing"))


def encloses(ranges: DataFrame, query: DataFrame, keys=KEYS) -> DataFrame:
    f = floor_range(ranges, query.select(*keys, F.col("lower").alias("x")).distinct(), keys).select(*keys, F.col("x").alias("lower"), F.col("upper").alias("_u"))
    return query.join(f, [*keys, "lower"]).select(*keys, "lower", "upper", F.coalesce(F.col("_u") >= F.col("upper"), F.lit(False)).alias("enclosed"))


def summary(ranges: DataFrame, keys=KEYS) -> DataFrame:
    return ranges.groupBy(*keys).agg(F.min("lower").alias("first"), F.max("upper").alias("last"), F.sum(F.col("upper") - F.col("lower") + 1).alias("size"), F.count("*").alias("ranges"))
