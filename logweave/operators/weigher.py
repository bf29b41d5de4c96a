"""Record weights in bytes of heap, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizes:
    """Fixed values of a heap below 32 GiB; pass others for a larger one."""

    array_header: int = 16
    string: int = 32
    bytes_object: int = 24
    headers: int = 40
    header: int = 32
    record: int = 160


SMALL = Sizes()


def padded(x: Column) -> Column:
    return (F.ceil(x / 8) * 8).cast("long")


def byte_array(c: Column, s: Sizes = SMALL) -> Column:
    return F.coalesce(padded(F.octet_length(c) + s.array_header), F.lit(0))


def bytes_object(c: Column, s: Sizes = SMALL) -> Column:
    return F.when(c.isNull(), 0).otherwise(s.bytes_object + byte_array(c, s))


def string(c: Column, s: Sizes = SMALL) -> Column:
    """Characters beyond the basic plane count as two, as in UTF-16."""
    units = F.char_length(c) + F.char_length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))
    return F.coalesce(s.string + padded(units + s.array_header), F.lit(0))


def headers(c: Column, s: Sizes = SMALL) -> Column:
    return s.headers + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, h: a + s.header + string(h["key"], s) + byte_array(h["value"], s)), F.lit(0))


def record(key: Column, value: Column, topic: Column, heads: Column | None = None, s: Sizes = SMALL) -> Column:
    """key and value are weights already; user weighers are any Column."""
    return (s.record + key + value + string(topic, s) + (headers(heads, s) if heads is not None else F.lit(s.headers))).cast("long")
