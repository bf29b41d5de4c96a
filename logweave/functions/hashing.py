"""Murmur2 as a Column expression: JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the public murmur2 algorithm.
M, SEED, MASK = 0x5BD1E995, 0x9747B28C, 0xFFFFFFFF



def murmur2(text: Column) -> Column:
    """Unsigned 32-bit murmur2 of the UTF-8 bytes; null stays null."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(F.encode(text, "UTF-8")).cast("long")
    byte = lambda h, i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    word = lambda i, n: sum((F.shiftleft(byte(hexed, i + j), 8 * j) for j in range(1, n)), byte(hexed, i))
    mul = lambda x: (x * F.lit(M).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
    xor_shift = lambda x, r: x.bitwiseXOR(F.shiftrightunsigned(x, r))

    def step(h, i):
        k = mul(xor_shift(mul(word(i * 4, 4)), 24))
        return mul(h).bitwiseXOR(k)

    full, tail = F.floor(size / 4).cast("int"), (size % 4).cast("int")
    idx = F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(idx, F.lit(SEED).cast("long").bitwiseXOR(size), step)
    at = full * 4
    h = F.when(tail == 0, h).when(tail == 1, mul(h.bitwiseXOR(word(at, 1)))).when(tail == 2, mul(h.bitwiseXOR(word(at, 2)))).otherwise(mul(h.bitwiseXOR(word(at, 3))))
    return xor_shift(mul(xor_shift(h, 13)), 15)
