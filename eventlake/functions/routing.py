"""The routing hash and its exact arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the djb2 hash, and its modulus.
START, FACTOR, MODULUS = 5381, 33, 1 << 64


def djb2(key: Column) -> Column:
    """Unsigned 64-bit djb2 of a text's UTF-8 bytes, as decimal(20,0): in ANSI mode longs would overflow."""
    raw = F.hex(F.encode(key, "UTF-8"))
    n = F.length(raw) / 2
    byte = lambda i: F.conv(F.substr(raw, F.lit(2) * i - 1, F.lit(2)), 16, 10).cast("decimal(20,0)")
    folded = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(START).cast("decimal(20,0)"), lambda h, i: ((h * FACTOR + byte(i)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)"))
    return F.when(n == 0, F.lit(START).cast("decimal(20,0)")).otherwise(folded)
