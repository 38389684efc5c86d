"""FNV-1a, by which aggregates are dealt to segments, as a column and as a plain function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import InvalidPartitionConfigError

# fixed values of 32-bit FNV-1a
OFFSET, PRIME = 2166136261, 16777619


def fnv1a32(text: str) -> int:
    h = OFFSET
    for b in text.encode():
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h


def fnv1a32_column(text: Column) -> Column:
    """The same for a string column, in built-in functions; a long. The empty string has no bytes to fold."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    folded = F.aggregate(places, F.lit(OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(text == "", F.lit(OFFSET).cast("long")).otherwise(folded)


def segment_of(aggregate_id: Column, total: int) -> Column:
    """Segment of an aggregate; all aggregates are in segment 0 of one."""
    if total <= 1:
        return F.when(aggregate_id.isNotNull(), F.lit(0))
    return (fnv1a32_column(aggregate_id) % total).cast("int")


def in_segment(aggregate_id: Column, segment: int, total: int) -> Column:
    """The default partition strategy as a predicate."""
    if not 0 <= segment < max(total, 1):
        raise InvalidPartitionConfigError(f"segment {segment} of {total}")
    return F.lit(True) if total <= 1 else segment_of(aggregate_id, total) == segment
