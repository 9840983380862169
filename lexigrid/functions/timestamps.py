"""Packed timestamps: seconds shifted left by 30 bits, or-ed with nanoseconds. The order is kept, as a second has under 2**30."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 30
MASK = (1 << BITS) - 1


def pack(tsec: Column, tnsec: Column) -> Column:
    return F.shiftleft(tsec.cast("bigint"), BITS).bitwiseOR(tnsec.cast("bigint").bitwiseAND(F.lit(MASK)))


def seconds(ts: Column) -> Column:
    return F.shiftright(ts, BITS)


def nanoseconds(ts: Column) -> Column:
    return ts.bitwiseAND(F.lit(MASK))


def rendered(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local time of the session's zone with six digits of microseconds."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds(ts)), pattern), F.format_string(".%06d", (nanoseconds(ts) / 1000).cast("bigint")))


def pack_py(tsec: int, tnsec: int = 0) -> int:
    return (tsec << BITS) | (tnsec & MASK)


def unpack_py(ts: int) -> tuple[int, int]:
    return ts >> BITS, ts & MASK
