"""Log times (8 packed bytes) to file times (100 ns ticks since 1601).

Bytes: second, minute, hour, day, month, year since 1900; day and month count from 0, the last two bytes
are ignored. Limits are checked in that order. A day past the end of its month runs on into the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import col, first_error, u64

# Each byte's name and the first value that is out of range, in the order of the checks.
LIMITS = (("second", 60), ("minute", 60), ("hour", 24), ("day", 31), ("month", 12))
#: Ticks of 1970-01-01.
UNIX_EPOCH = 116_444_736_000_000_000


def packed(data: Column | str, offset: int = 0) -> Column:
    """The six bytes that count as one BIGINT, NULL where the log time's eight aren't there. Best made a column of its own: what reads it names it many times."""
    return F.when(F.octet_length(col(data)) >= offset + 8, u64(data, offset, 6).cast("long"))


def _byte(p: Column, i: int) -> Column:
    return F.shiftright(p, 8 * i).bitwiseAND(F.lit(255).cast("long")).cast("int")


def packed_error(p: Column | str) -> Column:
    p = col(p)
    return first_error((p.isNull(), "log time is short"), *((_byte(p, i) >= most, f"{name} out of range") for i, (name, most) in enumerate(LIMITS)))


def packed_filetime(p: Column | str) -> Column:
    """BIGINT ticks, NULL where packed_error is not."""
    p = col(p)
    second, minute, hour, day, month, year = (_byte(p, i) for i in range(6))
    valid = packed_error(p).isNull()
    days = F.datediff(F.make_date(year + 1900, month + 1, F.lit(1)), F.lit("1601-01-01").cast("date")).cast("long") + day
    return F.when(valid, (((days * 24 + hour) * 60 + minute) * 60 + second) * 10_000_000)


def log_time_error(data: Column | str, offset: int = 0) -> Column:
    return packed_error(packed(data, offset))


def filetime(data: Column | str, offset: int = 0) -> Column:
    """BIGINT ticks, NULL where log_time_error is not."""
    return packed_filetime(packed(data, offset))


def timestamp(ticks: Column | str) -> Column:
    return F.timestamp_micros(F.floor((col(ticks) - UNIX_EPOCH) / 10).cast("long"))
