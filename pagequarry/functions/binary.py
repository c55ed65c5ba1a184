"""Little-endian integers in binary columns, as plain Catalyst expressions, and their encoding.

Every reader gives NULL where the bytes aren't all there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def piece(data: Column | str, offset: Column | int, size: Column | int) -> Column:
    """size bytes from offset (counted from 0), or NULL."""
    data = col(data)
    if isinstance(offset, int) and isinstance(size, int) and size:
        return F.when(F.octet_length(data) >= offset + size, F.substring(data, offset + 1, size))
    offset, size = col(offset), col(size)
    inside = (offset >= 0) & (size >= 0) & (offset + size <= F.octet_length(data))
    return F.when(inside, F.when(size == 0, F.lit(b"")).otherwise(F.substring(data, (offset + 1).cast("int"), size.cast("int"))))


def _unsigned(data: Column | str, offset: Column | int, size: int) -> Column:
    """The digits of an integer: its bytes one by one, the last first."""
    data, offset = col(data), offset if isinstance(offset, int) else col(offset).cast("int")
    inside = F.octet_length(data) >= offset + size
    if not isinstance(offset, int):
        inside &= offset >= 0
    return F.when(inside, F.conv(F.hex(F.concat(*(F.substring(data, offset + i, F.lit(1)) for i in range(size, 0, -1)))), 16, 10))


def u64(data: Column | str, offset: Column | int = 0, size: int = 8) -> Column:
    """DECIMAL(20,0): unsigned 64 bits don't fit a BIGINT."""
    return _unsigned(data, offset, size).cast("decimal(20,0)")


def u32(data: Column | str, offset: Column | int = 0) -> Column:
    return _unsigned(data, offset, 4).cast("long")


def u16(data: Column | str, offset: Column | int = 0) -> Column:
    return _unsigned(data, offset, 2).cast("int")


def u8(data: Column | str, offset: Column | int = 0) -> Column:
    return _unsigned(data, offset, 1).cast("int")


def le(value: Column | str | int, size: int) -> Column:
    """The bytes of an integer: the reverse of the readers. Shifts put each byte in its place, and the whole is written as hex once."""
    value, turned = col(value).cast("long"), F.lit(0).cast("long")
    for i in range(size):
        turned = turned.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255).cast("long")), 8 * (size - 1 - i)))
    return F.unhex(F.lpad(F.hex(turned), 2 * size, "0"))


def zeros(size: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), col(size).cast("int")))


def first_error(*cases: tuple[Column, str]) -> Column:
    """The message of the first case that holds, else NULL."""
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def settled(rows: DataFrame, *made: str) -> DataFrame:
    """rows with the made columns behind a generator: the optimizer reads them as columns and doesn't write their making out in what uses them."""
    own = F.explode(F.array(F.struct(*made))).alias("__made")
    others = [c for c in rows.columns if c not in made]
    return rows.select(*others, own).select(*others, "__made.*")
