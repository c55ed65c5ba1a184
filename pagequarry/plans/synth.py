"""Synthetic headers and pages, encoded by expressions: the input of queries and tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import col, le, settled, zeros

_SIZES = {"i": 4, "q": 8, "t": 8}


def layout(size: int, *parts: tuple[int, int, Column]) -> Column:
    """size bytes with the parts (offset, bytes, binary) in their places and zeros between."""
    out, at = [], 0
    for offset, n, data in sorted(parts, key=lambda p: p[0]):
        if offset > at:
            out.append(zeros(offset - at))
        out.append(data)
        at = offset + n
    return F.concat(*out, *([zeros(size - at)] if at < size else []))


def log_time(second, minute, hour, day, month, year) -> Column:
    return F.concat(*(le(x, 1) for x in (second, minute, hour, day, month, year)), zeros(2))


def page_header(**values) -> Column:
    """40 bytes; names as the decoder's, and checksum."""
    places = {"checksum": (0, 8), "last_modification_time": (8, 8), "previous_page_number": (16, 4), "next_page_number": (20, 4), "father_data_page_id": (24, 4), "available_data_size": (28, 2), "available_uncommitted_data_size": (30, 2), "available_data_offset": (32, 2), "available_page_tag": (34, 2), "page_flags": (36, 4)}
    return layout(40, *((*places[n], le(col(v), places[n][1])) for n, v in values.items()))


def tag_bytes(size: Column | int, offset: Column | int, flags: Column | int, bits: int = 13) -> Column:
    return F.concat(le(size, 2), le(col(offset).cast("int").bitwiseOR(F.shiftleft(col(flags).cast("int"), bits)), 2))


def page(payloads: Column | str, page_size: int = 4096, flags: Column | int = 0, tag_flags: Column | int = 0, break_tag: Column | int | None = None, **header) -> Column:
    """A page of an array of payloads; break_tag: the number of a tag whose size points past the page."""
    payloads = col(payloads)
    offsets = F.aggregate(payloads, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x))))
    body = F.aggregate(payloads, F.lit(b""), lambda a, x: F.concat(a, x))

    def slot(x: Column, i: Column) -> Column:
        size = x["size"]
        if break_tag is not None:
            size = F.when(i == col(break_tag), F.lit(8191)).otherwise(size)
        return F.hex(tag_bytes(size, x["at"], tag_flags))

    # with their offsets first: a slot's bytes name these several times
    placed = F.zip_with(payloads, F.slice(offsets, F.lit(1), F.size(payloads)), lambda x, o: F.struct(F.octet_length(x).alias("size"), o.alias("at")))
    tags = F.unhex(F.array_join(F.reverse(F.transform(placed, slot)), ""))
    count = F.size(payloads)
    head = page_header(available_page_tag=count, page_flags=flags, **header)
    fill = F.lit(page_size - 40) - F.octet_length(body) - count * 4
    return F.concat(head, body, zeros(fill), tags)
