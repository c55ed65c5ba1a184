"""Pages: header, checksums, flags, validity, and the tag directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import col, first_error, piece, u16, u32, u64
from ..functions.labels import has_flag, is_branch, page_flag_labels
from .header import fail_fast

HEADER_SIZE = 40
OLD_VERSION = 0x602
# Name, offset and reader of the fields of a page header; the checksum is apart.
FIELDS = (
    ("last_modification_time", 8, u64),
    ("previous_page_number", 16, u32),
    ("next_page_number", 20, u32),
    ("father_data_page_id", 24, u32),
    ("available_data_size", 28, u16),
    ("available_uncommitted_data_size", 30, u16),
    ("available_data_offset", 32, u16),
    ("available_page_tag", 34, u16),
    ("page_flags", 36, u32),
)
CHECKSUM = "struct<kind:string,checksum:decimal(20,0),xor:bigint,page_number:bigint,xor_checksum:bigint,ecc_checksum:bigint>"
# Fixed value: pages with flags from here on are not valid.
FLAGS_LIMIT = 0x340032
#: Page sizes whose tags have 15 bits from revision 17 on.
WIDE_SIZES, WIDE_REVISION = (16_384, 32_768), 17
#: Sizes at which old files would carry a longer header that no reader gets at.
EXTENDED_SIZES = (16_000, 32_000)


def page_header_error(data: Column | str, version: Column | str, revision: Column | str) -> Column:
    size = F.octet_length(col(data))
    extended = (col(version) == OLD_VERSION) & (col(revision) >= 0x11) & size.isin(*EXTENDED_SIZES)
    return first_error((size < HEADER_SIZE, "page header is short"), (extended, "extended header is out of reach"))


def checksum(data: Column | str, version: Column | str, revision: Column | str) -> Column:
    """A union: Win7 (64 bits), or in files of the old version by revision Exchange2003 or WinVista, whose second number reads as 0."""
    none = F.lit(None).cast("long")

    def made(kind: str, **known: Column) -> Column:
        names = ("xor", "page_number", "xor_checksum", "ecc_checksum")
        return F.struct(F.lit(kind).alias("kind"), known.get("checksum", F.lit(None)).cast("decimal(20,0)").alias("checksum"), *(known.get(n, none).cast("long").alias(n) for n in names))

    zero = F.lit(0).cast("long")
    old = col(version) == OLD_VERSION
    return (
        F.when(old & (col(revision) < 0x0B), made("Exchange2003", xor=u32(data, 0), page_number=zero))
        .when(old & (col(revision) < 0x11), made("WinVista", xor_checksum=u32(data, 0), ecc_checksum=zero))
        .otherwise(made("Win7", checksum=u64(data, 0)))
    )


def checksum_as(checksum: Column, kind: str) -> tuple[Column, Column]:
    """(the checksum if it is of that kind, error if not)."""
    same = checksum["kind"] == kind
    return F.when(same, checksum), F.when(~same, F.lit(f"not a {kind} checksum"))


def tag(raw: Column, revision: Column | str, page_size: Column | str) -> Column:
    """A 4-byte slot: size, then offset, with the flags in the offset's high bits."""
    return _tag_of(u32(raw, 0), revision, page_size)


def _tag_of(slot: Column, revision: Column | str, page_size: Column | str) -> Column:
    wide = (col(revision) >= WIDE_REVISION) & col(page_size).isin(*WIDE_SIZES)
    size, offset = slot.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int"), F.shiftright(slot, 16).cast("int")
    mask = F.when(wide, F.lit(0x7FFF)).otherwise(F.lit(0x1FFF))
    flags = F.when(wide, F.shiftright(offset, 15)).otherwise(F.shiftright(offset, 13))
    return F.when(
        slot.isNotNull(),
        F.struct(offset.bitwiseAND(mask).alias("value_offset"), flags.cast("int").alias("tag_flags"), size.bitwiseAND(mask).alias("value_size")),
    )


def tag_directory(data: Column | str, page_size: Column | str, revision: Column | str, flags: Column | str, count: Column | str) -> Column:
    """Slots from the page's end backwards, up to the first that is outside the page or whose value would end past it. A page that declares one tag has none."""
    data, page_size, count = col(data), col(page_size), col(count)
    length = F.octet_length(data)
    runs = (~has_flag(flags, "Empty")) & (count > 1) & (length > count)
    # the slots' numbers first: what is made of one names it several times
    slots = F.transform(F.transform(F.sequence(F.lit(1), count), lambda i: u32(data, page_size - i * 4)), lambda slot: _tag_of(slot, revision, page_size))
    good = F.transform(slots, lambda t: F.coalesce(t["value_offset"] + t["value_size"] <= length, F.lit(False)))
    stop = F.array_position(good, F.lit(False))
    return F.when(runs, F.when(stop == 0, slots).otherwise(F.slice(slots, F.lit(1), (stop - 1).cast("int")))).otherwise(F.array().cast("array<struct<value_offset:int,tag_flags:int,value_size:int>>"))


def valid_page(length: Column) -> Column:
    """Of decoded columns."""
    return (
        (F.col("page_flags") < FLAGS_LIMIT)
        & (F.col("available_data_size") <= length)
        & (F.col("available_data_offset") <= length)
        & (F.col("available_page_tag") <= length)
        & (F.col("available_uncommitted_data_size") <= F.col("available_data_size"))
        & ~has_flag("page_flags", "Erased")
        & ~has_flag("page_flags", "Repaired")
    )


def decode_pages(pages: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """pages: data, page_number, version, revision, page_size, and others that are kept.

    Adds the header's fields, checksum, extension (always NULL), header_size, valid, is_branch, flags, tags and error;
    with an error the others are NULL.
    """
    size = F.octet_length("data")
    error = first_error((F.col("page_size").isNull(), "header is short"), (size != F.col("page_size"), "page data has another size than a page"))
    error = F.coalesce(error, page_header_error("data", "version", "revision"))
    rows = pages.withColumn("error", error)
    if mode == "FAILFAST":
        rows = fail_fast(rows)
    good = F.col("error").isNull()
    rows = rows.select("*", *(F.when(good, read("data", at)).alias(name) for name, at, read in FIELDS), F.when(good, checksum("data", "version", "revision")).alias("checksum"))
    nothing = F.lit(None).cast("struct<ext_checksum1:decimal(20,0),ext_checksum2:decimal(20,0),ext_checksum3:decimal(20,0),page_number:decimal(20,0),unknown:decimal(20,0)>")
    return rows.select(
        "*",
        nothing.alias("extension"),
        F.when(good, F.lit(HEADER_SIZE)).alias("header_size"),
        valid_page(size).alias("valid"),
        is_branch("page_flags").alias("is_branch"),
        F.when(good, page_flag_labels("page_flags")).alias("flags"),
        F.when(good, tag_directory("data", "page_size", "revision", "page_flags", "available_page_tag")).alias("tags"),
    )


def tag_payload(index: Column | int) -> tuple[Column, Column]:
    """(bytes, error) of a tag of a decoded page, counted from 0."""
    index = col(index)
    found = F.get(F.col("tags"), index)
    at = F.col("header_size") + found["value_offset"]
    data = piece("data", at, found["value_size"])
    return data, first_error((found.isNull(), "no such tag"), (at + found["value_size"] > F.octet_length("data"), "tag ends outside the page"))


def page_tags(pages: DataFrame) -> DataFrame:
    """A row for each tag of decoded pages: tag_number, its fields, payload and error."""
    rows = pages.select("page_number", "data", "header_size", "tags", F.posexplode_outer("tags").alias("tag_number", "tag")).where("tag_number IS NOT NULL")
    payload, error = tag_payload(F.col("tag_number"))
    return rows.select("page_number", "tag_number", "tag.*", payload.alias("payload"), error.alias("error"))


def sweep(pages: DataFrame) -> DataFrame:
    """Decoded pages that have tags, are valid and aren't empty."""
    return pages.where(F.col("error").isNull() & (F.size("tags") > 0) & F.col("valid") & ~has_flag("page_flags", "Empty"))
