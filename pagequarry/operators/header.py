"""File headers (668 bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import col, u32, u64
from ..functions.instants import packed, packed_error, packed_filetime
from ..functions.labels import fingerprint, fingerprint_code, state, state_code

SIZE = 668
SIGNATURE = 0x89ABCDEF
# Name, offset and kind of each field of the header that is decoded.
# i: unsigned 32 bits, q: unsigned 64 bits, t: log time. In the order of the file.
FIELDS = tuple(
    (name, int(offset), kind)
    for name, offset, kind in (
        line.split()
        for line in """checksum 0 i
version 8 i
type 12 i
time 16 q
state 52 i
position 56 q
shutdown_datetime 64 t
attach_datetime 72 t
attach_position 80 q
detach_datetime 88 t
detach_position 96 q
dbid 104 i
shadowing_disabled 208 i
last_object_id 212 i
major_version 216 i
minor_version 220 i
build_number 224 i
service_pack_number 228 i
file_format_revision 232 i
page_size 236 i
repair_count 240 i
repair_datetime 244 t
scrub_database_time 280 t
scrub_datetime 288 t
required_log 296 q
upgrade_exchange 304 i
upgrade_free_pages 308 i
upgrade_space_map_pages 312 i
creation_format_version 340 i
creation_format_revision 344 i
old_repair_count 364 i
ecc_fix_success_count 368 i
last_ecc_datetime 372 t
old_ecc_fix_success_count 380 i
ecc_fix_error_count 384 i
last_ecc_error_datetime 388 t
old_ecc_fix_error_count 396 i
bad_checksum_error_count 400 i
last_bad_checksum_error_datetime 404 t
old_bad_checksum_error_count 412 i
committed_log 416 i
nls_major_version 508 i
nls_minor_version 512 i
flags 664 i""".splitlines()
    )
)


def header_error(data: Column | str) -> Column:
    """What loses the header: too few bytes, or the first of its instants, in the file's order, that is none. Reads __name, its packed log times."""
    times = [F.concat(F.lit(f"{name}: "), packed_error(f"__{name}")) for name, _, kind in FIELDS if kind == "t"]
    return F.when(F.octet_length(col(data)) < SIZE, F.lit("header is short")).otherwise(F.coalesce(*times))


def decode_headers(files: DataFrame, data: str = "content", mode: str = "PERMISSIVE") -> DataFrame:
    """files' other columns, the fields, labels, signature_ok and error; with an error all of them are NULL. mode FAILFAST raises it."""
    kept = [c for c in files.columns if c != data]
    raw = {"i": u32, "q": u64, "t": packed}
    rows = files.select(*kept, data, *(raw[kind](data, offset).alias(f"__{name}") for name, offset, kind in FIELDS), u32(data, 4).alias("__signature"))
    rows = rows.select(*(c for c in rows.columns if c != data), header_error(data).alias("error"))
    if mode == "FAILFAST":
        rows = fail_fast(rows)
    good = F.col("error").isNull()
    own = [F.when(good, packed_filetime(f"__{name}") if kind == "t" else F.col(f"__{name}")).alias(name) for name, _, kind in FIELDS]
    out = rows.select(*kept, *own, F.when(good, F.col("__signature") == SIGNATURE).alias("signature_ok"), "error")
    labels = [fingerprint("version", "file_format_revision").alias("fingerprint"), fingerprint_code("version", "file_format_revision").alias("fingerprint_code"), state("state").alias("state_label"), state_code("state").alias("state_code")]
    return out.select("*", *(F.when(F.col("error").isNull(), c).alias(n) for c, n in zip(labels, ("fingerprint", "fingerprint_code", "state_label", "state_code"), strict=True)))


def fail_fast(rows: DataFrame, error: str = "error") -> DataFrame:
    return rows.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.col(error))).otherwise(F.col(error)).cast("string"))


def page_offset(number: Column | str, page_size: Column | str) -> Column:
    """Where a page begins: two pages of header stand before page 1."""
    return (col(number) + 1) * col(page_size)
