"""The driver's queries over the page engine: bytes are made from the columns of its tables, decoded, and held against SQL on the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import le, settled
from ..functions.instants import packed, packed_error, packed_filetime
from ..functions.labels import PAGE_FLAGS, has_flag, is_branch, page_flag_labels, tag_flag_labels
from ..operators import bulk
from ..operators.entries import edges, nth_page_key, page_entries, page_kind, parse_issues, root_pages, tree_pages
from ..operators.header import FIELDS, SIGNATURE, decode_headers, page_offset
from ..operators.page import checksum, checksum_as, decode_pages, page_tags, sweep, tag
from .sql import compiled, register_functions
from .synth import layout, log_time, page, page_header, tag_bytes

PER_PAGE = 40
#: Entries of a root page, of which 4,096 bytes hold 223 behind a header of 25 bytes; and the range of keys that a nation's entries are gathered by.
PER_ROOT, ROOT_KEYS = 200, 4000
_SIZE = {"i": 4, "q": 8, "t": 8}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return compiled(spark).read.parquet(f"{sf}/{name}.parquet")


def _long(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("long").alias(alias or name.split(".")[-1])


def _hex(x: Column) -> Column:
    return F.coalesce(F.hex(x), F.lit("-"))


def key8(x: Column | str) -> Column:
    return F.unhex(F.lpad(F.hex(F.col(x) if isinstance(x, str) else x), 16, "0"))


def pages_of(rows: DataFrame, number: Column, order: str, payload: Column, first: Column, flags: Column | int = 0, tag_flags: Column | int = 0, break_tag=None, revision: int = 20, version: int = 0x620, **header) -> DataFrame:
    """Decoded pages of up to PER_PAGE payloads each, behind the first payload."""
    grouped = rows.select(number.cast("long").alias("page_number"), F.struct(F.col(order).alias("o"), payload.alias("p")).alias("x")).groupBy("page_number").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    payloads = F.concat(F.array(first), F.transform("xs", lambda x: x["p"]))
    raw = settled(grouped.select("page_number", payloads.alias("payloads")), "payloads").select("page_number", page("payloads", flags=flags, tag_flags=tag_flags, break_tag=break_tag, **header).alias("data"))
    return decode_pages(settled(raw, "data").select("page_number", "data", F.lit(version).cast("long").alias("version"), F.lit(revision).cast("long").alias("revision"), F.lit(4096).cast("long").alias("page_size")))


def _order_page() -> Column:
    return F.floor(F.col("o_orderkey") / PER_PAGE) + 1


def _branch_payload() -> Column:
    return F.concat(le(8, 2), key8("o_orderkey"), le("o_custkey", 4))


def branch_pages(spark: SparkSession, sf: str, **how) -> DataFrame:
    return pages_of(_table(spark, sf, "orders"), _order_page(), "o_orderkey", how.pop("payload", _branch_payload()), F.unhex(F.lit("AABB")), **how)


# --- instants, headers


def logtime_filetime(spark, sf):
    e = _table(spark, sf, "events")
    raw = log_time(F.second("ts"), F.minute("ts"), F.hour("ts"), F.dayofmonth("ts") - 1, F.month("ts") - 1, F.year("ts") - 1900)
    return e.select("event_id", raw.alias("raw")).select("event_id", packed("raw").alias("p")).select("event_id", packed_filetime("p").alias("filetime"))


def logtime_invalid(spark, sf):
    raw = log_time(F.col("l_orderkey") % 64, F.col("l_partkey") % 64, F.col("l_suppkey") % 25, F.col("l_orderkey") % 33, F.col("l_partkey") % 13, F.lit(100))
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", "l_suppkey", raw.alias("raw"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", packed("raw").alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", packed_filetime("p").alias("filetime"), F.coalesce(packed_error("p"), F.lit("-")).alias("error"))


def _headers(spark, sf, revision=20, version=0x620, state_value=3) -> DataFrame:
    """A 668-byte header for each customer: every number field is the key plus its place in the list, every instant 1900-01-01 plus the key's seconds."""
    c = _table(spark, sf, "customer")
    own = {"version": version, "file_format_revision": revision, "state": state_value, "page_size": 4096}
    parts = []
    for i, (name, offset, kind) in enumerate(FIELDS):
        value = own.get(name, F.col("c_custkey") + i)
        data = log_time(F.col("c_custkey") % 60, F.lit(i), F.lit(1), F.col("c_custkey") % 28, F.lit(2), F.lit(100)) if kind == "t" else le(value, _SIZE[kind])
        parts.append((offset, _SIZE[kind], data))
    parts.append((4, 4, le(F.when(F.col("c_custkey") % 2 == 1, SIGNATURE).otherwise(0), 4)))
    return settled(c.select("c_custkey", "c_nationkey", layout(668, *parts).alias("content")), "content")


def header_decode(spark, sf):
    d = decode_headers(_headers(spark, sf))
    return d.select("c_custkey", *(_long(n) for n, _, _ in FIELDS), "fingerprint", "state_label", "signature_ok")


def _header_decode_sql() -> str:
    own = {"version": "1568", "file_format_revision": "20", "state": "3", "page_size": "4096"}
    columns = []
    for i, (name, _, kind) in enumerate(FIELDS):
        day = "(date_diff('day', DATE '1601-01-01', DATE '2000-03-01') + c_custkey % 28)"
        columns.append(f"{f'((({day} * 24 + 1) * 60 + {i}) * 60 + c_custkey % 60) * 10000000' if kind == 't' else own.get(name, f'c_custkey + {i}')}::BIGINT AS {name}")
    return f"SELECT c_custkey, {', '.join(columns)}, 'Exchange2013Ad2016' AS fingerprint, 'CleanShutdown' AS state_label, c_custkey % 2 = 1 AS signature_ok FROM customer"


def header_fingerprint(spark, sf):
    revisions = F.array(*(F.lit(x) for x in (0, 9, 11, 12, 17, 20, 200, 230, 5)))
    version = F.when(F.col("c_custkey") % 5 == 0, F.lit(0x623)).when(F.col("c_custkey") % 7 == 0, F.lit(0x602)).otherwise(F.lit(0x620))
    d = decode_headers(_headers(spark, sf, F.get(revisions, (F.col("c_custkey") % 9).cast("int")), version))
    return d.select("c_custkey", "version", "file_format_revision", "fingerprint", _long("fingerprint_code"))


def header_state(spark, sf):
    d = decode_headers(_headers(spark, sf, state_value=F.col("c_nationkey") % 8))
    return d.select("c_custkey", "state", "state_label", _long("state_code"))


def header_errors(spark, sf):
    """Headers cut short, and with an instant that is none."""
    rows = _headers(spark, sf)
    broken = F.concat(F.substring("content", 1, 88), F.unhex(F.lit("003C000000000000")), F.substring("content", 97, 572))
    rows = rows.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.substring("content", 1, 667)).when(F.col("c_custkey") % 3 == 1, broken).otherwise(F.col("content")).alias("content"))
    return decode_headers(rows).select("c_custkey", F.coalesce("error", F.lit("-")).alias("error"), F.coalesce("version", F.lit(-1)).alias("version"))


def page_offsets(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", page_offset("p_partkey", F.lit(4096).cast("long")).alias("page_offset"))


# --- page headers


def _flag_value() -> Column:
    return (F.col("l_orderkey") * 37 + F.col("l_partkey") * 8191 + F.col("l_linenumber") * 3) % (1 << 22)


def _line_header() -> Column:
    return page_header(checksum=F.col("l_orderkey") * 65536, last_modification_time="l_partkey", previous_page_number="l_suppkey", next_page_number=F.col("l_orderkey") + 1, father_data_page_id="l_partkey", available_data_size=F.col("l_partkey") % 65536, available_uncommitted_data_size=F.col("l_suppkey") % 65536, available_data_offset=F.col("l_orderkey") % 65536, available_page_tag=F.lit(1), page_flags=_flag_value())


def _line_pages(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", "l_suppkey", _line_header().alias("data"))
    return rows.select("*", F.lit(0).cast("long").alias("page_number"), F.lit(0x620).cast("long").alias("version"), F.lit(20).cast("long").alias("revision"), F.lit(40).cast("long").alias("page_size"))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_FLAG_SQL = "((l_orderkey * 37 + l_partkey * 8191 + l_linenumber * 3) % 4194304)"


def page_header_decode(spark, sf):
    d = decode_pages(_line_pages(spark, sf))
    names = ("last_modification_time", "previous_page_number", "next_page_number", "father_data_page_id", "available_data_size", "available_uncommitted_data_size", "available_data_offset", "available_page_tag", "page_flags")
    return d.select(*_LINE, _long("checksum.checksum"), F.col("checksum.kind").alias("kind"), _long("header_size"), *(_long(n) for n in names))


_PAGE_HEADER_FIELDS = f"""l_partkey AS last_modification_time, l_suppkey AS previous_page_number, l_orderkey + 1 AS next_page_number, l_partkey AS father_data_page_id,
(l_partkey % 65536)::BIGINT AS available_data_size, (l_suppkey % 65536)::BIGINT AS available_uncommitted_data_size, (l_orderkey % 65536)::BIGINT AS available_data_offset, 1::BIGINT AS available_page_tag, {_FLAG_SQL}::BIGINT AS page_flags"""


def bulk_page_headers(spark, sf):
    rows = _line_pages(spark, sf).withColumn("page_number", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    d = bulk.page_headers(rows)
    return d.select(*(_long(n) for n in d.columns))


def _high_bits(spark, sf) -> DataFrame:
    """Unsigned numbers with their highest bit set."""
    top = (1 << 32) - 1
    head = page_header(checksum=-F.col("s_suppkey"), last_modification_time=-(F.col("s_suppkey") * 7919), previous_page_number=top - F.col("s_suppkey"), next_page_number=F.lit(top), father_data_page_id=F.col("s_suppkey") + (1 << 31), available_data_size=F.lit(65535), available_uncommitted_data_size=F.col("s_suppkey") % 100 + 65000, available_data_offset=F.lit(32768), available_page_tag=F.lit(1), page_flags=top - F.col("s_suppkey"))
    rows = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_number"), head.alias("data"))
    return settled(rows, "data").select("*", F.lit(0x620).cast("long").alias("version"), F.lit(20).cast("long").alias("revision"), F.lit(40).cast("long").alias("page_size"))


_HIGH = ("last_modification_time", "previous_page_number", "next_page_number", "father_data_page_id", "available_data_size", "available_uncommitted_data_size", "available_data_offset", "available_page_tag", "page_flags")


def page_header_high_bits(spark, sf):
    d = decode_pages(_high_bits(spark, sf))
    return d.select("page_number", F.col("checksum.checksum").cast("string").alias("checksum"), *(F.col(n).cast("string").alias(n) for n in _HIGH))


def bulk_high_bits(spark, sf):
    return bulk.page_headers(_high_bits(spark, sf)).select("page_number", *(F.col(n).cast("string").alias(n) for n in _HIGH))


def page_checksum_variants(spark, sf):
    revisions = F.explode(F.array(*(F.lit(r).cast("long") for r in (9, 11, 16, 17, 20)))).alias("revision")
    rows = _table(spark, sf, "supplier").select("s_suppkey", revisions, page_header(checksum=F.col("s_suppkey") * 4294967296 + F.col("s_nationkey")).alias("data"))
    made = rows.select("s_suppkey", "revision", checksum("data", F.lit(0x602), "revision").alias("c"))
    out = made.select("s_suppkey", "revision", F.col("c.kind").alias("kind"), *(F.coalesce(F.col(f"c.{n}").cast("long"), F.lit(-1)).alias(n) for n in ("checksum", "xor", "page_number", "xor_checksum", "ecc_checksum")), *(checksum_as(F.col("c"), k)[1].isNull().alias(f"is_{k.lower()}") for k in ("Win7", "Exchange2003", "WinVista")))
    return out


def page_flag_predicates(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", _flag_value().alias("f"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", is_branch("f").alias("is_branch"), *(has_flag("f", n).alias(f"is_{n.lower()}") for n in PAGE_FLAGS))


def page_flag_names(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", _flag_value().alias("f"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(page_flag_labels("f"), ",").alias("flags"))


def page_valid(spark, sf):
    rows = _table(spark, sf, "lineitem")
    data = F.concat(page_header(available_data_size=F.col("l_partkey") % 128, available_uncommitted_data_size=F.col("l_suppkey") % 64, available_data_offset=F.col("l_orderkey") % 110, available_page_tag=F.col("l_linenumber") * 20, page_flags=_flag_value()), F.unhex(F.repeat(F.lit("00"), 60)))
    made = rows.select("l_orderkey", _long("l_linenumber"), "l_partkey", "l_suppkey", data.alias("data"), F.lit(0).alias("page_number"), F.lit(0x620).alias("version"), F.lit(20).alias("revision"), F.lit(100).alias("page_size"))
    return decode_pages(made).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "valid")


# --- tags


def _tag(spark, sf, page_size: int, bits: int) -> DataFrame:
    raw = tag_bytes(F.col("l_partkey") % (1 << bits), F.col("l_suppkey") % (1 << bits), F.col("l_linenumber") % (1 << (16 - bits)), bits)
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", "l_suppkey", raw.alias("raw")).select("*", tag(F.col("raw"), F.lit(20), F.lit(page_size)).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _long("t.value_offset"), _long("t.tag_flags"), _long("t.value_size"), F.array_join(tag_flag_labels("t.tag_flags"), ",").alias("labels"))


def tag_decode_13bit(spark, sf):
    return _tag(spark, sf, 4096, 13)


def tag_decode_15bit(spark, sf):
    return _tag(spark, sf, 32768, 15)


def _tag_sql(bits: int) -> str:
    return f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_suppkey % {1 << bits} AS value_offset, f AS tag_flags, l_partkey % {1 << bits} AS value_size,
concat_ws(',', CASE WHEN f & 1 > 0 THEN 'VariableSize' END, CASE WHEN f & 2 > 0 THEN 'Defunct' END, CASE WHEN f & 4 > 0 THEN 'CommonKey' END) AS labels
FROM (SELECT *, (l_linenumber % {1 << (16 - bits)})::BIGINT AS f FROM lineitem)"""


def tag_directory(spark, sf):
    d = page_tags(branch_pages(spark, sf, tag_flags=1))
    return d.select("page_number", _long("tag_number"), _long("value_offset"), _long("tag_flags"), _long("value_size"))


def tag_directory_truncated(spark, sf):
    d = branch_pages(spark, sf, break_tag=F.col("page_number") % 7 + 3)
    return d.select("page_number", F.size("tags").cast("long").alias("n_tags"))


def bulk_tags(spark, sf):
    d = bulk.page_tags(branch_pages(spark, sf, tag_flags=1, break_tag=F.col("page_number") % 7 + 3).select("page_number", "data", "revision", "page_size"))
    return d.groupBy("page_number").agg(F.count("*").alias("n_tags"), F.sum("value_offset").alias("offsets"), F.sum("value_size").alias("sizes"), F.sum("tag_flags").alias("marks"))


def tag_payloads(spark, sf):
    d = page_tags(branch_pages(spark, sf))
    return d.select("page_number", _long("tag_number"), _hex(F.col("payload")).alias("payload"), F.coalesce("error", F.lit("-")).alias("error"))


# --- trees


def page_dispatch(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", _long("l_linenumber"), "l_partkey", _flag_value().alias("page_flags"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(page_kind(), F.lit("none")).alias("kind"))


def branch_entries(spark, sf):
    e = page_entries(tree_pages(branch_pages(spark, sf)))
    return e.select("page_number", _long("tag_number"), _long("page_key_size"), _hex(F.col("page_key")).alias("page_key"), "child_page_number", "entry_kind")


def _broken() -> Column:
    """Every 5th entry is short, every 7th has a key that is too long for it."""
    k = F.col("o_orderkey")
    return F.when(k % 5 == 0, F.unhex(F.lit("0800000000"))).when(k % 7 == 0, F.concat(le(9, 2), key8("o_orderkey"), le("o_custkey", 4))).otherwise(_branch_payload())


def branch_entries_malformed(spark, sf):
    e = page_entries(tree_pages(branch_pages(spark, sf, payload=_broken())))
    return e.select("page_number", _long("tag_number"), _hex(F.col("page_key")).alias("page_key"), "child_page_number")


def parse_issue(spark, sf):
    return parse_issues(tree_pages(branch_pages(spark, sf, payload=_broken()))).select("page_number", _long("tag_number"), "error")


def page_edges(spark, sf):
    d = edges(tree_pages(branch_pages(spark, sf, previous_page_number=F.col("page_number") - 1, next_page_number=F.col("page_number") + 1)))
    return d.groupBy("edge_kind").agg(F.count("*").alias("n"), F.sum("src_page").alias("src"), F.sum("dst_page").alias("dst"))


def _leaf(spark, sf, flags: int, rest: Column, tag_flags: int = 0) -> DataFrame:
    payload = F.concat(le(8, 2), key8("l_orderkey"), le("l_partkey", 4), rest)
    rows = _table(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    pages = pages_of(rows, F.floor(F.col("l_orderkey") / 8) + 1, "o", payload, F.unhex(F.lit("CC")), flags=flags, tag_flags=tag_flags)
    return page_entries(tree_pages(pages))


def leaf_table_entries(spark, sf):
    e = _leaf(spark, sf, 0x2 | 0x80, key8("l_suppkey"))
    return e.select("page_number", _hex(F.col("page_key")).alias("page_key"), "child_page_number", "payload_kind", _hex(F.col("table_value")).alias("table_value"))


def leaf_index_entries(spark, sf):
    e = _leaf(spark, sf, 0x2 | 0x40, key8("l_suppkey"))
    return e.select("page_number", _hex(F.col("page_key")).alias("page_key"), "child_page_number", "payload_kind", _hex(F.col("record_page_key")).alias("record_page_key"))


def _leaf_space(spark, sf, tag_flags: int) -> DataFrame:
    e = _leaf(spark, sf, 0x2 | 0x20, F.concat(le(7, 2), le(3, 2), le("l_suppkey", 3), le(77, 2), le("l_linenumber", 4)), tag_flags)
    return e.select("page_number", "child_page_number", "payload_kind", _long("common_page_key_size"), _long("local_page_key_size"), _hex(F.col("space_key")).alias("space_key"), _hex(F.col("entry_data")).alias("entry_data"), "num_pages")


def leaf_space_entries(spark, sf):
    return _leaf_space(spark, sf, 4)


def leaf_space_entries_no_common(spark, sf):
    return _leaf_space(spark, sf, 5)


def _roots(spark, sf, long: bool, revision: int = 20) -> DataFrame:
    """A root for each row of nation, and as many more of its number and header, as other files have them, as its suppliers fill as entries; a NULL key isn't bytes."""
    first = F.concat(le("n_pages", 4), le(9, 1) if long else F.lit(b""), le("parent", 4), le(3, 4), le("tree", 4), *([F.unhex(F.lit("0102030405060708"))] if long else []))
    nations = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("n_pages"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") + 100).alias("tree"), (F.col("n_nationkey") + 1).cast("long").alias("page_number"))
    heads = nations.where("page_number IS NOT NULL").select("page_number", first.alias("first"))
    suppliers = _table(spark, sf, "supplier").where("s_suppkey IS NOT NULL").groupBy((F.col("s_nationkey") + 1).cast("long").alias("page_number"), F.floor(F.col("s_suppkey") / ROOT_KEYS)).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("o"), F.concat(le(8, 2), key8("s_suppkey"), le("s_suppkey", 4)).alias("p")))).alias("xs"))
    parts = F.transform(F.sequence(F.lit(1), F.size("xs"), F.lit(PER_ROOT)), lambda at: F.slice("xs", at, F.lit(PER_ROOT)))
    filled = suppliers.select("page_number", F.explode(parts).alias("xs")).select("page_number", F.transform("xs", lambda x: x["p"]).alias("ps"))
    filled = filled.join(F.broadcast(heads.groupBy("page_number").agg(F.min("first").alias("first"))), "page_number")  # once, however often a nation comes
    bare = heads.select("page_number", F.array().cast("array<binary>").alias("ps"), "first")
    payloads = F.concat(F.array(F.col("first")), F.col("ps"), F.array(F.unhex(F.lit("00000000"))))
    rows = bare.unionByName(filled).select("page_number", payloads.alias("payloads"))
    raw = settled(rows, "payloads").select("page_number", page("payloads", flags=0x1).alias("data"), F.lit(0x620).cast("long").alias("version"), F.lit(revision).cast("long").alias("revision"), F.lit(4096).cast("long").alias("page_size"))
    return tree_pages(decode_pages(settled(raw, "data")))


def _root_headers(rows: DataFrame) -> DataFrame:
    """What the pages of a number say: where they agree once, or as often as there are roots without entries."""
    said = rows.select("page_number", "kind", *(F.coalesce(F.col(f"root_header.{n}").cast("long"), F.lit(-1)).alias(n) for n in ("header_size", "number_of_pages", "parent_father_data_page", "extent_space", "space_tree_page_number")), F.coalesce("error", F.lit("-")).alias("error"), F.when(F.col("available_page_tag") == 2, 1).otherwise(0).alias("bare"))
    names = [c for c in said.columns if c != "bare"]
    times = said.groupBy(*names).agg(F.greatest(F.sum("bare"), F.lit(1)).cast("int").alias("n"))
    return times.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("n")).select(*names)


def root_header_16(spark, sf):
    return _root_headers(_roots(spark, sf, False))


def root_header_25(spark, sf):
    return _root_headers(_roots(spark, sf, True))


def root_header_25_old(spark, sf):
    return _root_headers(_roots(spark, sf, True, 17))


def root_entries(spark, sf):
    e = page_entries(_roots(spark, sf, False))
    return e.select("page_number", "kind", "entry_kind", _hex(F.col("page_key")).alias("page_key"), "child_page_number")


def root_leaf_entries(spark, sf):
    """Roots, half of them leaves as well, read as roots: a root header, and leaf or branch entries (every 5th is too short to be one)."""
    p = F.col("p_partkey")
    entry = F.concat(le(8, 2), key8("p_partkey"), le("p_size", 4), key8(p * 3))
    first = F.concat(le(p, 4), le(2, 4), le(3, 4), le(F.col("p_size"), 4))
    rows = _table(spark, sf, "part").select(p.alias("page_number"), F.when(p % 5 == 0, F.array(first, F.unhex(F.lit("00")))).otherwise(F.array(first, entry)).alias("payloads"))
    flags = F.when(F.col("page_number") % 2 == 0, F.lit(0x3)).otherwise(F.lit(0x1))
    raw = settled(rows, "payloads").select("page_number", page("payloads", flags=flags).alias("data"), F.lit(0x620).cast("long").alias("version"), F.lit(20).cast("long").alias("revision"), F.lit(4096).cast("long").alias("page_size"))
    roots = root_pages(decode_pages(settled(raw, "data")))
    e = page_entries(roots).select("page_number", "entry_kind", _hex(F.col("page_key")).alias("page_key"), "child_page_number", _hex(F.col("table_value")).alias("table_value"))
    heads = roots.select("page_number", F.col("root_header.number_of_pages").alias("number_of_pages"), F.coalesce("error", F.lit("-")).alias("error"))
    return heads.join(e, "page_number", "left").select("page_number", "number_of_pages", "error", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("entry_kind", "page_key", "table_value")), F.coalesce("child_page_number", F.lit(-1)).alias("child_page_number"))


def common_page_keys(spark, sf):
    """The first payload of branches and leaves; roots have none."""
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("page_number"), F.array(F.when(F.col("p_partkey") % 3 == 2, F.unhex(F.repeat(F.lit("01"), 16))).otherwise(F.concat(key8("p_partkey"), le("p_size", 3)))).alias("payloads"))
    flags = F.when(F.col("page_number") % 3 == 0, F.lit(0)).when(F.col("page_number") % 3 == 1, F.lit(0x2)).otherwise(F.lit(0x1))
    rows = settled(rows, "payloads").select("page_number", F.concat("payloads", F.array(F.unhex(F.lit("00000000")))).alias("payloads"))
    raw = settled(rows, "payloads").select("page_number", page("payloads", flags=flags).alias("data"), F.lit(0x620).cast("long").alias("version"), F.lit(20).cast("long").alias("revision"), F.lit(4096).cast("long").alias("page_size"))
    d = tree_pages(decode_pages(settled(raw, "data")))
    return d.select("page_number", F.coalesce("kind", F.lit("none")).alias("kind"), _hex(F.col("common_page_key")).alias("common_page_key"), F.coalesce("error", F.lit("-")).alias("error"))


def page_keys(spark, sf):
    p = F.col("p_partkey")
    tail = F.when(p % 3 == 0, le(p, 3)).when(p % 3 == 1, le(p, 4)).otherwise(le(p, 5))
    payload = F.concat(le(2, 1), le(3, 1), le(p % 65536, 2), le(F.col("p_size"), 3), tail)
    rows = _table(spark, sf, "part").select(p.alias("page_number"), F.array(F.unhex(F.lit("00")), payload).alias("payloads"))
    raw = settled(rows, "payloads").select("page_number", page("payloads").alias("data"), F.lit(0x620).cast("long").alias("version"), F.lit(20).cast("long").alias("revision"), F.lit(4096).cast("long").alias("page_size"))
    keys = nth_page_key(decode_pages(settled(raw, "data")), 0)
    return keys.select(F.col("page_number").alias("p_partkey"), _hex(F.col("key.suffix")).alias("suffix"), _hex(F.col("key.prefix")).alias("prefix"), F.col("key.page_number").alias("page_number"), F.coalesce("error", F.lit("-")).alias("error"))


def page_sweep(spark, sf):
    n = F.col("page_number")
    flags = F.when(n % 4 == 0, F.lit(8)).when(n % 4 == 1, F.lit(0x4000)).when(n % 4 == 2, F.lit(0)).otherwise(F.lit(0x40))
    d = tree_pages(sweep(branch_pages(spark, sf, flags=flags)))
    return d.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("pages"), F.sum(F.size("tags")).alias("tags"))


def sql_functions(spark, sf):
    register_functions(spark)
    rows = _table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 7).cast("long").alias("code"), log_time(F.col("c_custkey") % 60, F.lit(5), F.lit(6), F.col("c_custkey") % 33, F.lit(3), F.lit(90)).alias("raw"))
    return rows.selectExpr("c_custkey", "ese_page_offset(c_custkey, 8192L) AS page_offset", "ese_state(code) AS state", "array_join(ese_page_flags(c_custkey), ',') AS flags", "ese_filetime(raw) AS filetime", "ese_fingerprint(1568L, code) AS fingerprint")


QUERIES = {
    "logtime_filetime": logtime_filetime,
    "logtime_invalid": logtime_invalid,
    "header_decode": header_decode,
    "header_fingerprint": header_fingerprint,
    "header_state": header_state,
    "header_errors": header_errors,
    "page_offset": page_offsets,
    "page_header_decode": page_header_decode,
    "bulk_page_headers": bulk_page_headers,
    "page_header_high_bits": page_header_high_bits,
    "bulk_high_bits": bulk_high_bits,
    "page_checksum_variants": page_checksum_variants,
    "page_flag_predicates": page_flag_predicates,
    "page_flag_labels": page_flag_names,
    "page_valid": page_valid,
    "tag_decode_13bit": tag_decode_13bit,
    "tag_decode_15bit": tag_decode_15bit,
    "tag_directory": tag_directory,
    "tag_directory_truncated": tag_directory_truncated,
    "bulk_tags": bulk_tags,
    "tag_payload": tag_payloads,
    "page_dispatch": page_dispatch,
    "branch_entries": branch_entries,
    "branch_entries_malformed": branch_entries_malformed,
    "parse_issue": parse_issue,
    "page_edges": page_edges,
    "leaf_table_entries": leaf_table_entries,
    "leaf_index_entries": leaf_index_entries,
    "leaf_space_entries": leaf_space_entries,
    "leaf_space_entries_no_common": leaf_space_entries_no_common,
    "root_header_16": root_header_16,
    "root_header_25": root_header_25,
    "root_header_25_old": root_header_25_old,
    "root_entries": root_entries,
    "root_leaf_entries": root_leaf_entries,
    "common_page_keys": common_page_keys,
    "page_keys": page_keys,
    "page_sweep": page_sweep,
    "sql_functions": sql_functions,
}

_LINE_SQL = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey"
_HEX8 = "lpad(hex({0}), 16, '0')"
_NUMBERED = "SELECT *, o_orderkey // 40 + 1 AS page_number, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey) AS tag_number FROM orders"
_LEAF = "SELECT *, l_orderkey // 8 + 1 AS page_number FROM lineitem"
_BYTES = lambda x, n: "concat(" + ", ".join(f"lpad(hex(({x} >> {8 * i}) & 255), 2, '0')" for i in range(n)) + ")"
_BIT = lambda n: f"f & {PAGE_FLAGS[n]} > 0"
_FLAGGED = f"SELECT *, {_FLAG_SQL}::BIGINT AS f FROM lineitem"


_HIGH_SQL = """((18446744073709551616::HUGEINT - s_suppkey * 7919) % 18446744073709551616::HUGEINT)::VARCHAR AS last_modification_time, (4294967295 - s_suppkey)::VARCHAR AS previous_page_number, '4294967295' AS next_page_number, (s_suppkey + 2147483648)::VARCHAR AS father_data_page_id, '65535' AS available_data_size,
(s_suppkey % 100 + 65000)::VARCHAR AS available_uncommitted_data_size, '32768' AS available_data_offset, '1' AS available_page_tag, (4294967295 - s_suppkey)::VARCHAR AS page_flags"""


def _labels_sql(value: str) -> str:
    names = ("Root", "Leaf", "LongValue", "Empty", "Index", "Parent", "SpaceTree")
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {value} & {PAGE_FLAGS[n]} > 0 THEN '{n}' END" for n in names) + ")"


ORACLES = {
    "logtime_filetime": "SELECT event_id, (epoch(date_trunc('second', ts))::BIGINT + 11644473600) * 10000000 AS filetime FROM events",
    "logtime_invalid": """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
CASE WHEN error = '-' THEN (((date_diff('day', DATE '1601-01-01', make_date(2000, l_partkey % 13 + 1, 1)) + l_orderkey % 33) * 24 + l_suppkey % 25) * 3600 + l_partkey % 64 * 60 + l_orderkey % 64) * 10000000 END::BIGINT AS filetime, error
FROM (SELECT *, CASE WHEN l_orderkey % 64 >= 60 THEN 'second out of range' WHEN l_partkey % 64 >= 60 THEN 'minute out of range' WHEN l_suppkey % 25 >= 24 THEN 'hour out of range' WHEN l_orderkey % 33 >= 31 THEN 'day out of range' WHEN l_partkey % 13 >= 12 THEN 'month out of range' ELSE '-' END AS error FROM lineitem)""",
    "header_decode": _header_decode_sql(),
    "header_fingerprint": """SELECT c_custkey, v AS version, r AS file_format_revision, l AS fingerprint,
(CASE l WHEN 'NewSpaceManager' THEN 0 WHEN 'OriginalOperatingSystemBetaFormat' THEN 1 WHEN 'WindowsXPSP3' THEN 2 WHEN 'ExchangeWithEcc' THEN 3 WHEN 'WindowsVista' THEN 4 WHEN 'Windows7SP0' THEN 5 WHEN 'Exchange2013Ad2016' THEN 6 WHEN 'Windows11_21H2' THEN 7 WHEN 'Windows11' THEN 8 ELSE 9 END)::BIGINT AS fingerprint_code
FROM (SELECT *, CASE WHEN v = 1568 THEN CASE r WHEN 0 THEN 'OriginalOperatingSystemBetaFormat' WHEN 9 THEN 'WindowsXPSP3' WHEN 11 THEN 'ExchangeWithEcc' WHEN 12 THEN 'WindowsVista' WHEN 17 THEN 'Windows7SP0' WHEN 20 THEN 'Exchange2013Ad2016' WHEN 200 THEN 'Windows11_21H2' WHEN 230 THEN 'Windows11' ELSE 'Other' END WHEN v = 1571 AND r = 0 THEN 'NewSpaceManager' ELSE 'Other' END AS l
FROM (SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN 1571 WHEN c_custkey % 7 = 0 THEN 1538 ELSE 1568 END)::BIGINT AS v, ([0, 9, 11, 12, 17, 20, 200, 230, 5][c_custkey % 9 + 1])::BIGINT AS r FROM customer))""",
    "header_state": """SELECT c_custkey, s AS state, CASE s WHEN 1 THEN 'JustCreated' WHEN 2 THEN 'DirtyShutdown' WHEN 3 THEN 'CleanShutdown' WHEN 4 THEN 'BeingConverted' WHEN 5 THEN 'ForceDetach' ELSE 'Unknown' END AS state_label,
(CASE WHEN s BETWEEN 1 AND 5 THEN s ELSE 6 END)::BIGINT AS state_code FROM (SELECT c_custkey, (c_nationkey % 8)::BIGINT AS s FROM customer)""",
    "header_errors": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'header is short' WHEN 1 THEN 'detach_datetime: minute out of range' ELSE '-' END AS error, (CASE c_custkey % 3 WHEN 2 THEN 1568 ELSE -1 END)::BIGINT AS version FROM customer",
    "page_offset": "SELECT p_partkey, (p_partkey + 1) * 4096 AS page_offset FROM part",
    "page_header_decode": f"SELECT {_LINE_SQL}, l_suppkey, l_orderkey * 65536 AS checksum, 'Win7' AS kind, 40::BIGINT AS header_size, {_PAGE_HEADER_FIELDS} FROM lineitem",
    "bulk_page_headers": f"SELECT l_orderkey * 8 + l_linenumber AS page_number, {_PAGE_HEADER_FIELDS} FROM lineitem",
    "page_header_high_bits": f"SELECT s_suppkey AS page_number, ((18446744073709551616::HUGEINT - s_suppkey) % 18446744073709551616::HUGEINT)::VARCHAR AS checksum, {_HIGH_SQL} FROM supplier",
    "bulk_high_bits": f"SELECT s_suppkey AS page_number, {_HIGH_SQL} FROM supplier",
    "page_checksum_variants": """SELECT s_suppkey, revision::BIGINT AS revision, kind, (CASE WHEN kind = 'Win7' THEN s_suppkey * 4294967296 + s_nationkey ELSE -1 END)::BIGINT AS checksum,
(CASE WHEN kind = 'Exchange2003' THEN s_nationkey ELSE -1 END)::BIGINT AS xor, (CASE WHEN kind = 'Exchange2003' THEN 0 ELSE -1 END)::BIGINT AS page_number,
(CASE WHEN kind = 'WinVista' THEN s_nationkey ELSE -1 END)::BIGINT AS xor_checksum, (CASE WHEN kind = 'WinVista' THEN 0 ELSE -1 END)::BIGINT AS ecc_checksum,
kind = 'Win7' AS is_win7, kind = 'Exchange2003' AS is_exchange2003, kind = 'WinVista' AS is_winvista
FROM (SELECT *, CASE WHEN revision < 11 THEN 'Exchange2003' WHEN revision < 17 THEN 'WinVista' ELSE 'Win7' END AS kind FROM supplier, (SELECT unnest([9, 11, 16, 17, 20]) AS revision))""",
    "page_flag_predicates": f"SELECT {_LINE_SQL}, f & 227 = 0 AS is_branch, {', '.join(f'{_BIT(n)} AS is_{n.lower()}' for n in PAGE_FLAGS)} FROM ({_FLAGGED})",
    "page_flag_labels": f"SELECT {_LINE_SQL}, {_labels_sql('f')} AS flags FROM ({_FLAGGED})",
    "page_valid": f"SELECT {_LINE_SQL}, l_suppkey, f < 3407922 AND l_partkey % 128 <= 100 AND l_orderkey % 110 <= 100 AND l_linenumber * 20 <= 100 AND l_suppkey % 64 <= l_partkey % 128 AND f & 16384 = 0 AND f & 2097152 = 0 AS valid FROM ({_FLAGGED})",
    "tag_decode_13bit": _tag_sql(13),
    "tag_decode_15bit": _tag_sql(15),
    "tag_directory": f"SELECT page_number, tag_number, (2 + (tag_number - 1) * 14)::BIGINT AS value_offset, 1::BIGINT AS tag_flags, 14::BIGINT AS value_size FROM ({_NUMBERED}) UNION ALL SELECT DISTINCT page_number, 0, 0, 1, 2 FROM ({_NUMBERED})",
    "tag_directory_truncated": f"SELECT page_number, least(count(*) + 1, page_number % 7 + 3)::BIGINT AS n_tags FROM ({_NUMBERED}) GROUP BY page_number",
    "bulk_tags": f"SELECT page_number, n AS n_tags, (2 * (n - 1) + 14 * ((n - 1) * (n - 2) // 2))::BIGINT AS offsets, (2 + 14 * (n - 1))::BIGINT AS sizes, n AS marks FROM (SELECT page_number, least(count(*) + 1, page_number % 7 + 3)::BIGINT AS n FROM ({_NUMBERED}) GROUP BY page_number)",
    "tag_payload": f"SELECT page_number, tag_number, concat('0800', {_HEX8.format('o_orderkey')}, {_BYTES('o_custkey', 4)}) AS payload, '-' AS error FROM ({_NUMBERED}) UNION ALL SELECT DISTINCT page_number, 0, 'AABB', '-' FROM ({_NUMBERED})",
    "page_dispatch": f"SELECT {_LINE_SQL}, CASE WHEN f & 227 = 0 THEN 'Branch' WHEN f & 2 > 0 THEN 'Leaf' WHEN f & 1 > 0 THEN 'Root' ELSE 'none' END AS kind FROM ({_FLAGGED})",
    "branch_entries": f"SELECT page_number, tag_number, 8::BIGINT AS page_key_size, {_HEX8.format('o_orderkey')} AS page_key, o_custkey AS child_page_number, 'Branch' AS entry_kind FROM ({_NUMBERED})",
    "branch_entries_malformed": f"SELECT page_number, tag_number, {_HEX8.format('o_orderkey')} AS page_key, o_custkey AS child_page_number FROM ({_NUMBERED}) WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0",
    "parse_issue": f"SELECT page_number, tag_number, CASE WHEN o_orderkey % 5 = 0 THEN 'entry is under 6 bytes' ELSE 'entry is shorter than its key says' END AS error FROM ({_NUMBERED}) WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0",
    "page_edges": f"""WITH p AS (SELECT DISTINCT page_number FROM ({_NUMBERED})) SELECT 'child' AS edge_kind, count(*) AS n, sum(page_number)::BIGINT AS src, sum(o_custkey)::BIGINT AS dst FROM ({_NUMBERED})
UNION ALL SELECT 'next', count(*), sum(page_number)::BIGINT, sum(page_number + 1)::BIGINT FROM p UNION ALL SELECT 'previous', count(*), sum(page_number)::BIGINT, sum(page_number - 1)::BIGINT FROM p WHERE page_number > 1""",
    "leaf_table_entries": f"SELECT page_number, {_HEX8.format('l_orderkey')} AS page_key, l_partkey AS child_page_number, 'TableValue' AS payload_kind, {_HEX8.format('l_suppkey')} AS table_value FROM ({_LEAF})",
    "leaf_index_entries": f"SELECT page_number, {_HEX8.format('l_orderkey')} AS page_key, l_partkey AS child_page_number, 'Index' AS payload_kind, {_HEX8.format('l_suppkey')} AS record_page_key FROM ({_LEAF})",
    "leaf_space_entries": f"SELECT page_number, l_partkey AS child_page_number, 'SpaceTree' AS payload_kind, 7::BIGINT AS common_page_key_size, 3::BIGINT AS local_page_key_size, {_BYTES('l_suppkey', 3)} AS space_key, '4D00' AS entry_data, l_linenumber::BIGINT AS num_pages FROM ({_LEAF})",
    "root_header_16": "SELECT n_nationkey::BIGINT + 1 AS page_number, 'Root' AS kind, 16::BIGINT AS header_size, n_nationkey::BIGINT AS number_of_pages, n_regionkey::BIGINT AS parent_father_data_page, 3::BIGINT AS extent_space, n_nationkey::BIGINT + 100 AS space_tree_page_number, '-' AS error FROM nation",
    "root_header_25_old": "SELECT n_nationkey::BIGINT + 1 AS page_number, 'Root' AS kind, -1::BIGINT AS header_size, -1::BIGINT AS number_of_pages, -1::BIGINT AS parent_father_data_page, -1::BIGINT AS extent_space, -1::BIGINT AS space_tree_page_number, 'root header of 25 bytes' AS error FROM nation",
    "root_entries": f"SELECT s_nationkey::BIGINT + 1 AS page_number, 'Root' AS kind, 'Branch' AS entry_kind, {_HEX8.format('s_suppkey')} AS page_key, s_suppkey AS child_page_number FROM supplier",
    "root_leaf_entries": f"""SELECT p_partkey AS page_number, p_partkey AS number_of_pages, '-' AS error, CASE WHEN p_partkey % 5 = 0 THEN '-' WHEN p_partkey % 2 = 0 THEN 'Leaf' ELSE 'Branch' END AS entry_kind, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE {_HEX8.format('p_partkey')} END AS page_key,
CASE WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 1 THEN '-' ELSE {_HEX8.format('(p_partkey * 3)')} END AS table_value, (CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END)::BIGINT AS child_page_number FROM part""",
    "common_page_keys": f"""SELECT p_partkey AS page_number, CASE p_partkey % 3 WHEN 0 THEN 'Branch' WHEN 1 THEN 'Leaf' ELSE 'Root' END AS kind,
CASE WHEN p_partkey % 3 = 2 THEN '-' ELSE concat({_HEX8.format('p_partkey')}, {_BYTES('p_size', 3)}) END AS common_page_key, '-' AS error FROM part""",
    "page_keys": f"SELECT p_partkey, {_BYTES('(p_partkey % 65536)', 2)} AS suffix, {_BYTES('p_size', 3)} AS prefix, CASE WHEN p_partkey % 3 = 1 THEN p_partkey ELSE 0 END AS page_number, '-' AS error FROM part",
    "page_sweep": f"SELECT CASE WHEN page_number % 4 = 2 THEN 'Branch' ELSE 'none' END AS kind, count(*) AS pages, sum(n + 1)::BIGINT AS tags FROM (SELECT page_number, count(*) AS n FROM ({_NUMBERED}) GROUP BY page_number) WHERE page_number % 4 IN (2, 3) GROUP BY 1",
    "sql_functions": f"""SELECT c_custkey, (c_custkey + 1) * 8192 AS page_offset, CASE s WHEN 1 THEN 'JustCreated' WHEN 2 THEN 'DirtyShutdown' WHEN 3 THEN 'CleanShutdown' WHEN 4 THEN 'BeingConverted' WHEN 5 THEN 'ForceDetach' ELSE 'Unknown' END AS state, {_labels_sql('c_custkey')} AS flags,
CASE WHEN c_custkey % 33 < 31 THEN (((date_diff('day', DATE '1601-01-01', DATE '1990-04-01') + c_custkey % 33) * 24 + 6) * 3600 + 5 * 60 + c_custkey % 60) * 10000000 END::BIGINT AS filetime,
CASE s WHEN 0 THEN 'OriginalOperatingSystemBetaFormat' ELSE 'Other' END AS fingerprint FROM (SELECT *, c_nationkey % 7 AS s FROM customer)""",
}
ORACLES["leaf_space_entries_no_common"] = ORACLES["leaf_space_entries"].replace("7::BIGINT AS common", "0::BIGINT AS common")
ORACLES["root_header_25"] = ORACLES["root_header_16"].replace("16::BIGINT", "25::BIGINT")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Which child pages does each page refer to, by which key?"""
    return branch_entries(spark, sf)
