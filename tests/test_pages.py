"""Literal vectors, malformed input, and the queries against SQL at the smallest scale."""

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.functions.instants import filetime, log_time_error
from pagequarry.operators.entries import nth_page_key, page_entries, parse_issues, reachable, root_header, tree_pages
from pagequarry.operators.header import decode_headers
from pagequarry.operators.page import decode_pages, tag
from pagequarry.plans import queries as Q
from pagequarry.plans.sql import register_views
from pagequarry.sources.pages import binary_pages, read_files, read_pages, write_debug
from pagequarry.streaming import stream_pages

SF = "/root/testdata/sf0.001"


def page_bytes(payloads, flags=0, size=4096, tag_flags=0, count=None):
    body, slots, at = b"", b"", 0
    for p in payloads:
        slots = struct.pack("<HH", len(p), at | tag_flags << 13) + slots
        body += p
        at += len(p)
    n = len(payloads) if count is None else count
    head = struct.pack("<QQIIIHHHHI", 1, 2, 3, 4, 5, 0, 0, 0, n, flags)
    return head + body + bytes(size - 40 - len(body) - len(slots)) + slots


def decoded(spark, *pages, revision=20, version=0x620, size=4096):
    rows = [(i + 1, bytearray(p), version, revision, size) for i, p in enumerate(pages)]
    return decode_pages(spark.createDataFrame(rows, "page_number long, data binary, version long, revision long, page_size long"))


def test_log_time(spark):
    rows = spark.createDataFrame([(bytearray(8),), (bytearray(b"\x3c" + bytes(7)),), (bytearray([0, 60, 0, 0, 0, 0, 0, 0]),), (bytearray(7),)], "b binary")
    got = rows.select(filetime("b"), log_time_error("b")).collect()
    assert [tuple(r) for r in got] == [(94354848000000000, None), (None, "second out of range"), (None, "minute out of range"), (None, "log time is short")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [((36, 0, 175, 32), (0xAF, 1, 36)), ((30, 0, 111, 32), (0x6F, 1, 30)), ((30, 0, 16, 0), (0x10, 0, 30)), ((36, 0, 46, 32), (0x2E, 1, 36)), ((29, 0, 82, 32), (0x52, 1, 29)), ((27, 0, 211, 32), (0xD3, 1, 27)), ((34, 0, 141, 32), (0x8D, 1, 34))],
)
def test_tag_vectors(spark, raw, want):
    row = spark.createDataFrame([(bytearray(raw),)], "b binary").select(tag(F.col("b"), F.lit(20), F.lit(4096)).alias("t")).first()["t"]
    assert (row["value_offset"], row["tag_flags"], row["value_size"]) == want


def test_header_values(spark):
    image = bytearray(668)
    for offset, value in ((0, 0x10009A53), (8, 0x620), (52, 3), (104, 1), (212, 13), (232, 20), (236, 4096)):
        struct.pack_into("<I", image, offset, value)
    r = decode_headers(spark.createDataFrame([(image,)], "content binary")).first()
    assert (r.checksum, r.fingerprint, r.state_label, r.last_object_id, r.dbid, r.shadowing_disabled, r.page_size, r.error) == (0x10009A53, "Exchange2013Ad2016", "CleanShutdown", 13, 1, 0, 4096, None)
    short = decode_headers(spark.createDataFrame([(image[:-1],)], "content binary")).first()
    assert short.error == "header is short" and short.version is None
    with pytest.raises(Exception, match="header is short"):
        decode_headers(spark.createDataFrame([(image[:-1],)], "content binary"), mode="FAILFAST").collect()


def test_page_headers(spark):
    one = struct.pack("<QQIIIHHHHI", 0x7FDF7FDF0001A77C, 0, 0, 0, 1, 4036, 0, 0, 1, 0xA803) + bytes(4056)
    two = struct.pack("<QQIIIHHHHI", 0x0192019200EC59D4, 0, 0, 0, 1, 4022, 0, 0, 2, 0xA823) + bytes(4056)
    a, b, c = decoded(spark, one, two, one[:-1]).orderBy("page_number").collect()
    assert (int(a.checksum.checksum), a.available_data_size, a.available_page_tag, a.tags, a.flags) == (0x7FDF7FDF0001A77C, 4036, 1, [], ["Root", "Leaf"])
    assert (int(b.checksum.checksum), len(b.tags), b.flags) == (0x0192019200EC59D4, 2, ["Root", "Leaf", "SpaceTree"])
    assert c.error and c.page_flags is None
    assert decoded(spark, bytes(16000), version=0x602, size=16000).first().error == "extended header is out of reach"


def test_entries_and_issues(spark):
    good = struct.pack("<H", 2) + b"ab" + struct.pack("<I", 7)
    pages = tree_pages(decoded(spark, page_bytes([b"k", good, b"\x09\x00abcdef", b"12345"]), page_bytes([b"k"]), page_bytes([b"k", good], flags=0x40)))
    got = page_entries(pages).collect()
    assert [(r.page_number, bytes(r.page_key), r.child_page_number) for r in got] == [(1, b"ab", 7)]
    issues = {(r.page_number, r.tag_number): r.error for r in parse_issues(pages).collect()}
    assert issues == {(1, 2): "entry is shorter than its key says", (1, 3): "entry is under 6 bytes", (2, None): "no such tag", (3, None): "no such page kind"}


@pytest.mark.parametrize(("size", "revision", "fails"), [(15, 20, True), (16, 20, False), (17, 20, True), (24, 20, True), (25, 20, False), (25, 17, True)])
def test_root_header_sizes(spark, size, revision, fails):
    row = spark.createDataFrame([(bytearray(range(size)), revision)], "b binary, r int").select(*root_header(F.col("b"), F.col("r"))).first()
    assert (row[1] is not None) == fails and (row[0] is None) == fails


@pytest.mark.parametrize(("rest", "number"), [(b"", 0), (b"\1\0\0", 0), (b"\1\0\0\0", 1), (b"\1\0\0\0\0", 0)])
def test_page_key(spark, rest, number):
    row = nth_page_key(decoded(spark, page_bytes([b"k", b"\x01\x02abc" + rest])), 0).first()
    assert (bytes(row.key.suffix), bytes(row.key.prefix), row.key.page_number) == (b"a", b"bc", number)


def test_views_over_files(spark, tmp_path):
    image = bytearray(4096)
    for offset, value in ((8, 0x620), (52, 3), (232, 20), (236, 4096)):
        struct.pack_into("<I", image, offset, value)
    leaf = page_bytes([b"k", struct.pack("<H", 1) + b"x" + struct.pack("<I", 3)])
    (tmp_path / "a.edb").write_bytes(bytes(image) * 2 + leaf * 5)
    register_views(spark, str(tmp_path), pages_per_partition=2)
    assert spark.sql("SELECT state_label FROM db_header").first()[0] == "CleanShutdown"
    assert [r[0] for r in spark.sql("SELECT page_number FROM page ORDER BY 1").collect()] == [1, 2, 3, 4, 5]
    assert spark.sql("SELECT count(*), sum(child_page_number) FROM page_entry").first()[:] == (5, 15)
    assert spark.sql("SELECT count(*) FROM page_tag").first()[0] == 10
    assert spark.sql("SELECT count(*) FROM parse_issue").first()[0] == 0


def test_short_files_and_cut_pages(spark, tmp_path):
    """A file of under a header, one that names no page size, and one that ends within a page: rows with an error."""
    image = bytearray(4096)
    for offset, value in ((8, 0x620), (52, 3), (232, 20), (236, 4096)):
        struct.pack_into("<I", image, offset, value)
    (tmp_path / "cut.edb").write_bytes(bytes(image) * 2 + bytes(4096) + bytes(100))
    (tmp_path / "short.edb").write_bytes(b"abc")
    (tmp_path / "zero.edb").write_bytes(bytes(700))
    (tmp_path / "empty.edb").write_bytes(b"")
    want = [(None, 0, "header is short"), (None, 3, "header is short"), (None, 668, "page data has another size than a page"), (1, 4096, None), (2, 100, "page data has another size than a page")]
    look = lambda pages: sorted(((r.page_number, len(r.data), r.error) for r in decode_pages(pages).collect()), key=str)
    for options in ({}, {"pages_per_partition": 1}, {"bytes_per_partition": 3000}):
        assert look(read_pages(spark, str(tmp_path), **options)) == sorted(want, key=str)
    assert look(binary_pages(read_files(spark, str(tmp_path)))) == sorted(want[1:], key=str)  # binaryFile lists no empty files
    register_views(spark, str(tmp_path))
    assert sorted(r[0] or "" for r in spark.sql("SELECT error FROM db_header").collect()) == ["", "", "header is short", "header is short"]
    with pytest.raises(Exception, match="another size|header is short"):
        decode_pages(read_pages(spark, str(tmp_path)), "FAILFAST").collect()


def test_reachable(spark):
    e = spark.createDataFrame([(1, 2, "child"), (2, 3, "child"), (3, 1, "child"), (9, 8, "child")], "src_page long, dst_page long, edge_kind string")
    got = reachable(e, spark.createDataFrame([(1,)], "page long")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 1), (3, 2)]
    line = spark.range(70).selectExpr("id AS src_page", "id + 1 AS dst_page", "'child' AS edge_kind")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert reachable(line, spark.createDataFrame([(0,)], "page long")).agg(F.max("depth")).first()[0] == 70
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=key)
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({Q.ORACLES[name]})").fetchall(), key=key)
    assert got == want


@pytest.mark.parametrize("name", ["root_entries", "root_header_16", "root_header_25", "root_header_25_old"])
def test_roots_of_many_suppliers(spark, tmp_path, name):
    """More suppliers than a page holds, in one nation and in one range of keys; a nation without any; a key that comes twice."""
    con = duckdb.connect()
    con.sql("CREATE TABLE nation AS SELECT i AS n_nationkey, i % 2 AS n_regionkey FROM range(3) t(i)")
    con.sql("CREATE TABLE supplier AS SELECT i AS s_suppkey, (i % 10 // 9)::BIGINT AS s_nationkey FROM (SELECT unnest(range(5000)) AS i UNION ALL SELECT 7)")
    for t in ("nation", "supplier"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = Q.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["root_header_16", "root_header_25", "root_header_25_old"])
def test_root_headers_of_odd_rows(spark, tmp_path, name):
    """A nation that comes twice, one of two regions, one without suppliers; more suppliers than a page holds, and one without a key."""
    con = duckdb.connect()
    con.sql("CREATE TABLE nation AS SELECT * FROM (VALUES (0, 1), (0, 1), (1, 1), (1, 2), (2, 1)) t(n_nationkey, n_regionkey)")
    con.sql("CREATE TABLE supplier AS SELECT i AS s_suppkey, i % 2 AS s_nationkey FROM range(1000) t(i) UNION ALL SELECT NULL, 1")
    for t in ("nation", "supplier"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = Q.QUERIES[name](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall(), key=str)


def three_pages(folder):
    image = bytearray(4096)
    for offset, value in ((8, 0x620), (232, 20), (236, 4096)):
        struct.pack_into("<I", image, offset, value)
    folder.mkdir()
    (folder / "a.edb").write_bytes(bytes(image) * 2 + bytes(4096) * 3)
    return str(folder)


def test_stream(spark, tmp_path):
    query = stream_pages(spark, three_pages(tmp_path / "in")).select("page_number", "valid").writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(1, True), (2, True), (3, True)]


def test_pushdown_and_debug_text(spark, tmp_path):
    path = three_pages(tmp_path / "in")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read_pages(spark, path, pages_per_partition=1).where("page_number = 2")
        assert rows.count() == 1 and rows.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert read_pages(spark, path, pages_per_partition=1).rdd.getNumPartitions() == 3
    assert read_pages(spark, path, bytes_per_partition=4096).rdd.getNumPartitions() == 5
    assert sorted(r.page_number for r in read_pages(spark, path, bytes_per_partition=4096).collect()) == [1, 2, 3]
    whole = binary_pages(read_files(spark, path))
    assert sorted(map(tuple, whole.select("page_number", "page_size").collect())) == [(1, 4096), (2, 4096), (3, 4096)]
    write_debug(rows.select("page_number"), "page", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text"), wholetext=True).where("value <> ''").first()[0] == '----page----\n{"page_number":2}\n'
