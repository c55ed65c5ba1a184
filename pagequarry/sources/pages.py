"""Scans of database files: headers, page ranges through a data source of our own, and whole files.

``ese_pages`` cuts files into ranges of ``bytes_per_partition`` by their listed sizes alone; each task reads the
headers of its own files and the pages that begin in its range, so the driver opens no file and none is
held whole. With ``pages_per_partition`` the driver reads the headers instead, and leaves out ranges that a filter
on page_number excludes: for a few large files. Other options: path (a file, or a folder),
start_page. ``binary_pages`` does the same from binaryFile rows, for small files.

A file whose header is short, or names no page size, is one row without page_number; a page that the file's
end cuts is a row with what there is of it. decode_pages gives both their error. (Spark's binaryFile lists no empty files.)
"""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.binary import u32
from ..operators.header import SIZE

SCHEMA = "path string, page_number bigint, version bigint, revision bigint, page_size bigint, data binary"
BATCH_BYTES, PARTITION_BYTES, FILES = 1 << 22, 1 << 26, 256


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def read_head(file) -> tuple[bytes, int, int, int]:
    """(header, version, revision, page size), the numbers 0 where the header is short."""
    head = file.read(SIZE)
    return (head, *(struct.unpack_from("<I", head, at)[0] for at in (8, 232, 236))) if len(head) == SIZE else (head, 0, 0, 0)


class PageRange(InputPartition):
    """Pieces of files: (path, first byte, byte behind the last)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("bytes_per_partition", PARTITION_BYTES))
        self.per = int(options.get("pages_per_partition", 0))
        self.low, self.high, self.bounded = max(0, int(options.get("start_page", 1))), 2**62, False

    def files(self) -> list[tuple[str, int]]:
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pyarrow.fs.FileType.File:
            return [(self.path, info.size)]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return [(self.path.rstrip("/") + f.path[len(root.rstrip("/")) :], f.size) for f in found if f.is_file]

    def partitions(self) -> list[PageRange]:
        if self.per:
            return [PageRange([p]) for p in self.by_pages()] or [PageRange([])]
        out, now, held = [], [], 0
        for path, size in self.files():
            for first in range(0, max(size, 1), self.bytes):
                piece = (path, first, min(first + self.bytes, max(size, 1)))
                if now and held + piece[2] - first > self.bytes:
                    out.append(PageRange(now))
                    now, held = [], 0
                now.append(piece)
                held += piece[2] - first
        return [*out, PageRange(now)]

    def by_pages(self):
        for path, size in self.files():
            fs, at = open_fs(path)
            with fs.open_input_stream(at) as f:
                page_size = read_head(f)[3]
            if not page_size:
                yield path, 0, 1
                continue
            last = min(self.high, -(-size // page_size) - 2)
            for first in range(self.low, last + 1, self.per):
                yield path, (first + 1) * page_size, (min(last, first + self.per - 1) + 2) * page_size

    def read(self, partition: PageRange):
        for path, start, end in partition.pieces:
            yield from self.piece(path, start, end)

    def piece(self, path: str, start: int, end: int):
        fs, at = open_fs(path)
        with fs.open_input_file(at) as f:
            head, version, revision, size = read_head(f)
            if not size:
                if start == 0 and not self.bounded:
                    yield _rows(path, [None], *([n if len(head) == SIZE else None] for n in (version, revision, size)), [head])
                return
            first = max(self.low, -(-start // size) - 1)
            last = min(self.high, -(-min(end, f.size()) // size) - 2)
            step = max(1, BATCH_BYTES // size)
            for first_now in range(first, last + 1, step):
                numbers = list(range(first_now, min(last, first_now + step - 1) + 1))
                f.seek((first_now + 1) * size)
                raw = f.read(len(numbers) * size)
                n = len(numbers)
                yield _rows(path, numbers, [version] * n, [revision] * n, [size] * n, [raw[i * size : (i + 1) * size] for i in range(n)])


def _rows(path: str, numbers: list, versions: list, revisions: list, sizes: list, data: list) -> pa.RecordBatch:
    longs = (pa.array(c, pa.int64()) for c in (numbers, versions, revisions, sizes))
    return pa.RecordBatch.from_arrays([pa.array([path] * len(data)), *longs, pa.array(data, pa.binary())], names=[x.split()[0] for x in SCHEMA.split(", ")])


class PruningPageReader(PageReader):
    """Takes bounds on page_number; needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("page_number",) or not isinstance(value, int):
                yield f
                continue
            if isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value)
            else:
                yield f
                continue
            self.bounded = True  # rows without page_number don't meet a bound


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ese_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PruningPageSource(PageSource):
    def reader(self, schema) -> DataSourceReader:
        return PruningPageReader(self.options)


class HeaderReader(PageReader):
    def partitions(self) -> list[PageRange]:
        found = [(path, 0, 0) for path, _ in self.files()]
        return [PageRange(found[at : at + FILES]) for at in range(0, max(len(found), 1), FILES)]

    def piece(self, path: str, start: int, end: int):
        fs, at = open_fs(path)
        with fs.open_input_stream(at) as f:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read(SIZE)], pa.binary())], names=["path", "content"])


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ese_headers"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    pruning = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(PruningPageSource if pruning else PageSource)
    return spark.read.format("ese_pages").options(path=path, **options).load()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, content: the first 668 bytes of each file, FILES files to a task."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("ese_headers").option("path", path).load()


def binary_pages(files: DataFrame, start_page: int = 1) -> DataFrame:
    """The rows of SCHEMA from path, content."""
    length, size = F.octet_length("content"), u32("content", 236)
    whole = length >= SIZE
    rows = files.select("path", "content", *(F.when(whole, c).alias(n) for c, n in ((u32("content", 8), "version"), (u32("content", 232), "revision"), (size, "page_size"))))
    last = (F.ceil(length / F.col("page_size")) - 2).cast("long")
    numbers = F.when(F.coalesce(F.col("page_size"), F.lit(0)) <= 0, F.array(F.lit(None).cast("long"))).when(last >= start_page, F.sequence(F.lit(start_page).cast("long"), last))
    rows = rows.select("*", F.explode(numbers).alias("page_number"))
    data = F.substring("content", ((F.col("page_number") + 1) * F.col("page_size") + 1).cast("int"), F.col("page_size").cast("int"))
    data = F.when(F.col("page_number").isNull(), F.substring("content", 1, SIZE)).otherwise(data)
    return rows.select("path", "page_number", "version", "revision", "page_size", data.alias("data"))


def write_debug(rows: DataFrame, name: str, path: str) -> None:
    """Blocks of a title and a row as JSON, as text."""
    text = F.concat(F.lit(f"----{name}----\n"), F.to_json(F.struct(*rows.columns)))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
