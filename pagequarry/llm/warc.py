"""WARC archives through a chunked record table.

A payload becomes rows of (digest, chunk number, bytes) in the task that reads it, before anything is
shuffled; a task sends each chunk once, whatever the number of its copies. Chunks meet by digest behind a
head row, sorted, and go to the archive one after the other; they are read back from it the same way,
each with the SHA-1 and the length of the payload up to it. Shuffle, writer and reader hold chunks,
never a record. Each record is a gzip member of its own; archives roll over at ARCHIVE_BYTES.

Of records with equal payloads of at least ``min_bytes`` that with the largest identifier is the
response, and the others are revisits that refer to it. Who is which is decided on slim rows without payloads,
which are written first; the response of each digest is a table of its own, so the join that makes the revisits
may be split where a third of all pages share a payload, and revisits are written where they are made.
Payloads under ``min_bytes`` are short by definition and stay with their slim row.

Archives go to the shared folder, named by attempt; the manifest lists those of the attempts that
ended well, so a lost executor leaves at most a file that nothing reads.

Defined cases: null html is an empty payload; null identifiers are less than all others and come
back as null; rows equal in identifier, url and payload are one response and revisits that refer to
the same identifier; an empty table gives an empty one; other columns are ignored. The pages are read
twice (payloads, slim rows); if they differ the second time the writer fails.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, shuffle_partitions
from .grams import lean, slices

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 18
#: Chunks that a task remembers having sent, and rows of chunks that a worker takes at a time.
SENT, ROWS = 1 << 17, 16
DATE = "2000-01-01T00:00:00Z"
#: The manifest's rows: an archive each.
MANIFEST = "path string, bytes long, records long"
READ = "record_id string, record_type string, page_id long, url string, refers_to long, chunk_no int, last boolean, data binary, payload_bytes long, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _body(payload: str) -> Column:
    return F.coalesce(F.col(payload).cast("binary"), F.lit(b""))


def slim_rows(pages: DataFrame, identifier: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, digest (hex SHA-1), n_bytes, own (the payload if it is under min_bytes), row (a number of its own); written."""
    size = F.octet_length(_body(payload)).cast("long")
    own = F.when(size < min_bytes, _body(payload)) if min_bytes else F.lit(None).cast("binary")
    rows = pages.select(F.col(identifier).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(_body(payload)).alias("digest"), size.alias("n_bytes"), own.alias("own"), F.monotonically_increasing_id().alias("row"))
    return materialise(rows, "warc-rows")


def chunked(pages: DataFrame, payload: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of payloads of at least min_bytes: digest, chunk_no, data. Copies that one task reads are one."""
    rows = pages.select(_body(payload).alias("payload")).where(F.octet_length("payload") >= min_bytes).select("payload", F.sha1("payload").alias("digest"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_bytes)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.select("digest", F.posexplode(parts).alias("chunk_no", "data"))

    def once(batches):
        sent: set[tuple] = set()
        for b in slices(batches, 1024):
            fresh = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fresh.append(key not in sent)
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(key)
            yield b.filter(pa.array(fresh, pa.bool_()))

    return rows.mapInArrow(lean(once), "digest string, chunk_no int, data binary")


def _identity(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:pagequarry:{'null' if page_id is None else page_id}:{digest}:{row}>"


def _page(identity: str | None) -> int | None:
    part = identity.split(":")[2] if identity else "null"
    return None if part == "null" else int(part)


class _Archive:
    """One archive being written; a gzip member for each record."""

    def __init__(self, folder: str):
        self.fs, root = open_fs(folder)
        self.path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        self.uri = f"{folder}/{self.path.rpartition('/')[2]}"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.path), 0, 0

    def begin(self) -> None:
        self.deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.records += 1

    def put(self, data: bytes) -> None:
        self._out(self.deflate.compress(data))

    def end(self) -> None:
        self._out(self.deflate.compress(b"\r\n\r\n") + self.deflate.flush())

    def _out(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.bytes, self.records


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def head(row: dict) -> bytes:
    """Everything of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    length = len(http) + (row["n_bytes"] if row["response"] else 0)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if row['response'] else 'revisit'}", f"WARC-Record-ID: {_identity(row['page_id'], row['digest'], row['row'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {row['url'].replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['digest']))}")
    if not row["response"]:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_identity(row['refers_to'], row['digest'], row['refers_row'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Writer:
    """Rows of records, one after the other: a head row, then the chunks in order; a chunk may come more than once."""

    def __init__(self, folder: str, archive_bytes: int):
        self.folder, self.most, self.archive, self.row = folder, archive_bytes, None, None

    def put(self, row: dict) -> list[tuple]:
        """Returns the archives that are full."""
        full = []
        if row["chunk_no"] < 0:
            full = self.end()
            self.archive = self.archive or _Archive(self.folder)
            self.row, self.sha, self.size, self.next = row, hashlib.sha1(), 0, 0
            self.archive.begin()
            self.archive.put(head(row))
        elif self.row is None or row["digest"] != self.row["digest"] or row["chunk_no"] > self.next:
            raise ValueError(f"the pages have changed: a chunk of {row['digest']} has no record")
        if row["data"] is not None and row["chunk_no"] in (-1, self.next):
            self.archive.put(row["data"])
            self.sha.update(row["data"])
            self.size += len(row["data"])
            self.next += row["chunk_no"] >= 0
        return full

    def end(self) -> list[tuple]:
        row, self.row = self.row, None
        if row:
            self.archive.end()
            if row["response"] and (self.size, self.sha.hexdigest()) != (row["n_bytes"], row["digest"]):
                raise ValueError(f"the pages have changed: the chunks of {row['page_id']} are not its payload")
            if self.archive.bytes >= self.most:
                return self.close()
        return []

    def close(self) -> list[tuple]:
        archive, self.archive = self.archive, None
        return [archive.close()] if archive else []


def write_warc(pages: DataFrame, folder: str, identifier: str = "page_id", payload: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return their manifest (a table in the shared folder)."""
    spark = pages.sparkSession
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    slim = slim_rows(pages, identifier, payload, min_bytes)
    shared = slim.where("own IS NULL").select("page_id", "url", "digest", "n_bytes", "row")
    tops = materialise(shared.groupBy("digest").agg(F.max(F.struct("page_id", "url", "row")).alias("top"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n")), "warc-responses")
    none = lambda kind: F.lit(None).cast(kind)

    def rows(df: DataFrame, **known: Column) -> DataFrame:
        kinds = {"digest": "string", "chunk_no": "int", "data": "binary", "page_id": "long", "url": "string", "row": "long", "n_bytes": "long", "response": "boolean", "refers_to": "long", "refers_row": "long"}
        return df.select(*(known.get(c, none(kind)).cast(kind).alias(c) for c, kind in kinds.items()))

    def write(batches):
        writer = _Writer(folder, archive_bytes)
        for b in slices(batches, ROWS):
            for row in b.to_pylist():
                yield from manifest(writer.put(row))
        yield from manifest(writer.end())
        yield from manifest(writer.close())

    def manifest(full):
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*full, strict=True)], names=["path", "bytes", "records"])

    c = F.col
    heads = rows(tops, digest=c("digest"), chunk_no=F.lit(-1), page_id=c("top.page_id"), url=c("top.url"), row=c("top.row"), n_bytes=c("n_bytes"), response=F.lit(True))
    chunks = rows(chunked(pages, payload, min_bytes, chunk_bytes), digest=c("digest"), chunk_no=c("chunk_no"), data=c("data"))
    # a digest has a head and as many rows of a chunk as tasks have read it
    responses = heads.unionByName(chunks).repartition(shuffle_partitions(spark), "digest").sortWithinPartitions("digest", "chunk_no")
    again = shared.join(tops.where("n > 1").select("digest", "top"), "digest").where("row <> top.row")
    own = dict(digest=c("digest"), chunk_no=F.lit(-1), page_id=c("page_id"), url=c("url"), row=c("row"), n_bytes=c("n_bytes"))
    revisits = rows(again, **own, response=F.lit(False), refers_to=c("top.page_id"), refers_row=c("top.row"))
    out = responses.mapInArrow(lean(write), MANIFEST).unionByName(revisits.mapInArrow(lean(write), MANIFEST))
    if min_bytes:
        out = out.unionByName(rows(slim.where("own IS NOT NULL"), **own, data=c("own"), response=F.lit(True)).mapInArrow(lean(write), MANIFEST))
    return materialise(out, "warc-manifest")


class Stream:
    """The bytes of an archive, gzip members or plain, read by lines and pieces of bounded size."""

    def __init__(self, file):
        self.file, self.buffer, self.inflate, self.raw, self.plain, self.ended = file, b"", None, b"", None, False

    def _more(self) -> bool:
        while not self.ended:
            if not self.raw:
                self.raw = self.file.read(READ_BYTES)
                if not self.raw:
                    self.ended = True
                    if self.inflate is not None and not self.inflate.eof:
                        raise ValueError("the archive ends within a member")
                    return False
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                got, self.raw = self.raw, b""
            else:
                if self.inflate is None or self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                got = self.inflate.decompress(self.raw, READ_BYTES)
                self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a line")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 2 :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, as they come."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            out, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(out)
            yield out


def fields(stream: Stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, names in lower case, and the bytes that they took."""
    out, size = {}, 0
    while line := stream.line():
        size += len(line) + 2
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out, size + 2


def read_records(file, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """Rows of READ: a record's payload by chunks, with length and digest so far; a revisit's are its response's."""
    stream = Stream(file)
    while (version := stream.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        warc, _ = fields(stream)
        left, kind, identity = int(warc["content-length"]), warc["warc-type"], warc["warc-record-id"]
        refers = warc.get("warc-refers-to")
        base = (identity, kind, _page(identity), warc.get("warc-target-uri"), _page(refers))
        status = stream.line()
        http, size = fields(stream)
        left -= len(status) + 2 + size
        if kind == "revisit":
            for _ in stream.pieces(left):
                pass
            yield (*base, 0, True, None, int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"))
            continue
        sha, n, so_far, held, size = hashlib.sha1(), 0, 0, [], 0
        for piece in stream.pieces(left):
            sha.update(piece)
            so_far += len(piece)
            size += len(piece)
            if with_data:
                held.append(piece)
            if size >= chunk_bytes and so_far < left:
                yield (*base, n, False, b"".join(held) if with_data else None, so_far, base32(sha.copy().digest()))
                n, held, size = n + 1, [], 0
        if base32(sha.digest()) != warc["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"the payload of {identity} has changed")
        yield (*base, n, True, b"".join(held) if with_data else None, so_far, base32(sha.digest()))


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in the manifest. The row with last has the whole payload's length and digest."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at) as f:
                    for row in read_records(f, chunk_bytes, with_data):
                        rows.append(row)
                        held += 200 + len(row[7] or b"")
                        if held > 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(read, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark: SparkSession = pages.sparkSession
    manifest = write_warc(pages, scratch(spark, "warc"), min_bytes=min_bytes)
    return read_warc(manifest, with_data=False).where("last")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
