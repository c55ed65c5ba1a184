"""Byte-level BPE by overlapping chunks, and decoding.

A text of at most CHUNK_CHARS code points is one chunk. A longer one is cut into chunks that overlap
by OVERLAP_CHARS; chunks are dealt to all tasks, and each is split into pre-tokens and encoded there
as if the text began at it. The pattern looks only ahead, so from the first boundary that two
neighbours share in their overlap on, both agree for good: there the pieces are joined. Near the end
of a chunk, pre-tokens that the cut may have changed (those that touch it, or begin in its last
three characters) don't count. Where an overlap holds no common boundary (one run of a kind longer
than it), the text from the last sure boundary to the end of the next chunk is split anew, so the
result is exact for any text. Equal long texts are encoded once.

Token ids are kept as little-endian unsigned 32-bit integers in a binary column, token_ids.

Defined cases: null and empty texts have no tokens; null or repeated doc_ids and equal rows are
encoded each for itself; strings of special tokens are ordinary text; an empty table gives an empty
one; further columns are kept if named in ``keep``. A text is held whole by the task that has its row.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .grams import lean, slices

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: Pre-tokens whose ids a worker remembers before it starts afresh.
CACHE = 1 << 17
#: The pattern can decide a pre-token by so many characters from its start ('ll and the like).
AHEAD = 3


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """pre-token -> its ids as bytes; worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = array("I", self.encode(piece)).tobytes()
        return ids


class Encoder:
    _made: dict[tuple, Encoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """One for each worker process and vocabulary."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(read_ranks(path), pattern)
        return cls._made[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(ranks, pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))

    def chunk(self, start: int, text: str, last: bool) -> Chunk:
        """Pre-tokens that are sure whatever follows the chunk, and their ids."""
        ends, found = [0], []
        for m in self.pattern.finditer(text):
            if not last and (m.end() >= len(text) or m.start() > len(text) - AHEAD):
                break
            ends.append(m.end())
            found.append(self.pieces[m[0]])
        return Chunk(start, text, last, ends, found)


class Chunk:
    """bounds[i] to bounds[i + 1] is the place in the chunk of the pre-token with ids[i]."""

    def __init__(self, start: int, text: str, last: bool, bounds: list[int], ids: list[bytes]):
        self.start, self.text, self.last, self.bounds, self.ids = start, text, last, bounds, ids


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, chunk, is the last)."""
    start = 0
    while True:
        last = start + size + overlap >= len(text)
        yield start, text[start : start + size + overlap], last
        if last:
            return
        start += size


def stitch(chunks: Iterator[Chunk], encoder: Encoder) -> bytes:
    """Ids of the whole text; chunks come in order."""
    out: list[bytes] = []
    chunks = iter(chunks)
    here = next(chunks)
    since = 0  # index in here.bounds from which on here is true
    for there in chunks:
        theirs = {there.start + b: i for i, b in enumerate(there.bounds)}
        meet = next(((i, theirs[p]) for i in range(since, len(here.bounds)) if (p := here.start + here.bounds[i]) in theirs), None)
        if meet:
            out += here.ids[since : meet[0]]
            here, since = there, meet[1]
        else:
            out += here.ids[since:]
            sure = here.bounds[-1]
            joined = here.text[sure:] + there.text[here.start + len(here.text) - there.start :]
            here, since = encoder.chunk(here.start + sure, joined, there.last), 0
    return b"".join([*out, *here.ids[since:]])


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: str | None = None) -> DataFrame:
    """The kept columns and token_ids; decoded: name of one more column, the bytes that the ids stand for, from the same worker."""
    results = ["token_ids", decoded][: 1 + bool(decoded)]
    if {*results} & {*keep} or len({*results}) < len(results):
        raise ValueError(f"{results} are the names of the results")
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(f"`{text}`").alias("__text"))
    is_long = F.length("__text") > chunk_chars + overlap_chars
    schema = rows.drop("__text").schema
    for name in results:
        schema = schema.add(name, "binary")

    def made(encoder: Encoder, ids: list[bytes]) -> list[pa.Array]:
        """The result columns."""
        return [pa.array(c, pa.binary()) for c in (ids, [encoder.decode(x) for x in ids] if decoded else [])][: len(results)]

    def whole(batches):
        encoder = Encoder.of(ranks, pattern)
        for b in slices(batches):
            ids = [encoder.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made(encoder, ids)], names=[*b.schema.names[:-1], *results])

    def cut_up(batches):
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (start, part, last) in enumerate(cut(t, chunk_chars, overlap_chars)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "n": pa.array([n], pa.int32()), "start": [start], "part": [part], "last": [last]})

    def split(batches):
        encoder = Encoder.of(ranks, pattern)
        for b in batches:
            for key, n, start, part, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = encoder.chunk(start, part, last)
                yield pa.RecordBatch.from_pydict(
                    {"key": [key], "n": pa.array([n], pa.int32()), "start": [start], "part": [part], "last": [last], "bounds": pa.array([array("I", c.bounds).tobytes()], pa.binary()), "counts": pa.array([array("I", [len(x) // 4 for x in c.ids]).tobytes()], pa.binary()), "ids": pa.array([b"".join(c.ids)], pa.binary())}
                )

    def join(group: pa.Table) -> pa.Table:
        encoder = Encoder.of(ranks, pattern)
        group = group.sort_by("n")

        def read():
            for i in range(group.num_rows):
                r = {c: group.column(c)[i].as_py() for c in ("start", "part", "last", "bounds", "counts", "ids")}
                ids, at = [], 0
                for n in array("I", r["counts"]):
                    ids.append(r["ids"][at : at + 4 * n])
                    at += 4 * n
                yield Chunk(r["start"], r["part"], r["last"], list(array("I", r["bounds"])), ids)

        return pa.table([group.column("key").slice(0, 1), *made(encoder, [stitch(read(), encoder)])], names=["key", *results])

    short = rows.where(~is_long).mapInArrow(lean(whole), schema)
    longer = rows.where(is_long).withColumn("__key", F.sha2("__text", 256))
    texts = longer.groupBy("__key").agg(F.first("__text").alias("text"))
    pieces = texts.mapInArrow(lean(cut_up), "key string, n int, start long, part string, last boolean").repartition("key", "n").mapInArrow(lean(split), "key string, n int, start long, part string, last boolean, bounds binary, counts binary, ids binary")
    joined = pieces.groupBy("key").applyInArrow(join, "key string, " + ", ".join(f"`{c}` binary" for c in results))  # a group is one document
    return short.unionByName(longer.drop("__text").join(joined.withColumnRenamed("key", "__key"), "__key").drop("__key"))


def decode_documents(encoded: DataFrame, ranks: str | None = None, name: str = "decoded") -> DataFrame:
    """encoded with a binary column of the bytes that its token_ids stand for."""
    ranks = ranks or default_ranks()
    at = encoded.columns.index("token_ids")

    def decode(batches):
        table = {i: b for b, i in read_ranks(ranks).items()}
        for b in slices(batches):
            raw = [None if x is None else b"".join(map(table.__getitem__, array("I", x))) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, name])

    return encoded.mapInArrow(lean(decode), encoded.select("*").schema.add(name, "binary"))


def digests(docs: DataFrame, **how) -> DataFrame:
    coded = encode_documents(docs, decoded="decoded", **how)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
