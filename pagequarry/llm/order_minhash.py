"""Document fingerprints by Order MinHash.

The k-mers are a text's strings of 8 UTF-8 bytes, each numbered by its occurrence in the text. Each
of 64 hash functions selects the 2 least numbered k-mers; they are put back into text order and the
pair is hashed to 16 bits. Two texts' likeness is the share of functions with equal hashes: it falls
with their edit distance, as both what k-mers they share and the order of these count.

``succession_marks`` gives each document the next one in descending doc_id: ranges of (doc_id, hash of the
text) are one partition each. Their bounds are rows of a random sample of SAMPLE rows a range, chosen so that the
sample's bytes are dealt evenly; the row on a bound goes to both sides, and the first also to the end
of the last range. So texts move once, no task sorts them all, and rows without doc_id, or of one, are
ranges like others.

Defined cases: null text counts as empty; the empty text has a fingerprint of its own, like that of
other empty texts only; texts under 8 bytes are one k-mer, padded with zero bytes; null doc_ids come
after all others; equal doc_ids stand in the order of their texts' hash (rows equal in both are never
parted); a single document's next is itself; equal texts have equal fingerprints; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partition_keys, shuffle_partitions, text_or_empty

K, FUNCTIONS, BLOCK = 8, 64, 8192
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.Generator(np.random.PCG64(20))
_XOR = _RNG.integers(0, 2**32, (FUNCTIONS, 1), dtype=np.uint32)
_ODD = _RNG.integers(0, 2**31, (FUNCTIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_EMPTY = np.full(FUNCTIONS, 0xFFFF, np.uint16)
_ALL = np.arange(FUNCTIONS)
#: Ranges at most, and rows that the driver sees of each to find the bounds.
RANGES, SAMPLE = 2000, 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x >> np.uint64(32)


def fingerprint(text: bytes) -> np.ndarray:
    """FUNCTIONS hashes of 16 bits."""
    if not text:
        return _EMPTY
    text = text.ljust(K, b"\0")
    n = len(text) - K + 1
    grams = _mix(np.ndarray((n,), "<u8", text, strides=(1,)).astype(np.uint64))
    placed = (grams << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    placed.sort()
    where = (placed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    placed >>= np.uint64(32)
    index = np.arange(n)
    first = np.zeros(n, np.int64)
    new = np.flatnonzero(placed[1:] != placed[:-1]) + 1
    first[new] = new
    occurrence = np.empty(n, np.uint64)
    occurrence[where] = index - np.maximum.accumulate(first)
    numbered = _mix(grams + (occurrence + np.uint64(1)) * MIX2).astype(np.uint32)
    least, places = np.full((FUNCTIONS, 2), 2**32, np.uint64), np.zeros((FUNCTIONS, 2), np.int64)
    for at in range(0, n, BLOCK):
        values = (numbered[None, at : at + BLOCK] ^ _XOR) * _ODD
        one = values.argmin(1)
        v1 = values[_ALL, one]
        if values.shape[1] > 1:
            values[_ALL, one] = 0xFFFFFFFF
            two = values.argmin(1)
            v2 = values[_ALL, two].astype(np.uint64)
        else:
            two, v2 = one, np.full(FUNCTIONS, 2**32, np.uint64)
        if at == 0:
            least, places = np.stack([v1.astype(np.uint64), v2], 1), np.stack([one, two], 1)
        else:
            both, spots = np.column_stack([least, v1, v2]), np.column_stack([places, one + at, two + at])
            pick = both.argsort(1, kind="stable")[:, :2]
            least, places = np.take_along_axis(both, pick, 1), np.take_along_axis(spots, pick, 1)
    places.sort(1)
    return (_mix(grams[places[:, 0]] * MIX1 + grams[places[:, 1]]) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fingerprint: narrow, no shuffle."""
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(f"`{text}`").cast("binary").alias("__text"))

    def make(batches):
        for b in batches:
            marks = pa.array([written(fingerprint(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], marks], names=[*b.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(make, rows.drop("__text").schema.add("fingerprint", "string"))


def place() -> Column:
    """Where a row stands: descending doc_id, null last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("d"), F.xxhash64("text").alias("h"))


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, place, part, role: a row belongs to its part if role is 0, and follows the last row of its part if it is 1 (2: the first of all)."""
    parts = max(1, min(parts, RANGES))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    slim = materialise(rows.select(place().alias("place"), F.octet_length("text").alias("size")), "places")
    n, first = slim.agg(F.count("*"), F.min("place")).first()
    seen = sorted((tuple(p), size + 1) for p, size in slim.where(F.rand(11) < min(1.0, SAMPLE * parts / max(n, 1))).collect())
    total, so_far, at, bounds = sum(size for _, size in seen), 0, 0, []
    for p, size in seen:
        if so_far * parts // total > at and p not in bounds[-1:]:
            at = so_far * parts // total
            bounds.append(p)
        so_far += size
    known = lambda p: F.struct(F.lit(bool(p[0])).alias("n"), F.lit(int(p[1])).cast("long").alias("d"), F.lit(int(p[2])).cast("long").alias("h"))
    rows = rows.withColumn("place", place())
    own, others = F.lit(0), []
    if bounds:
        all_bounds = F.array(*map(known, bounds))
        own = F.size(F.filter(all_bounds, lambda b: b <= F.col("place")))
        others = [F.when(F.array_contains(all_bounds, F.col("place")), _to(F.col("own") - 1, 1))]
    if n:
        others.append(F.when(F.col("place") == known(first), _to(F.lit(len(bounds)), 2)))
    rows = rows.withColumn("own", own)
    return rows.select("doc_id", "text", "place", F.explode(F.array_compact(F.array(_to(F.col("own"), 0), *others))).alias("at")).select("doc_id", "text", "place", "at.part", "at.role")


def _to(part: Column, role: int) -> Column:
    return F.struct(part.cast("int").alias("part"), F.lit(role).alias("role"))


def succession_marks(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likenesses: see the contract in query()."""
    parts = parts or shuffle_partitions(docs.sparkSession)
    keys = F.array(*map(F.lit, partition_keys(docs.sparkSession, parts)))
    rows = ranges(docs, parts).withColumn("key", F.get(keys, F.col("part")))
    rows = rows.repartition(parts, "key").sortWithinPartitions("part", "role", "place", "text").select("doc_id", "text", "part", "role")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def make(batches):
        last = None  # the row whose next one is to come: part, doc_id, text, fingerprint
        for b in batches:
            out = []
            for doc_id, text, part, role in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and last[0] != part:
                    last = None
                if role and not last:
                    continue
                mark = fingerprint(text.encode())
                if last:
                    _, had_id, had, had_mark = last
                    half = len(had) // 2
                    edited = (had[: len(had) - half] + text[:half]).encode()
                    edited_mark = fingerprint(edited)
                    out.append((had_id, len(had), hashlib.sha256(edited).hexdigest(), written(had_mark), written(edited_mark), likeness(had_mark, edited_mark), likeness(had_mark, mark)))
                last = None if role else (part, doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return succession_marks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
