"""Suffix-array dedup: bytes in strings of ``window`` that start anywhere else go.

Only segments whose winnowed anchor occurs again can hold such a string, so these, each different one
once with the number of its occurrences, are the collection. Segments of an anchor go to one task, which
builds the transform and the common prefixes of a batch of anchors column by column (column_bwt);
symbols are SYMBOL bytes, and a window is window / SYMBOL of them. A window occurs again where its
suffix shares that many symbols with a neighbour in the sorted list, or where its segment occurs
more than once. What is found for a segment holds for all its occurrences.

An anchor with more than GROUP different segments isn't brought to one task: its windows are
counted by a 128-bit hash, which Spark aggregates before the exchange.

Defined cases: null and empty texts have no bytes and the hash of the empty string; repeated rows
are occurrences of each other's strings; null or repeated doc_ids are rows like any other; texts
shorter than a window stay whole; an empty table gives an empty one; other columns are ignored.
Removal may cut a character: what is kept is bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .column_bwt import Files, build
from .common import NO_ID, discard, materialise_at, scratch, settle, text_or_empty
from .grams import lean, powers, prefix_sums, signed, slices, winnow
from .repeats import SEGMENTS, identified, repeated_segments
from .warc import open_fs

WINDOW, SYMBOL, SEED = 400, 50, 64
#: Different segments of an anchor that one task sorts, and bytes of segments that it sorts at a time.
GROUP, BATCH = 8_000, 1 << 20
#: Windows of a text that are winnowed at a time.
BLOCK = 1 << 20


def byte_grams(text: bytes) -> np.ndarray:
    """Hashes of the strings of SEED bytes: long enough that few are repeated but in passages."""
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    return (sums[SEED:] - sums[:-SEED]) * powers(len(text))[1][: len(text) - SEED + 1]


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """SEGMENTS of all texts; lo and hi count bytes."""

    def make(batches):
        for b in slices(batches, 64):
            out = []
            for doc_id, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for start in range(0, len(text) - window + 1, BLOCK):
                    part = text[start : start + BLOCK + window - 1]
                    grams = byte_grams(part)
                    at, lo, hi = winnow(grams, window - SEED + 1)
                    seg = np.fromiter((int.from_bytes(hashlib.blake2b(part[i:j], digest_size=8).digest(), "little", signed=True) for i, j in zip(lo.tolist(), (hi + window).tolist(), strict=True)), np.int64, len(lo))
                    n = len(lo)
                    out.append((np.full(n, doc_id), np.full(n, h), signed(grams[at]), seg, (lo + start).astype(np.int32), (hi + start).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "h", "anchor", "seg", "lo", "hi"])

    return identified(docs).mapInArrow(lean(make), SEGMENTS)


def runs(flags: np.ndarray) -> np.ndarray:
    """First and last place of each run of true flags, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    edge[1::2] -= 1
    return edge.astype(np.int32)


def repeated_windows(texts: list[bytes], counts: list[int], window: int, symbol: int, files: Files) -> list[np.ndarray]:
    """For each text the runs of its windows that occur again, in the texts or as counts say."""
    place = np.zeros(sum(map(len, texts)) + 1, bool)
    last = -1  # the place behind all texts
    for suffix, common in build(texts, symbol, window // symbol, files):
        again = common >= window // symbol
        place[suffix[again]] = True
        place[np.concatenate(([last], suffix[:-1]))[again]] = True
        last = suffix[-1]
    out, at = [], 0
    for t, n in zip(texts, counts, strict=True):
        w = len(t) - window + 1
        out.append(np.array([0, w - 1], np.int32) if n > 1 else runs(place[at : at + w]))
        at += len(t)
    return out


def removed_spans(docs: DataFrame, window: int = WINDOW, symbol: int = SYMBOL, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """doc_id, h, spans: (lo, runs) pairs; runs are int32 pairs of first and last window, counted from lo."""
    if window % symbol:
        raise ValueError("a window is a whole number of symbols")
    spark = docs.sparkSession
    found, path = repeated_segments(segments(docs, window))
    alike, alike_path = materialise_at(found.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "lo", "hi")).alias("rep")).select("anchor", "seg", "n", "rep.*"), "alike")
    # written, so that the join stands alone and Spark may split an anchor that very many texts share
    groups, groups_path = materialise_at(alike.groupBy("anchor").agg(F.count("*").alias("members")), "groups")
    per_text = alike.join(groups, "anchor").groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "seg", "n", "members", "lo", "hi")).alias("segs"))  # a text's own segments
    once = identified(docs).join(per_text, ["doc_id", "h"]).select("text", "segs")
    folder = scratch(spark, "piles")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)

    def read(batches):
        for b in slices(batches, 16):
            out = [(s["anchor"], s["seg"], s["n"], s["members"], text[s["lo"] : s["hi"] + window]) for text, segs in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in segs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "seg", "n", "members", "bytes"])

    parts = once.mapInArrow(lean(read), "anchor long, seg long, n long, members long, bytes binary")

    def resolve(batches):
        fs, root = open_fs(folder)
        members: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, now = 0, None

        def done():
            keys, values = list(members), list(members.values())
            got = repeated_windows([t for _, t in values], [n for n, _ in values], window, symbol, Files(fs, root))
            rows = [(a, s, g.tobytes()) for (a, s), g in zip(keys, got, strict=True) if len(g)]
            return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "seg", "runs"])] if rows else []

        for b in slices(batches):
            for anchor, seg, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != now and size >= batch:
                    yield from done()
                    members.clear()
                    size = 0
                now = anchor
                if (anchor, seg) not in members:  # an identifier's text may stand in several rows
                    members[anchor, seg] = (n, text)
                    size += len(text)
        if members:
            yield from done()

    def one_by_one(batches):
        for b in slices(batches, 16):
            out = [(hashlib.blake2b(t[w : w + window], digest_size=16).digest(), anchor, seg, n, w) for anchor, seg, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in range(len(t) - window + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "anchor", "seg", "n", "w"])

    def as_runs(batches):
        for b in slices(batches):
            got = []
            for ws in b.column(2).to_pylist():
                flags = np.zeros(max(ws) + 1, bool)
                flags[ws] = True
                got.append(runs(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["anchor", "seg", "runs"])

    small = parts.where(F.col("members") <= group).select("anchor", "seg", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    result = small.mapInArrow(lean(resolve), "anchor long, seg long, runs binary")
    if groups.where(F.col("members") > group).limit(1).count():
        single, _ = materialise_at(parts.where(F.col("members") > group).select("anchor", "seg", "n", "bytes").mapInArrow(lean(one_by_one), "key binary, anchor long, seg long, n long, w int").dropDuplicates(["anchor", "seg", "w"]), "windows")
        often = single.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
        result = result.unionByName(single.join(often, "key").groupBy("anchor", "seg").agg(F.collect_list("w").alias("ws")).mapInArrow(lean(as_runs), "anchor long, seg long, runs binary"))  # a segment's own windows
    result, result_path = materialise_at(result, "runs")
    fs.delete_dir(root)
    settle(spark)
    spans = found.join(result, ["anchor", "seg"]).groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "runs")).alias("spans"))  # a text's own segments
    out, _ = materialise_at(spans, "spans")
    for p in (path, alike_path, groups_path, result_path):
        discard(p, spark)
    settle(spark)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes)."""
    body = text_or_empty()
    keyed = docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("text"))
    joined = keyed.join(removed_spans(docs, window, **how), ["doc_id", "h"], "left").select("id", "text", "spans")

    def cut(batches):
        for b in slices(batches, 64):
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                removed, n, kept = 0, 0, text
                if spans:
                    edge = np.zeros(len(text) + 1, np.int64)
                    for s in spans:
                        pairs = np.frombuffer(s["runs"], np.int32) + s["lo"]
                        np.add.at(edge, pairs[::2], 1)
                        np.add.at(edge, pairs[1::2] + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, n = int(gone.sum()), len(runs(gone)) // 2
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(text), removed, n, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
