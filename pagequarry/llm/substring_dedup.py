"""Substring dedup by seed and extend.

Seeds: the winnowed anchors (runs of SEED words) of all windows of ``window`` words. Documents are joined
on anchors that occur again. What surrounds an anchor, as far as its windows reach, is a segment; equal
segments (by two 64-bit hashes) are extended once, for the one in the smallest doc_id. Different
segments of an anchor are extended both ways word by word: two tries, to the left and to the right,
name what is equal so far, and a branch that one segment alone follows ends there. A window is the
pair of its left and its right name, so equal windows are equal word by word, and each gets the
smallest doc_id that holds it; maximal repeats are the unions of the windows that a smaller doc_id
holds too. No pairs are made: the work is a segment's length, whatever the number of its likes.

An anchor with more than GROUP different segments isn't brought to one task: its windows are
grouped by a 128-bit hash of their words instead, which Spark aggregates before the exchange.

Defined cases: null and empty texts have no words and the hash of the empty string; a null doc_id
counts as larger than all others; documents of equal doc_id take nothing from each other; repeated
rows are treated alike; texts shorter than a window stay whole; an empty table gives an empty one;
other columns are ignored (judged) or kept (dedup_documents).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise_at, settle, text_or_empty
from .grams import lean, runs_of, signed, slices, winnow, words
from .repeats import SEGMENTS, identified, repeated_segments

WINDOW, SEED = 50, 8
#: Different segments of an anchor that one task extends.
GROUP = 20_000


def segments(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """SEGMENTS of all texts; lo and hi count words."""

    def make(batches):
        for b in slices(batches):
            out = []
            for doc_id, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts, ends, hashes = words(text)
                if len(starts) < window:
                    continue
                grams = runs_of(hashes, seed)
                at, lo, hi = winnow(grams, window - seed + 1)
                plain = b" ".join(text.split())
                place = np.concatenate(([0], np.cumsum(ends - starts + 1)))
                left, right = place[lo].tolist(), (place[hi + window] - 1).tolist()
                seg = np.fromiter((int.from_bytes(hashlib.blake2b(plain[i:j], digest_size=8).digest(), "little", signed=True) for i, j in zip(left, right, strict=True)), np.int64, len(lo))
                # two segments of an anchor are equal only if it stands at the same place of both
                seg ^= (at - lo) * 0x1F123BB5
                n = len(lo)
                out.append((np.full(n, doc_id), np.full(n, h), signed(grams[at]), seg, lo.astype(np.int32), hi.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "h", "anchor", "seg", "lo", "hi"])

    return identified(docs).mapInArrow(lean(make), SEGMENTS)


def extend(group: list[tuple[int, int, int, list[bytes]]], window: int, seed: int) -> list[tuple[int, int]]:
    """group: different segments of one anchor as (seg, smallest doc_id, place of the anchor, words). Returns (seg, bits): windows of it that a smaller doc_id holds."""
    far = window - seed

    def names(sides: list[list[bytes]]) -> list[list[int]]:
        """For each segment the name of its first 0, 1, 2 ... words; -1 from where no other goes with it."""
        out = [[0] for _ in sides]
        alive, fresh = list(range(len(sides))), 1
        for depth in range(far):
            step: dict[tuple[int, bytes], list[int]] = {}
            for i in alive:
                if depth < len(sides[i]):
                    step.setdefault((out[i][depth], sides[i][depth]), []).append(i)
            alive = []
            for members in step.values():
                if len(members) > 1:
                    for i in members:
                        out[i].append(fresh)
                    fresh += 1
                    alive += members
        return out

    lefts = names([ws[:at][::-1] for _, _, at, ws in group])
    rights = names([ws[at + seed :] for _, _, at, ws in group])
    first: dict[tuple[int, int, int], int] = {}
    held = []
    for (_, doc, at, ws), left, right in zip(group, lefts, rights, strict=True):
        keys = []
        for w in range(max(0, at - len(left) + 1), min(at, len(ws) - window, at + seed + len(right) - 1 - window) + 1):
            key = (at - w, left[at - w], right[w + window - at - seed])
            keys.append((w, key))
            if first.get(key, doc) >= doc:
                first[key] = doc
        held.append(keys)
    out = []
    for (seg, doc, _, _), keys in zip(group, held, strict=True):
        bits = sum(1 << w for w, key in keys if first[key] < doc)
        if bits:
            out.append((seg, bits))
    return out


def removed_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, h, spans: for each text with windows that start in a smaller doc_id too, (first window, last window) pairs, in words."""
    spark = docs.sparkSession
    if window - seed > 62:
        raise ValueError("a segment's windows are the bits of a long")
    found, path = repeated_segments(segments(docs, window, seed))
    alike = found.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "h", "lo", "hi")).alias("rep"))
    alike, alike_path = materialise_at(alike.select("anchor", "seg", "rep.*"), "alike")
    # written, here and below, so that a join stands alone and Spark may split an anchor or a segment that very many texts share
    groups, groups_path = materialise_at(alike.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    needed = alike.join(groups, "anchor")
    per_text = needed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "seg", "lo", "hi", "n")).alias("segs"))  # a text's own segments

    def read(batches):
        for b in slices(batches, 32):
            out = []
            for doc_id, text, segs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = text.split()
                hashes = words(text)[2]
                grams = runs_of(hashes, seed)
                for s in segs:
                    part = ws[s["lo"] : s["hi"] + window]
                    at = s["lo"] + int(np.flatnonzero(signed(grams[s["lo"] : s["hi"] + window - seed + 1]) == s["anchor"])[-1])
                    out.append((s["anchor"], s["seg"], doc_id, s["n"], at - s["lo"], b" ".join(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "seg", "doc_id", "n", "at", "words"])

    # an identifier may have several texts, and a text several rows: one of them is read
    texts = identified(docs)
    once = texts.join(per_text, ["doc_id", "h"]).select("doc_id", "text", "segs")
    parts = once.mapInArrow(lean(read), "anchor long, seg long, doc_id long, n long, at int, words binary")

    def resolve(batches):
        now, members = None, {}

        def done():
            if len(members) < 2:
                return []
            return [(now, seg, bits) for seg, bits in extend([(seg, doc, at, ws.split(b" ")) for seg, (doc, at, ws) in members.items()], window, seed)]

        out = []
        for b in slices(batches, 4096):
            for anchor, seg, doc_id, at, ws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != now:
                    out += done()
                    now, members = anchor, {}
                members[seg] = (doc_id, at, ws)
            if out:
                yield batch(out)
                out = []
        out += done()
        if out:
            yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor", "seg", "bits"])

    def one_by_one(batches):
        for b in slices(batches, 64):
            out = []
            for anchor, seg, doc_id, _, ws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = ws.split(b" ")
                for w in range(len(ws) - window + 1):
                    out.append((hashlib.blake2b(b" ".join(ws[w : w + window]), digest_size=16).digest(), anchor, seg, doc_id, w))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "anchor", "seg", "doc_id", "w"])

    small = parts.where(F.col("n") <= group).select("anchor", "seg", "doc_id", "at", "words").repartition("anchor").sortWithinPartitions("anchor")
    bits = small.mapInArrow(lean(resolve), "anchor long, seg long, bits long")
    if groups.where(F.col("n") > group).limit(1).count():
        single, _ = materialise_at(parts.where(F.col("n") > group).select("anchor", "seg", "doc_id", "at", "words").mapInArrow(lean(one_by_one), "key binary, anchor long, seg long, doc_id long, w int"), "windows")
        earliest = single.groupBy("key").agg(F.min("doc_id").alias("first"))
        late = single.join(earliest, "key").where("first < doc_id").groupBy("anchor", "seg").agg(F.expr("bit_or(shiftleft(1L, w))").alias("bits"))
        bits = bits.unionByName(late)
    bits, bits_path = materialise_at(bits, "bits")
    settle(spark)
    # a later copy of a segment loses all its windows, the first those in bits
    info, info_path = materialise_at(alike.select("anchor", "seg", F.col("doc_id").alias("first")).join(bits, ["anchor", "seg"], "left"), "info")
    lost = found.join(info, ["anchor", "seg"]).where((F.col("doc_id") > F.col("first")) | F.col("bits").isNotNull())
    lost = lost.select("doc_id", "h", "lo", "hi", F.when(F.col("doc_id") > F.col("first"), F.lit(None).cast("long")).otherwise(F.col("bits")).alias("bits"))
    spans = lost.groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi", "bits")).alias("spans"))  # a text's own segments
    out, _ = materialise_at(spans, "spans")
    for p in (path, alike_path, groups_path, bits_path, info_path):
        discard(p, spark)
    settle(spark)
    return out


def removed_words(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words go."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        for w in range(s["lo"], s["hi"] + 1):
            if s["bits"] is None or s["bits"] >> (w - s["lo"]) & 1:
                edge[w] += 1
                edge[w + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def judged(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by a space)."""
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("body"))
    keyed = rows.select("id", F.coalesce("id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("body").alias("h"), F.col("body").cast("binary").alias("text"))
    joined = keyed.join(removed_windows(docs, window, **how), ["doc_id", "h"], "left").select("id", "text", "spans")

    def cut(batches):
        for b in slices(batches):
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = text.split()
                gone = removed_words(len(ws), spans, window) if spans else None
                kept = ws if gone is None else [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                out.append((doc_id, len(ws), len(ws) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept binary")


def dedup_documents(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """docs without the removed words, in texts that lost some; the rest of a text, white space included, stays. Texts of which no word is left go; n_chars follows the text if there is such a column."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("h"))
    spans = removed_windows(docs, window, **how)
    joined = keyed.join(spans, ["doc_id", "h"], "left").select("row", "spans")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for b in slices(batches):
            columns = [b.column(0).field(i) for i in range(len(docs_schema.fields))]
            texts, keep = [], []
            for text, spans in zip(columns[at].to_pylist(), b.column(1).to_pylist(), strict=True):
                if spans:
                    raw = text.encode()
                    starts, ends, _ = words(raw)
                    gone = removed_words(len(starts), spans, window)
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    parts, from_ = [], 0
                    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        parts.append(raw[from_ : starts[i]])
                        from_ = int(starts[j]) if j < len(starts) else len(raw)
                    text = b"".join([*parts, raw[from_:]]).decode()
                    keep.append(not gone.all())
                else:
                    keep.append(True)
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns[chars] = lengths.cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_schema.names).filter(pa.array(keep))

    docs_schema = docs.schema
    return joined.mapInArrow(lean(cut), docs_schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
