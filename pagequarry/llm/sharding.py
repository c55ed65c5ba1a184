"""Sharding by histogram sort: splitters found by counting exact bytes, then one exchange.

Documents are sorted by (hash of the text, tie), the tie being a hash of doc_id and a row number, so
equal texts stand side by side. Cells of the key space are the probes: the first round counts the
bytes of 4096 equal cells; every further round splits by 8 more bits only those cells in which a
splitter lies further than TOLERANCE of a shard from either edge, or which hold too many rows. A
cell of a single text hash is split by the tie, so a text that a third of all rows share is dealt
out like any other range of keys; smaller groups of equal texts stay whole, as splitters stand at
cell edges. The counts of the last round give each cell its first shard slot; rows get their slot
from the cell's offset and their place in the cell, and no task sees more than a cell.

Law: ``bytes`` (sizes nearly equal). Size: UTF-8 bytes of the text plus 8.

Defined cases: null text counts as empty; null or repeated doc_ids and equal rows are rows like any
other; an empty table gives an empty one; with fewer rows than shards some shards stay empty; other
columns are ignored (assign) or kept (shard_documents).
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, text_or_empty

SHARDS = 24
#: The distance from its target, in mean shards, at which a splitter is good enough.
TOLERANCE = 0.005
FIRST_BITS, MORE_BITS = 12, 8
#: A cell of more rows than this, and than 8 times the mean, is split even if no splitter lies in it.
CELL_ROWS = 50_000


def keyed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, and the key (h, t) of each row, both with their sign bit turned so that bits sort as unsigned."""
    body = text_or_empty(text)
    rows = docs.select(*keep, "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("n"))
    return rows.withColumn("t", F.xxhash64("doc_id", "n"))


def _bits(column: str, start: int, width: int) -> Column:
    """Bits start to start + width of a 64-bit column, the highest first, as fixed-width hex."""
    width = min(width, 64 - start)
    value = F.shiftrightunsigned(column, 64 - start - width).bitwiseAND((1 << width) - 1)
    return F.lpad(F.hex(value), 3, "0")


def histogram(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """rows with their cell, and every cell's (name, bytes, rows) in key order. The driver holds cells, never rows: at most 4096 and 256 for each that was split."""
    spark = rows.sparkSession
    at = rows.withColumn("cell", _bits("h", 0, FIRST_BITS))
    depth: dict[str, tuple[str, int]] = {}
    cells: dict[str, tuple] = {}
    count = lambda df: {r["cell"]: tuple(r)[1:] for r in df.groupBy("cell").agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h")).collect()}
    fresh = count(at)
    for cell in fresh:
        depth[cell] = ("h", FIRST_BITS)
    while fresh:
        cells |= fresh
        names = sorted(cells)
        ends = list(accumulate(cells[c][0] for c in names))
        total, n = ends[-1], sum(cells[c][1] for c in names)
        limit = max(cell_rows, 8 * n >> FIRST_BITS)
        split = {c for c in names if cells[c][1] > limit}
        for k in range(1, shards):
            target = total * k / shards
            i = bisect_left(ends, target)
            if cells[names[i]][1] > 1 and min(ends[i] - target, target - (ends[i] - cells[names[i]][0])) > tolerance * total / shards:
                split.add(names[i])
        split -= {c for c in split if depth[c] == ("t", 64)}
        if not split:
            break
        by = []
        for c in split:
            kind, start = depth[c]
            if kind == "h" and (cells[c][2] == cells[c][3] or start >= 64):
                kind, start = "t", 0
            by.append((c, kind, start))
        cases = spark.createDataFrame(by, "cell string, kind string, start int")
        part = F.lit(None).cast("string")
        for kind, start in sorted({x[1:] for x in by}):
            part = F.when((F.col("kind") == kind) & (F.col("start") == start), _bits(kind, start, MORE_BITS)).otherwise(part)
        # cases: at most one row for each splitter and for each cell over the limit, of which there are at most 512
        at = at.join(F.broadcast(cases), "cell", "left").withColumn("cell", F.when(F.col("kind").isNotNull(), F.concat("cell", F.lit("."), part)).otherwise(F.col("cell"))).drop("kind", "start")
        known = {c: (kind, min(64, start + MORE_BITS)) for c, kind, start in by}
        fresh = count(at.where(F.col("cell").contains(".") & F.regexp_replace("cell", r"\.[^.]*$", "").isin(list(split))))
        for cell in fresh:
            depth[cell] = known[cell.rpartition(".")[0]]
        for c in split:
            del cells[c]
    return at, [(c, cells[c][0], cells[c][1]) for c in sorted(cells)]


def deal(cells: list[tuple[str, int, int]], shards: int = SHARDS) -> list[tuple[str, int, int]]:
    """(cell, shard, slot of its first row): the splitters stand at the cell edges next to equal parts of the bytes."""
    total, before, at, slots, out = sum(c[1] for c in cells), 0, 0, 0, []
    ends = [0, *accumulate(c[1] for c in cells)]
    edges = []
    for k in range(1, shards):
        target = total * k / shards
        i = bisect_left(ends, target)
        edges.append(i if i < len(ends) and (i == 0 or ends[i] - target <= target - ends[i - 1]) else i - 1)
    for i, (cell, _, n) in enumerate(cells):
        while at < shards - 1 and edges[at] <= i:
            at, slots = at + 1, 0
        out.append((cell, at, slots))
        slots += n
    return out


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; rows stand in shard order after one exchange."""
    rows = materialise(keyed(docs, text), "shard-keys")
    spark = docs.sparkSession
    at, cells = histogram(rows, shards, tolerance, cell_rows)
    dealt = spark.createDataFrame(deal(cells, shards) or [("", 0, 0)], "cell string, shard int, first long")
    # a row for each cell, of which histogram() bounds the number
    placed = at.join(F.broadcast(dealt), "cell")
    order = Window.partitionBy("shard", "cell").orderBy("h", "t", "doc_id", "n")
    slot = F.col("first") + F.row_number().over(order) - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Write whole documents into path/shard=N. The rows are written with their keys first, so docs is read once; counting reads only the keys, and the texts move once."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id"), F.col(f"`{text}`").alias("__text"))
    rows = materialise(keyed(packed, "__text", ("__row",)), "shard-rows")
    at, cells = histogram(rows, shards, tolerance)
    dealt = docs.sparkSession.createDataFrame(deal(cells, shards) or [("", 0, 0)], "cell string, shard int, first long")
    out = at.join(F.broadcast(dealt), "cell").select("__row", "shard", "cell")
    out.repartition(max(shards, shuffle_partitions(docs.sparkSession)), "shard", "cell").select("__row.*", F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
