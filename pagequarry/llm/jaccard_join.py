"""N-gram Jaccard join by parity sketches.

A document's set is that of its distinct shingles (hashes of ``shingle`` words, A-Z as a-z). Documents of
sizes that can be alike meet in a size band. For a band whose pairs differ in at most D shingles a
sketch is P parts of 65,536 bits; every shingle flips one bit of one part. Two sketches differ in at
most as many bits, so in as many parts, as the sets have unlike members: with P = D + 1 + D / 2, two
documents that link have more than P - 1 - d equal parts, d being what the one at hand can differ by (pigeonhole).
A key is (band, part, its bits). First each document learns which of its keys another one has too (parts
without bits count as shared by all); all parts of one order (fewest bits first, then by key), it drops
the P - 1 - d least of these: the equal parts of two that link are among the shared ones of both, and more than
either drops, so the last of them stays on both sides, while a document that only shares passages has
few equal parts and mostly keeps none. Documents are then joined on the keys that stay: in each task
first, where likes are tied to the least of them and only that one goes on, then once for each key. A
key of any number of documents costs a row for each task.

What the keys tie together is a family (connected components). All links lie within families. A family is
verified on the shingles themselves: least frequent first, documents that share a prefix shingle
and aren't yet in one component are compared exactly; so a family of thousands of likes needs no
pair of each two of them. A family of more than FAMILY shingles is dealt to blocks, each verified by itself; the
largest components of neighbouring blocks are compared by REPS members each; and what is then outside
the family's largest component (as a rule little or nothing) is compared with every block, so all pairs of
different components have met and no member goes to more tasks than there are blocks of such outsiders.

``percent`` is the least 100 * intersection / union of a link. Default: 5 words, 80; the query of the contract: 3 words, 90.

Defined cases: null texts and texts without words have the empty set and link with nothing; texts of
fewer words than a shingle have one, the whole sequence; equal sets link; null or repeated doc_ids
are rows like any other (a null one counts as larger than all, and is returned as null if nothing smaller is
reachable); an empty table gives an empty one; other columns are ignored (linked) or kept
(keep_one). Shingles are told apart by 64-bit hashes; sets by 64-bit hashes and their sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, materialise_at, settle, shuffle_partitions, text_or_empty
from .components import components
from .grams import MIX1, lean, mix, signed, slices, words

SHINGLE, PERCENT = 5, 80
#: Documents whose keys a task joins among themselves before it sends them on.
TASK_KEYS = 1 << 18
#: Shingles of a family that one task verifies, and members by which a block's largest component is known to the next block.
FAMILY, REPS = 4_000_000, 64
MEMBERS = "family long, one int, two int, own long, root long, found binary"
WIDTH = np.uint64(1 << 16)
LOW48, SEVEN = np.uint64((1 << 48) - 1), np.uint64(7)
#: What goes to a bucket: a key and the one set of a chunk that has it, a key of several, a set's key, a set.
PACKED = "bucket int, kind int, rows binary"
SINGLE, FLAG, MEMBER, NODE = range(4)
NODES = np.dtype([("node", "<u8"), ("set", "<i8"), ("spare", "<i4")])


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes."""
    hashes = words(text, fold=True)[2]
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, k)
    acc = hashes[: n - size + 1] + np.uint64(size)
    for j in range(1, size):
        acc = mix(acc) * MIX1 + hashes[j : n - size + 1 + j]
    return np.unique(mix(acc))


def identity(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bands:
    """Size bands [edge, next edge) and what a pair in each can differ by."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))
        self._of = np.array(self.edges)

    def of(self, size: int) -> range:
        """The bands of a size and of all larger ones that it can link with."""
        own, last = np.searchsorted(self._of, (size, size * 100 // self.percent), "right").tolist()
        return range(own - 1, last)

    def differ(self, a: int, b: int) -> int:
        """Most unlike members d of two linked sets of sizes a and b: d * (100 + percent) <= (100 - percent) * (a + b)."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """One more than a pair of the band can differ in, and half as many to choose from."""
        most = self.differ(self.edges[band + 1] - 1, self.edges[band + 1] - 1)
        return most + 1 + most // 2

    def spare(self, size: int, band: int) -> int:
        """A set of this size has more equal parts than so many with each that it links with in the band."""
        return self.parts(band) - 1 - self.differ(size, max(size, min(size * 100 // self.percent, self.edges[band + 1] - 1)))


def part_keys(found: np.ndarray, band: int, parts: int, spare: int) -> tuple[np.ndarray, int]:
    """A key for each part of the parity sketch of a set, its lowest three bits the bits set (7: or more), and how many of the shared ones must be dropped.

    Parts without a bit come first of those to drop, by their keys, and always count as shared: a set drops as
    many of its own as it may, whether or not any other has them, and they get no keys. So what two sets have
    in common is counted alike on both sides.
    """
    seeded = mix(found ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64))
    codes = (seeded >> np.uint64(32)) % np.uint64(parts) * WIDTH + (seeded & (WIDTH - np.uint64(1)))
    codes, n = np.unique(codes, return_counts=True)
    codes = codes[n % 2 == 1]  # bits flipped twice are not set
    part = (codes // WIDTH).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, part, mix(codes + np.uint64(band << 48)))
    held = np.bincount(part, minlength=parts)
    keys = mix(sums + (np.arange(parts, dtype=np.uint64) << np.uint64(8)) * MIX1 + np.uint64(band + 1))
    keys = keys & ~SEVEN | np.minimum(held, 7).astype(np.uint64)
    empty = np.sort(keys[held == 0])
    return np.concatenate((keys[held > 0], empty[spare:])), max(0, spare - len(empty))


def narrow(x: np.ndarray) -> bytes:
    """The lower 48 bits of each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def by_bucket(buckets: np.ndarray, kind: int, *columns: np.ndarray) -> tuple[list, list, list]:
    """(buckets, kinds, rows): the bytes of each bucket's columns one after the other, unsigned ones narrowed."""
    order = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[order], [c[order] for c in columns]
    found, starts = np.unique(buckets, return_index=True)
    if not len(found):
        return [], [], []
    rows = [b"".join(narrow(c) if c.dtype == np.uint64 else c.tobytes() for c in piece) for piece in zip(*(np.split(c, starts[1:]) for c in columns), strict=True)]
    return found.tolist(), [kind] * len(rows), rows


def packed(*parts: tuple[list, list, list]) -> Iterator[pa.RecordBatch]:
    buckets, kinds, rows = ([x for p in parts for x in p[i]] for i in range(3))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "kind", "rows"])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by a, then b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def tie(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins rows of equal keys to the least set of each. Returns (keys, their least sets, edges as rows of two)."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    least = sets[first][np.cumsum(first) - 1]
    apart = least != sets
    edges = np.unique(np.stack([sets[apart], least[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return keys[first], sets[first], edges


def _texts(docs: DataFrame, text: str = "text") -> DataFrame:
    body = text_or_empty(text)
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("text"))


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, n_shingles, set (null: the empty set)."""

    def make(batches):
        for b in slices(batches):
            found = [shingles(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([identity(x) if len(x) else None for x in found], pa.int64())], names=["doc_id", "h", "n_shingles", "set"])

    return _texts(docs).mapInArrow(lean(make), "doc_id long, h long, n_shingles long, set long")


def shared_keys(docs: DataFrame, shingle: int, percent: int, bits: int) -> DataFrame:
    """Packed (node, key) for each part that a set shares with another one, and (node, set, spare) for each node: a set in a band.

    A key that several sets of a chunk have is told at once to each of them, and goes on as one row that only
    says so; the others go to their key's bucket. So a key of any number of sets costs its bucket a row a chunk.
    """
    bands, top = Bands(percent), np.uint64(64 - bits)
    known = np.uint64(((1 << bits) - 1) << (64 - bits)) | LOW48

    def spread(keys, nodes, sets):
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        alone = n[at] == 1
        told = keys[~alone]
        flags = np.unique(told)
        anywhere = (nodes[~alone] % np.uint64(1 << bits)).astype(np.int64)
        own = (sets["node"] % np.uint64(1 << bits)).astype(np.int64)
        yield from packed(
            by_bucket((keys[alone] >> top).astype(np.int64), SINGLE, keys[alone], nodes[alone]),
            by_bucket((flags >> top).astype(np.int64), FLAG, flags),
            by_bucket(anywhere, MEMBER, nodes[~alone], told.view(np.int64)),
            by_bucket(own, NODE, sets),
        )

    def make(batches):
        held, size, seen = [], 0, set()

        def flush():
            sets = np.array([h[:3] for h in held], NODES)
            return spread(np.concatenate([h[3] for h in held]), np.repeat(sets["node"], [len(h[3]) for h in held]), sets)

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                found = shingles(text, shingle)
                if not len(found) or (own := identity(found)) in seen:
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(own)
                for band in bands.of(len(found)):
                    keys, spare = part_keys(found, band, bands.parts(band), bands.spare(len(found), band))
                    node = int(mix(np.array([own], np.int64).view(np.uint64) + np.uint64(band))[0] & LOW48)
                    held.append((node, own, spare, keys & known))
                    size += len(keys)
            if size >= TASK_KEYS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches):
        now, singles, flags = None, [], []
        members, nodes, size = [], [], 0

        def shared():
            raw = [(widen(r[: len(r) // 2]), widen(r[len(r) // 2 :])) for r in singles]
            if not raw:
                return []
            keys, who = distinct_pairs(np.concatenate([x for x, _ in raw]), np.concatenate([x for _, x in raw]))
            _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            found = (n[at] > 1) | np.isin(keys, widen(b"".join(flags)))
            return [(who[found], (keys[found] | np.uint64(now << (64 - bits))).view(np.int64))]

        def send():
            yield from packed((*zip(*nodes, strict=True),) if nodes else ([], [], []))
            if members:
                who, keys = (np.concatenate(c) for c in zip(*members, strict=True))
                yield from packed(by_bucket((who % np.uint64(1 << bits)).astype(np.int64), MEMBER, who, keys))

        for b in batches:
            for bucket, kind, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    found = shared()
                    members += found
                    size += sum(len(x) for x, _ in found)
                    now, singles, flags = bucket, [], []
                if kind == NODE:
                    nodes.append((bucket, NODE, rows))
                    size += len(rows) // NODES.itemsize
                elif kind == MEMBER:
                    cut = len(rows) * 6 // 14
                    members.append((widen(rows[:cut]), np.frombuffer(rows[cut:], np.int64)))
                    size += len(members[-1][0])
                else:
                    (singles if kind == SINGLE else flags).append(rows)
            if size >= TASK_KEYS:
                yield from send()
                members, nodes, size = [], [], 0
        members += shared()
        yield from send()

    n = shuffle_partitions(docs.sparkSession)
    sent = _texts(docs).select("text").mapInArrow(lean(make), PACKED)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), PACKED)


def candidates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets: those with an equal key that both keep are connected through them."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    bits = max(12, (n - 1).bit_length())
    top = np.uint64(64 - bits)

    def send(keys, sets, edges) -> Iterator[pa.RecordBatch]:
        whole = np.empty(len(keys), [("key", "<u8"), ("set", "<i8")])
        whole["key"], whole["set"] = keys, sets
        out = [by_bucket((keys >> top).astype(np.int64), SINGLE, whole)]
        if len(edges):
            out.append(([int(edges[0, 0]) % (1 << bits)], [MEMBER], [edges.tobytes()]))
        return packed(*out)

    def choose(batches):
        """The keys that a set keeps: all that it shares but the spare least, by bits set."""
        now, members, nodes = None, [], []
        held, size = [], 0

        def chosen():
            if not members or not nodes:
                return []
            raw = [(widen(r[: len(r) * 6 // 14]), np.frombuffer(r[len(r) * 6 // 14 :], np.uint64)) for r in members]
            keys = np.concatenate([x for _, x in raw])
            of, keys = distinct_pairs(np.concatenate([x for x, _ in raw]), keys >> np.uint64(3) | (keys & SEVEN) << np.uint64(61))
            sets = np.unique(np.frombuffer(b"".join(nodes), NODES))
            lo, hi = np.searchsorted(of, sets["node"], "left") + sets["spare"], np.searchsorted(of, sets["node"], "right")
            sets, lo, hi = (x[lo < hi] for x in (sets, lo, hi))
            many = hi - lo
            at = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
            return [(keys[at] << np.uint64(3) | keys[at] >> np.uint64(61), np.repeat(sets["set"], many))] if len(at) else []

        for b in batches:
            for bucket, kind, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    found = chosen()
                    held += found
                    size += sum(len(x) for x, _ in found)
                    now, members, nodes = bucket, [], []
                (nodes if kind == NODE else members).append(rows)
            if size >= TASK_KEYS:
                yield from send(*tie(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held, size = [], 0
        held += chosen()
        if held:
            yield from send(*tie(*(np.concatenate(c) for c in zip(*held, strict=True))))

    def meet(batches):
        now, met = None, []

        def edges_of():
            if not met:
                return []
            whole = np.frombuffer(b"".join(met), [("key", "<u8"), ("set", "<i8")])
            e = tie(whole["key"], whole["set"])[2]
            return [pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])] if len(e) else []

        for b in batches:
            for bucket, kind, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == MEMBER:
                    e = np.frombuffer(rows, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])
                    continue
                if bucket != now:
                    yield from edges_of()
                    now, met = bucket, []
                met.append(rows)
        yield from edges_of()

    known = shared_keys(docs, shingle, percent, bits)
    kept = known.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(choose), PACKED)
    return kept.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "a long, b long")


class Family:
    """Members of a family and which of them are known to be connected: at first those of one root."""

    def __init__(self, names: list[int], roots: list[int], found: list[np.ndarray], percent: int):
        order = sorted(range(len(names)), key=lambda i: (len(found[i]), names[i]))
        self.names, self.found, self.percent = [names[i] for i in order], [found[i] for i in order], percent
        first: dict[int, int] = {}
        self.part = np.array([first.setdefault(roots[i], at) for at, i in enumerate(order)])
        self.members: dict[int, list[int]] = {}
        for at, p in enumerate(self.part.tolist()):
            self.members.setdefault(p, []).append(at)

    def unite(self, i: int, j: int) -> None:
        a, b = int(self.part[i]), int(self.part[j])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            self.part[self.members[b]] = a
            self.members[a] += self.members.pop(b)

    def link(self) -> list[tuple[int, int]]:
        """(member, least member of its component) after comparing all that can link."""
        n = len(self.names)
        sizes = np.array([len(x) for x in self.found])
        owner = np.repeat(np.arange(n), sizes)
        _, token, count = np.unique(np.concatenate(self.found), return_inverse=True, return_counts=True)
        prefix = sizes - -(-self.percent * sizes // 100) + 1
        # a member's shingles, the rarest of the family first: its prefix holds one of any member that it links with
        order = np.lexsort((token, count[token], owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        used = order[rank < prefix[owner[order]]]
        used = used[count[token[used]] > 1]
        by_token = used[np.lexsort((owner[used], token[used]))]
        tokens, starts = np.unique(token[by_token], return_index=True)
        ends = np.append(starts[1:], len(by_token))
        holders = owner[by_token]
        own = used[np.argsort(owner[used], kind="stable")]
        bounds = np.searchsorted(owner[own], np.arange(n + 1))
        for i in range(n):
            mine = np.searchsorted(tokens, token[own[bounds[i] : bounds[i + 1]]])
            near = [holders[starts[t] : ends[t]] for t in mine.tolist() if ends[t] - starts[t] > 1]
            if not near:
                continue
            other = np.concatenate(near)
            other = other[(other < i) & (self.part[other] != self.part[i])]
            other = np.unique(other[sizes[other] * 100 >= self.percent * sizes[i]])
            for j in other[::-1].tolist():
                if self.part[i] != self.part[j]:
                    both = len(np.intersect1d(self.found[i], self.found[j], assume_unique=True))
                    if 100 * both >= self.percent * (sizes[i] + sizes[j] - both):
                        self.unite(i, j)
        least = {p: min(self.names[m] for m in ms) for p, ms in self.members.items()}
        return [(self.names[i], least[int(self.part[i])]) for i in range(n)]


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between linked members. rows: MEMBERS; each (family, one, two) comes whole to one task, and FAMILY bounds it."""

    def verify(batches):
        now, names, roots, found, seen = None, [], [], [], set()

        def done():
            if len(set(roots)) < 2:
                return []
            pairs = [(a, b) for a, b in Family(names, roots, found, percent).link() if a != b]
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])] if pairs else []

        for b in batches:
            for family, one, two, own, root, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (family, one, two) != now:
                    yield from done()
                    now, names, roots, found, seen = (family, one, two), [], [], [], set()
                if own not in seen:
                    seen.add(own)
                    names.append(own)
                    roots.append(root)
                    found.append(np.frombuffer(raw, np.uint64))
        yield from done()

    names = [x.split()[0] for x in MEMBERS.split(", ")]
    return rows.select(*names).repartition(shuffle_partitions(rows.sparkSession), "family", "one", "two").sortWithinPartitions("family", "one", "two").mapInArrow(lean(verify), "a long, b long")


def _largest(members: DataFrame, *by: str) -> DataFrame:
    """by, root: the component with most members."""
    counts = members.groupBy(*by, "root").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", "root")).alias("top")).select(*by, F.col("top.root").alias("root"))


def across_blocks(members: DataFrame, edges: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """More edges, for families of several blocks: after these, every two members that link are connected. members: family, blocks, block, own, found; edges: within blocks."""
    spark, paths = members.sparkSession, []

    def rooted(edges: DataFrame) -> DataFrame:
        found, path = components(edges)
        rows, rows_path = materialise_at(members.join(found, F.col("own") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "own").alias("root")), "rooted")
        discard(path, spark)
        paths.append(rows_path)
        return rows

    now = rooted(edges)
    inside = now.join(_largest(now, "family", "block"), ["family", "block", "root"])
    order = Window.partitionBy("family", "block").orderBy("own")  # a block's members, which FAMILY bounds
    reps = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPS)
    chain = reps.select("family", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("one"), F.lit(0).alias("two"), "own", "root", "found")
    more, path = materialise_at(verified(chain, percent), "chain")
    paths.append(path)
    edges = edges.unionByName(more)
    now = rooted(edges)
    largest = _largest(now, "family").withColumnRenamed("root", "largest")
    outside = now.join(largest, "family").where("root <> largest")
    sizes = outside.groupBy("family").agg(F.ceil(F.sum(F.octet_length("found") / 8) / (FAMILY / 2)).cast("int").alias("others"))
    sizes, path = materialise_at(sizes, "outside")
    paths.append(path)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    insiders = now.join(sizes, "family").select("family", F.col("block").alias("one"), each("others").alias("two"), "own", "root", "found")
    outsiders = outside.join(sizes, "family").select("family", each("blocks").alias("one"), F.pmod("own", "others").cast("int").alias("two"), "own", "root", "found")
    last, path = materialise_at(verified(insiders.unionByName(outsiders), percent), "outsiders")
    paths.append(path)
    return edges.unionByName(last), paths


def links(docs: DataFrame, unique: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, list[str]]:
    """(node, root): sets that link with others, and the least set of their component. unique: a row for each set, as linked() makes it."""
    spark = docs.sparkSession
    families, family_path = components(candidates(docs, shingle, percent))
    settle(spark)
    reps = unique.join(families, F.col("set") == F.col("node"))
    wanted, wanted_path = materialise_at(reps.select("rep.doc_id", "rep.h", "set", "n", F.col("root").alias("family")), "family-members")
    sizes = wanted.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    blocks = F.when(F.col("total") > FAMILY, F.ceil(F.col("total") / (FAMILY / 2))).otherwise(1).cast("int")
    sizes, sizes_path = materialise_at(sizes.where("members > 1").select("family", blocks.alias("blocks")), "families")
    dealt, dealt_path = materialise_at(wanted.join(sizes, "family"), "dealt")
    one_text = _texts(docs).hint("merge").join(dealt, ["doc_id", "h"]).select("family", "blocks", "set", "text")  # alike at every size

    def read(batches):
        done = set()  # rows equal in doc_id and text are one set; a later task may bring it again
        for b in slices(batches, 64):
            out = []
            for family, count, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own in done:
                    continue
                done.add(own)
                if len(done) > 1 << 17:
                    done.clear()
                out.append((family, count, own % count, own, shingles(text, shingle).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["family", "blocks", "block", "own", "found"])

    paths = [family_path, wanted_path, sizes_path, dealt_path]
    members = one_text.mapInArrow(lean(read), "family long, blocks int, block int, own long, found binary")
    several = sizes.where("blocks > 1").limit(1).count() > 0
    if several:
        members, path = materialise_at(members, "members")
        paths.append(path)
    edges = verified(members.select("family", F.col("block").alias("one"), F.lit(0).alias("two"), "own", F.col("own").alias("root"), "found"), percent)
    if several:
        edges, path = materialise_at(edges, "links")
        edges, more = across_blocks(members.where("blocks > 1"), edges, percent)
        paths += [path, *more]
    found, path = components(edges)
    for p in paths:
        discard(p, spark)
    return found, [path]


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (of the text), n_shingles, component_id (the smallest doc_id reachable by links). doc_id is NO_ID where it is null."""
    sets, _ = materialise_at(sets_of(docs, shingle), "sets")
    unique, _ = materialise_at(sets.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n")), "unique")
    found, _ = links(docs, unique, shingle, percent)
    roots = unique.join(found, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    per_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = roots.join(per_root, "root").select("set", "component_id")
    return sets.join(of_set, "set", "left").select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (of rows equal in it, one). Rows of no words link with nothing and all stay."""
    marked = linked(docs, shingle, percent)
    kept = marked.where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy("component_id").agg(F.min("h").alias("h")).select(F.col("component_id").alias("doc_id"), "h")
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.xxhash64(text_or_empty()).alias("__h")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *key, (~text_or_empty().rlike(r"[^\x20\x09-\x0D]")).alias("__bare"))
    chosen = rows.join(kept.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.lit(True).alias("__kept")), ["__id", "__h"], "left")
    # rows equal in doc_id and text: the first to come stays
    stays = chosen.where("__kept AND NOT __bare").groupBy("__id", "__h").agg(F.first("__row").alias("__row")).select("__row")
    return stays.unionByName(chosen.where("__bare").select("__row")).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
    back = lambda c: F.when(F.col(c) == NO_ID, F.lit(None).cast("long")).otherwise(F.col(c)).alias(c)
    return found.select(back("doc_id"), "n_shingles", back("component_id"))
