"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters (A-Z as a-z), digits, one repeated mark, and line ends. Each is hashed to
one of BUCKETS words. A word's index vector has NONZERO random signs in DIM places; its context
vector is the sum of the index vectors of its neighbours up to REACH away over the whole corpus
(random indexing). The word vector is both, the context part centred and scaled to length 1. The
table has a fixed size, whatever the corpus: each task adds up its own, the sums go through two
exchanges by blocks of the table, and only the finished table (4 MB) reaches the driver.

A document is the mean and the spread of its word vectors, with the logarithm of its tokens and the
share of different words. The network (HIDDEN tanh units) learns from at most MAX_LABELLED labelled
rows, those of least hash, and never from held-out ones; a sixth of them is kept from it to fit the
temperature by which its logits are divided, so that scores are probabilities.

Defined cases: null text counts as empty; an empty text is the zero vector and gets a score too; a
null doc_id is held out; repeated rows are scored each for itself; labels that are null, or of no
document, are ignored; without labels of both kinds every score is the smoothed share of label 1; an
empty table gives an empty one; other columns are never read. A run of one kind longer than a block of
1 MB is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, text_or_empty
from .grams import BLOCK, FOLD, slices, span_hashes

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 64, 2, 2
HIDDEN, EPOCHS, MAX_LABELLED = 32, 40, 20_000
TABLE_BLOCKS = 64
WIDTH = 2 * (2 * DIM) + 2
THRESHOLD = 0.3
_RNG = np.random.Generator(np.random.PCG64(77))
PLACES = _RNG.integers(0, DIM, (BUCKETS, NONZERO))
SIGNS = _RNG.choice(np.array([-1, 1], np.int64), (BUCKETS, NONZERO))
# Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 line ends, and each other mark its own.
_KIND = np.arange(256, dtype=np.int16) + 10
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def tokens(text: bytes) -> np.ndarray:
    """The buckets of a text's tokens, in order."""
    out = []
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            spaces = np.flatnonzero(_KIND[data[end - 4096 : end]] == 0)
            end = end - 4096 + int(spaces[-1]) + 1 if len(spaces) else end
        part = data[at:end]
        kind = _KIND[part]
        starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(part)]))
        real = kind[starts] > 0
        out.append((span_hashes(FOLD[part], starts[real], ends[real]) >> np.uint64(50)).astype(np.int64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_contexts(table: np.ndarray, found: list[np.ndarray]) -> None:
    """Add to table (BUCKETS x (DIM + 1), the last column counts) what the documents' tokens say."""
    flat = table.reshape(-1)
    gap = np.full(REACH, -1, np.int64)  # keeps neighbours within a document
    line = np.concatenate([x for t in found for x in (t, gap)]) if found else gap
    own = line[line >= 0]
    np.add.at(flat, own * (DIM + 1) + DIM, 1)
    for d in range(1, REACH + 1):
        left, right = line[:-d], line[d:]
        both = (left >= 0) & (right >= 0)
        left, right = left[both], right[both]
        for a, b in ((left, right), (right, left)):
            for j in range(NONZERO):
                np.add.at(flat, a * (DIM + 1) + PLACES[b, j], SIGNS[b, j])


def corpus_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context sums and counts of all documents."""
    per = BUCKETS // TABLE_BLOCKS
    schema = "block int, task int, sums binary"

    def emit(table, task):
        return pa.RecordBatch.from_arrays([pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array([task] * TABLE_BLOCKS, pa.int32()), pa.array([table[i * per : (i + 1) * per].tobytes() for i in range(TABLE_BLOCKS)], pa.binary())], names=["block", "task", "sums"])

    def count(batches):
        from pyspark import TaskContext

        table = np.zeros((BUCKETS, DIM + 1), np.int64)
        for b in slices(batches):
            count_contexts(table, [tokens(t) for t in b.column(0).to_pylist()])
        if table.any():
            yield emit(table, TaskContext.get().partitionId())

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = np.frombuffer(raw, np.int64)
                sums[block] = sums[block] + got if block in sums else got
        for block, got in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["block", "task", "sums"])

    parts = docs.select(text_or_empty(text).cast("binary")).mapInArrow(count, schema)
    some = parts.repartition(shuffle_partitions(docs.sparkSession), "block", F.col("task") % 32).mapInArrow(add, schema)
    table = np.zeros((TABLE_BLOCKS, per * (DIM + 1)), np.int64)
    for r in some.repartition("block").mapInArrow(add, schema).collect():  # TABLE_BLOCKS rows of fixed size
        table[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return table.reshape(BUCKETS, DIM + 1)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """BUCKETS x 2 DIM: index vector, and context vector centred by the corpus mean and scaled."""
    counts, sums = table[:, DIM:].astype(np.float64), table[:, :DIM].astype(np.float64)
    means = sums / np.maximum(counts, 1)
    means -= sums.sum(0) / max(counts.sum(), 1)
    means[counts[:, 0] == 0] = 0
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    index = np.zeros((BUCKETS, DIM))
    np.add.at(index, (np.arange(BUCKETS)[:, None], PLACES), SIGNS / math.sqrt(NONZERO))
    return np.concatenate([index, means], 1).astype(np.float32)


def pool(found: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's vector of WIDTH numbers."""
    out = np.zeros(WIDTH, np.float32)
    if len(found):
        which, n = np.unique(found, return_counts=True)
        share = (n / len(found)).astype(np.float32)
        rows = vectors[which]
        mean = share @ rows
        out[: 2 * DIM] = mean
        out[2 * DIM : 4 * DIM] = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
        out[-2:] = math.log1p(len(found)), len(which) / len(found)
    return out


def document_vectors(docs: DataFrame, vectors: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and vector (WIDTH little-endian floats)."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # of a fixed size: BUCKETS x 2 DIM floats
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(f"`{text}`").cast("binary").alias("__text"))

    def make(batches):
        for b in slices(batches):
            made = pa.array([pool(tokens(t), sent.value).tobytes() for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], "vector"])

    return rows.mapInArrow(make, rows.drop("__text").schema.add("vector", "binary"))


class Network:
    """Standardised inputs, HIDDEN tanh units, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.constant = (float(y.sum()) + 1) / (len(y) + 2)
        self.known = len(y) >= 12 and 0 < y.sum() < len(y)
        if not self.known:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        order = rng.permutation(len(y))
        check, learn = order[: len(y) // 6], order[len(y) // 6 :]
        self.mean, self.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
        z = self._scaled(x)
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,))
        self.w = [rng.normal(0, 1 / math.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        self.w[3] = np.array([math.log(self.constant / (1 - self.constant))])
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(EPOCHS):
            rate = 0.003 * (1 - epoch / EPOCHS) + 1e-4
            rows = rng.permutation(learn)
            for i in range(0, len(rows), 128):
                a, t = z[rows[i : i + 128]], y[rows[i : i + 128], None]
                h = np.tanh(a @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - t) / len(t)
                dh = d @ self.w[2].T * (1 - h * h)
                step += 1
                for k, g in enumerate((a.T @ dh + 1e-3 * self.w[0] / len(t), dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits, truth = self.logits(x[check]), y[check]
        loss = lambda t: float(np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean())
        self.temperature = min((2 ** (i / 8) for i in range(-16, 33)), key=loss)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(vectors: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> Network:
    """From the labelled rows that aren't held out, at most limit of them, those of least hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > limit:  # so few that what reaches the driver doesn't grow with the tasks
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.1 * limit / n))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    # at most limit rows of 12 bytes
    rows = vectors.where(~held_out()).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "vector").limit(limit).select("vector", "label").collect()
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float64).reshape(len(rows), WIDTH)
    return Network(x, np.array([r["label"] > 0 for r in rows], np.float64))


def score(vectors: DataFrame, network: Network) -> DataFrame:
    """vectors' other columns and score."""
    at = vectors.columns.index("vector")
    schema = vectors.drop("vector").schema.add("score", "double")

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(at).to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(network.scores(x))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    vectors = materialise(document_vectors(docs, word_vectors(corpus_table(docs))), "vectors")
    scored = score(vectors, fit(vectors, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
