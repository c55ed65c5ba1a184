"""Each operator against a plain version, on odd rows, and on an empty table."""

import base64
import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from pagequarry.llm import bpe, classifier, components, jaccard_join, mixing, order_minhash, quality_rules, registry, sharding, substring_dedup, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, key string, slot string"


def odd_rows():
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    a, b = docs[5][1], docs[9][1]
    rng = random.Random(3)
    near = []
    for i in range(12):
        w = a.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{i}"
        near.append((300 + i, " ".join(w)))
    odd = [(None, a), (None, None), (70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "One  "), (75, "é" * 900), (76, "abc " * 700), (77, a), (77, b + " " + b), (78, "😀 " * 60), (79, "w" * 3000), (80, "'" * 50 + "ll 've\n\n   x " * 90), (80, "tie")]
    return docs + near + odd + docs[:3]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    source = lambda i: (None, "b", "a", "ß", "")[i % 5]
    return spark.createDataFrame([(d, t, "en", source(i), None, 1, 2, "k", "s") for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(tuple, got), key=brute.key) == sorted(want, key=brute.key)


def test_quality(docs, rows, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_rules.judge(quality_rules.measure(docs, keep=("doc_id",)))
    same(judged.select(*names).collect(), [(d, *brute.quality(t)) for d, t in rows])
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    assert quality_rules.quality_filter(empty).count() == 0
    assert set(quality_rules.measure(docs.withColumn("n_words", F.lit("x"))).columns) == {*docs.columns, *quality_rules.MEASURES}


def test_quality_keeps_what_is_labelled_good(spark):
    judged = quality_rules.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    good = judged.where("quality = 1")
    assert good.where("kept").count() >= 0.99 * good.count()


def tokenised(rows):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, brute.sha(ids), brute.sha((t or "").encode())))
    return want


def test_bpe(docs, rows, empty):
    want = tokenised(rows)
    same(bpe.digests(docs).collect(), want)
    same(bpe.digests(docs, chunk_chars=40, overlap_chars=6).collect(), want)
    assert bpe.digests(empty).count() == 0


def test_very_long_texts(spark):
    """Texts of 200,000 characters and more, with settings as they are: each operator against its plain version."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    a = "\n".join(line(12) for _ in range(3000))
    rows = [(1, a), (2, a[:150_000] + line(9000)), (3, a.replace("\n", " ", 3)), (4, "x" * 60_000 + " '" * 20_000), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    judged = quality_rules.judge(quality_rules.measure(df, keep=("doc_id",)))
    same(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), [(d, *brute.quality(t)) for d, t in rows])
    same(bpe.digests(df).collect(), tokenised(rows))
    same(suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.suffix(rows, 400))
    same(substring_dedup.judged(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substring(rows, 50))
    same(jaccard_join.linked(df, 5, 80).select("doc_id", "n_shingles", "component_id").collect(), brute.jaccard(rows, 5, 80))
    got = {r.doc_id: r for r in order_minhash.succession_marks(df).collect()}
    assert got[3].edited_sha256 == brute.sha((rows[2][1][: len(rows[2][1]) - len(rows[2][1]) // 2] + rows[1][1][: len(rows[2][1]) // 2]).encode()) and got[3].n_chars == len(rows[2][1])
    assert mixing.curriculum(mixing.materialise(mixing.sized(df.withColumn("source", F.lit("s"))), "t")).agg(F.sum("size")).first()[0] == sum(len(brute.words(t)) for _, t in rows)


def test_warc(spark, tmp_path):
    pages = [(1, "a"), (2, "b" * 3_000_000), (3, "a"), (4, ""), (5, None), (6, "\r\n\r\nWARC/1.1\r\n"), (7, "é\0")]
    df = spark.createDataFrame([(p, f"http://x/{p}", h, 1) for p, h in pages], "page_id long, url string, html string, digest int")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(warc.round_trip(df).select(*names).collect(), brute.warc(pages))
    manifest = warc.write_warc(df, f"file://{tmp_path}/w")
    chunks = warc.read_warc(manifest, 1 << 20).where("page_id = 2").orderBy("chunk_no").collect()
    assert len(chunks) > 1 and b"".join(c.data for c in chunks) == b"b" * 3_000_000
    twice = spark.createDataFrame([(1, None, "z")] * 3 + [(None, "u", "z")], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(twice).select("page_id", "record_type", "refers_to").collect()), key=brute.key)
    assert got == [(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1)]
    assert warc.round_trip(df.limit(0)).count() == 0
    same(warc.round_trip(df.repartition(4), min_bytes=2).select(*names).collect(), [(p, n, d, "response" if n < 2 else kind, None if n < 2 else to) for p, n, d, kind, to in brute.warc(pages)])


def test_warc_large_and_hot(spark, tmp_path):
    """Payloads of many chunks in several tasks, copies of one in all of them, and archives that roll over."""
    pages = [(i, "hot " * 700_000 if i % 3 == 0 else f"{i} é " * 400_000) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit(None)).repartition(5)
    manifest = warc.write_warc(df, f"file://{tmp_path}/w", chunk_bytes=100_000, archive_bytes=10_000)
    assert manifest.count() > 5
    chunks = warc.read_warc(manifest, 100_000)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 100_000 + warc.READ_BYTES
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(chunks.where("last").select(*names).collect(), brute.warc(pages))


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans")
    out = lambda **how: suffix_dedup.dedup(docs, **how).select(*names, F.sha2("kept", 256)).collect()
    want = brute.suffix(rows, 400)
    same(out(), want)
    same(out(symbol=200, batch=2000), want)
    same(out(symbol=8), want)
    same(out(group=2), want)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    same(out(), want)
    assert suffix_dedup.dedup(empty).count() == 0


def test_sharding(spark, docs, rows, empty, tmp_path):
    got = sharding.assign(docs, cell_rows=5).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"}
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    many = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(6000)], "doc_id long, text string")
    sizes = sharding.assign(many, cell_rows=50).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    assert sharding.assign(empty).count() == 0
    whole = sharding.shard_documents(many, str(tmp_path / "shards"), 4)
    assert whole.count() == 6000 and whole.select("shard").distinct().count() == 4


def test_sharding_of_documents(spark):
    """Sizes and checksums worked out anew; shards near equal; equal texts in one shard."""
    text = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = sharding.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    shards, places = collections.Counter(), collections.defaultdict(set)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        shards[r.shard] += r.size
        places[raw].add(r.shard)
    mean = sum(shards.values()) / 24
    largest = max(len((t or "").encode()) for t in text.values())
    assert sorted(shards) == list(range(24)) and max(abs(s - mean) for s in shards.values()) <= 0.01 * mean + largest
    assert all(len(p) == 1 for p in places.values())


def test_substring_dedup(spark, docs, rows, empty):
    names = ("doc_id", "n_words", "n_removed")
    want = brute.substring(rows, 50)
    for how in ({}, {"group": 2}):
        same(substring_dedup.judged(docs, **how).select(*names, F.sha2("kept", 256)).collect(), want)
    kept = substring_dedup.dedup_documents(docs)
    left = sorted(" ".join(x for x, y in zip(w, g, strict=True) if not y) for w, g in brute.substring_marks(rows, 50) if not w or not all(g))
    assert kept.columns == docs.columns and sorted(" ".join(brute.words(r.text)) for r in kept.collect()) == left
    white = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50))), (2, " ".join([*(f"w{i}" for i in range(50)), "\u00a0"]))], "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup_documents(white).select("doc_id", F.trim("text")).collect())) == [(1, white.first().text), (2, "\u00a0")]
    assert substring_dedup.judged(empty).count() == 0 and substring_dedup.dedup_documents(empty).count() == 0


@pytest.mark.parametrize(("k", "percent", "family"), [(3, 90, 4_000_000), (5, 80, 4_000_000), (5, 80, 2_000)])
def test_jaccard(docs, rows, monkeypatch, k, percent, family):
    monkeypatch.setattr(jaccard_join, "FAMILY", family)
    monkeypatch.setattr(jaccard_join, "REPS", 64 if family > 2_000 else 2)
    back = lambda x: None if x == brute.BIG else x
    got = [(back(r.doc_id), r.n_shingles, back(r.component_id)) for r in jaccard_join.linked(docs, k, percent).collect()]
    want = brute.jaccard(rows, k, percent)
    same(got, want)
    if family > 2_000:
        groups = len({c for _, n, c in want if n}) + sum(n == 0 for _, n, _ in want)
        assert jaccard_join.keep_one(docs, k, percent).count() == groups


def kept_in_common(sets, percent):
    """Whether two sets keep an equal key of those that they alone share; and where others have every key of theirs."""
    bands, order = jaccard_join.Bands(percent), lambda k: (int(k) & 7, int(k) >> 3)
    alone = crowd = False
    for band in set(bands.of(len(sets[0]))) & set(bands.of(len(sets[1]))):
        (a, drop_a), (b, drop_b) = (jaccard_join.part_keys(np.sort(x), band, bands.parts(band), bands.spare(len(x), band)) for x in sets)
        alone |= max(drop_a, drop_b) < len(np.intersect1d(a, b))
        crowd |= bool(set(sorted(a.tolist(), key=order)[drop_a:]) & set(sorted(b.tolist(), key=order)[drop_b:]))
    return alone and crowd


@pytest.mark.parametrize(("percent", "pairs", "largest"), [(50, 2000, 60), (80, 50_000, 40), (90, 50_000, 60), (80, 2000, 400), (90, 2000, 400)])
def test_kept_keys_meet(percent, pairs, largest):
    """Two sets that just link keep an equal key, whether only they share their keys or everyone does."""
    rng, met = np.random.default_rng(percent + largest), 0
    for _ in range(pairs):
        size = int(rng.integers(1, largest))
        union = rng.integers(0, 2**63, size, dtype=np.uint64)
        apart = rng.permutation(size)[: size * (100 - percent) // 100]
        cut = len(apart) if rng.random() < 0.5 else int(rng.integers(0, len(apart) + 1))  # all of one side, as where a text ends early
        sets = [np.delete(union, part) for part in (apart[:cut], apart[cut:])]
        assert kept_in_common(sets, percent), (size, len(apart), cut)
        met += len(apart) > 0
    assert met > pairs // 2


def test_a_text_without_its_end(spark):
    """Few parts, of which one side has more without bits: 14 and 12 shingles, 85.7 % alike."""
    words = "w649436522 w975586379 w326132141 w768311324 w778490682 w266182824 w236137202 w65205990 w824617674 w730847581 w229081048 w244161611 w8947218 w805501375 w378030364 w597095094 w304188409 w729337381".split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-2])), (3, "other words that no one else has")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.linked(docs, 5, 80).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_shared_keys_across_tasks(spark, rows):
    """Sets that link are tied to each other, whichever tasks they are in."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute.jaccard(rows, 5, 80)
    docs = spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("text", StringType())])).repartition(7, F.rand(1))
    edges = [(r.a, r.b) for r in jaccard_join.candidates(docs, 5, 80).collect()]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    of = {}
    for (_, n, c), (_, t) in zip(want, rows, strict=True):
        if n:
            of.setdefault(c, set()).add(top(jaccard_join.identity(jaccard_join.shingles(t.encode(), 5))))
    assert all(len(x) == 1 for x in of.values())


def test_jaccard_empty(empty):
    assert jaccard_join.linked(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    found, _ = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_classifier(spark, docs, rows, empty):
    got = classifier.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored = classifier.classify(docs, labels).toPandas()
    assert len(scored) == len(rows) and scored.score.between(0, 1).all()
    assert classifier.classify(empty, labels).count() == 0


def test_order_minhash(docs, rows, empty, spark):
    unique = {d: t or "" for d, t in rows if d is not None and d < 60}
    df = spark.createDataFrame(list(unique.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in order_minhash.succession_marks(df, 5).collect()}
    ids = sorted(unique, reverse=True)
    for i, d in enumerate(ids):
        t, after = unique[d], unique[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mark, other = order_minhash.fingerprint(t.encode()), order_minhash.fingerprint(after.encode())
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) == (len(t), brute.sha(edited.encode()), order_minhash.written(mark), order_minhash.likeness(mark, other))
        assert r.near_edited == order_minhash.likeness(mark, order_minhash.fingerprint(edited.encode()))
    assert order_minhash.succession_marks(docs, 4).count() == len(rows)
    assert order_minhash.succession_marks(empty, 4).count() == 0
    one = order_minhash.succession_marks(df.limit(1), 4).collect()
    assert len(one) == 1 and order_minhash.fingerprints(docs).count() == len(rows)


def test_order_minhash_against_plain(rows):
    texts = {(t or "").encode() for _, t in rows[:20]} | {b"", b"a", b"abcdefgh", b"abc " * 3000}
    for t in texts:
        assert order_minhash.written(order_minhash.fingerprint(t)) == brute.order_minhash(t, order_minhash.K, order_minhash._XOR[:, 0].tolist(), order_minhash._ODD[:, 0].tolist())


def test_likeness_falls_with_edits(rows):
    """The more words change, the less alike; and texts of the same parts in another order are not alike."""
    rng, near = random.Random(4), []
    words = " ".join(t for _, t in rows[:12]).split()[:1200]
    mark = lambda ws: order_minhash.fingerprint(" ".join(ws).encode())
    for share in (0, 0.01, 0.05, 0.2, 0.6):
        likes = []
        for _ in range(5):
            changed = [f"z{rng.randrange(9999)}" if rng.random() < share else w for w in words]
            likes.append(order_minhash.likeness(mark(words), mark(changed)))
        near.append(sum(likes) / 5)
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.7 and near[4] < 0.2
    turned = [w for i in range(1100, -1, -100) for w in words[i : i + 100]]
    assert order_minhash.likeness(mark(words), mark(turned)) < 0.75


def test_order_minhash_ranges(spark):
    """Without doc_ids, or with one for all, ranges are cut by the text's hash; each row still has just one next."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (i % 40 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    many = order_minhash.ranges(df, 16).where("role = 0").groupBy("part").count().collect()
    assert len(many) >= 12 and max(r["count"] for r in many) < 200
    one, several = (sorted(map(tuple, order_minhash.succession_marks(df, n).collect()), key=brute.key) for n in (1, 16))
    assert one == several and len(one) == 600


def test_classifier_against_plain(spark, rows):
    texts = [(t or "").encode() for _, t in rows[:15]]
    hash_of = lambda w: int(classifier.span_hashes(classifier.FOLD[np.frombuffer(w, np.uint8)], np.array([0]), np.array([len(w)]))[0] >> np.uint64(50))
    want = brute.contexts(texts, hash_of, classifier.BUCKETS, classifier.PLACES, classifier.SIGNS, classifier.REACH)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert (classifier.corpus_table(df) == want).all()
    vectors = classifier.word_vectors(want)
    found = classifier.tokens(texts[3])
    mean = sum(vectors[w].astype(float) for w in found) / len(found)
    spread = (sum((vectors[w] - mean) ** 2 for w in found) / len(found)) ** 0.5
    assert np.allclose(classifier.pool(found, vectors)[:-2], np.concatenate([mean, spread]), atol=1e-4)


def test_mixing(docs, rows, empty):
    got = mixing.curriculum(mixing.materialise(mixing.sized(docs), "t")).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source_key").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (per.target <= 2 * per["size"]).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_documents(empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    names = df.columns
    same(df.collect(), con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall())
