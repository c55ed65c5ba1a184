"""run() against plain versions of its stages."""

import collections

import duckdb

import brute
import corpus_pipeline
from pagequarry.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        if i < 4:
            assert docs.columns == columns
        out.append(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    assert {r.doc_id for r in out[0].collect()} == kept
    rows = [(r.doc_id, r.text) for r in out[0].collect()]
    assert {r.doc_id for r in out[1].collect()} == {c for _, n, c in brute.jaccard(rows, 5, 80) if n}
    rows = [(r.doc_id, r.text) for r in out[1].collect()]
    want = {d: [x for x, y in zip(w, g, strict=True) if not y] for (d, _), (w, g) in zip(rows, brute.substring_marks(rows, 50), strict=True)}
    got = {r.doc_id: brute.words(r.text) for r in out[2].collect()}
    assert got == {d: w for d, w in want.items() if w}
    copies = collections.Counter(r.doc_id for r in out[3].collect())
    planned = {r.doc_id: r.copies for r in mixing.curriculum(mixing.materialise(mixing.sized(out[2]), "test")).collect() if r.copies}
    assert copies == planned
    assert collections.Counter(r.doc_id for r in out[4].collect()) == copies
    text = {r.doc_id: r.text for r in out[3].collect()}
    assert all(r.decoded_sha256 == brute.sha(text[r.doc_id].encode()) for r in out[4].collect())


def test_stages_of_odd_tables(spark):
    """An empty table, and one with nulls, repeated rows, and columns named like those that stages make."""
    own = "doc_id long, text string, lang string, source string, n_chars long, size long, position double, spans string, row int, n_words int, token_ids string, __extra int"
    text = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, text, "en", "a", 5, 1, 0.5, "s", 1, 1, "t", 1)] * 2 + [(None, text + " more", None, None, None, None, None, None, None, None, None, None), (2, None, "en", None, 0, 1, 0.5, "s", 1, 1, "t", 1), (None, None, None, None, None, None, None, None, None, None, None, None), (3, "the end of " * 3 + "all that is new", "en", "b", 9, 1, 0.5, "s", 1, 1, "t", 1)]
    for data, some in (([], False), (rows, True)):
        docs = spark.createDataFrame(data, own)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "odd")
            assert (docs.count() > 0) == some and (i == 4 or docs.columns == columns)
