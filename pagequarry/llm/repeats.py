"""What finding repeated windows of texts has in common, whether a window is of words or of bytes.

Winnowing: the anchor of a window is its gram of least hash (the last of equal ones), which depends on
the window's content alone, so equal windows have equal anchors at the same place. Windows of a text
that share an anchor follow each other: they are a segment (lo to hi are its first and last window).
Only segments whose anchor occurs again in the corpus can hold a repeated window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, discard, materialise_at, settle, text_or_empty

SEGMENTS = "doc_id long, h long, anchor long, seg long, lo int, hi int"


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id (NO_ID where null), h (hash of the text) and the text in UTF-8: rows equal in doc_id and h are taken as equal."""
    body = text_or_empty(text)
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("text"))


def repeated_segments(segments: DataFrame) -> tuple[DataFrame, str]:
    """Those segments, materialised, whose anchor occurs more than once, and the path to discard."""
    spark = segments.sparkSession
    every, path = materialise_at(segments, "segments")
    # written, so that the join stands alone and Spark may split an anchor that very many texts share
    anchors, anchors_path = materialise_at(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = materialise_at(every.join(anchors, "anchor").select("doc_id", "h", "anchor", "seg", "lo", "hi"), "repeated")
    discard(path, spark)
    discard(anchors_path, spark)
    del every, anchors
    settle(spark)
    return found
