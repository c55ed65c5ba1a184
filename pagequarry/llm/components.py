"""Connected components of an edge table, by rounds of joins; nothing meets on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise_at, settle


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges: a, b (long). Returns (node, root), root being the least node of node's component, and the path to discard.

    Large-star and small-star steps in turn, until a pair of them changes nothing: every node links
    its larger neighbours, then its smaller ones, to the least of them. The number of rounds grows
    with the logarithm of the nodes; an edge table is written in each and the one before goes.
    """
    spark = edges.sparkSession
    now, path = materialise_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        before = _sum(now)
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = materialise_at(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after, next_path = materialise_at(small, "edges")
        for p in (path, large_path):
            discard(p, spark)
        now, path = after, next_path
        if _sum(now) == before:
            break
    settle(spark)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = roots.union(roots.select("root", "root").distinct())
    return found, path


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
