"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a ramp: its weight at time t of the training (0 to 1) is
``weight * (start + (end - start) * t)``, with start + end = 2, so the integral over the training is
the weight. The mix takes ``share`` times all words; a source's part follows its integrated weight
but stops at ``cap`` times the source's words, and the excess goes to the others by weight
(water filling, solved in closed form over the sources' sorted cap-to-weight ratios). Inside a
source documents stand in the order of a hash of their id. Their cumulative words, over as many
passes as the target needs, are put through the inverse of the source's cumulative demand: that is
the position of each in the training, and the documents are range-sorted by it.

Running sums are taken in two levels (hash bins of a source, then rows of a bin), so a source that
holds a third of the corpus is spread over BINS tasks, and nothing but a row per source meets in one.

Defined cases: null text has size 0; null source is a source of its own, last in order; sources of
no words get target 0; null or repeated doc_ids are ordered by size, equal rows are
interchangeable; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, WORD, materialise, text_or_empty

WEIGHTS = (3, 1, 2)
#: start of the ramp for each weight in turn (the end is 2 - start): heavy sources come late, light ones early.
RAMP_STARTS = (0.5, 1.5, 1.0)
SHARE, CAP = 1.5, 2
#: Hash digits that name a bin of a source: 16**3 bins.
BIN_DIGITS = 3


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("key"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"),
    ).withColumn("bin", F.substring("key", 1, BIN_DIGITS))


def targets(bins: DataFrame, weights: tuple = WEIGHTS, starts: tuple = RAMP_STARTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row for each source: source_key, source_size, target, ramp_start. bins: source, source_key, bin, bin_size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "source_key")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.row_number().over(by_name) - 1) % len(values) + 1).cast("int"))
    sources = bins.groupBy("source", "source_key").agg(F.sum("bin_size").alias("source_size"))
    ranked = sources.select("*", pick([float(w) for w in weights]).alias("weight"), pick([float(s) for s in starts]).alias("ramp_start"))
    ranked = ranked.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("all"),
        F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weights"),
    ).withColumn("level", (F.col("all") - F.col("capped")) / F.col("weights"))
    water = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    return summed.withColumn("water", water).select(
        "source_key",
        "source_size",
        F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("most")).otherwise(F.col("water") * F.col("weight")).alias("target"),
        "ramp_start",
    )


def curriculum(rows: DataFrame, **mix) -> DataFrame:
    """rows: sized(docs), materialised. Adds source_size, target, taken (words, repeats counted), copies (whole documents), position."""
    bins = rows.groupBy("source", "source_key", "bin").agg(F.sum("size").alias("bin_size"))
    before = F.sum("bin_size").over(Window.partitionBy("source_key").orderBy("bin")) - F.col("bin_size")
    offsets = bins.select("source", "source_key", "bin", "bin_size").withColumn("before", before).drop("source", "bin_size")
    placed = offsets.join(targets(bins, **mix), "source_key")
    inner = F.sum("size").over(Window.partitionBy("source_key", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.join(placed, ["source_key", "bin"]).withColumn("start", F.col("before") + inner - F.col("size"))
    budget = F.floor("target")
    part = lambda p: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("start") - F.col("source_size") * p))
    whole = lambda p: ((F.col("start") + F.col("source_size") * p) * 2 + F.col("size") < budget * 2).cast("int")
    slope = (F.lit(1.0) - F.col("ramp_start")) * 2

    def time(p: int):
        u = (F.col("start") + F.col("source_size") * p + F.col("size") / 2) / F.col("target")
        return F.when(slope == 0, u).otherwise((F.sqrt(F.col("ramp_start") * F.col("ramp_start") + slope * 2 * u) - F.col("ramp_start")) / slope)

    return (
        at.withColumn("taken", part(0) + part(1))
        .withColumn("copies", F.when(F.col("size") > 0, whole(0) + whole(1)).otherwise(0))
        .withColumn("position", F.when(F.col("taken") > 0, time(0)))
        .withColumn("again", F.when(F.col("taken") > F.col("size"), time(1)))
    )


def mix_documents(docs: DataFrame, **mix) -> DataFrame:
    """The documents of the mix, range-sorted into training order: whole documents, a row for each time that one is taken, with the columns of docs.

    A document that the budget of its source cuts is taken whole if more than half of it fits. Rows
    equal in doc_id, source and size share what is taken of them evenly.
    """
    rows = materialise(sized(docs), "mix")
    plan = curriculum(rows, **mix).where("copies > 0").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("source_key").alias("__source"), F.col("size").alias("__size"))
    plan = plan.agg(F.ceil(F.sum("copies") / F.count("*")).alias("__copies"), F.min("position").alias("__first"), F.min("again").alias("__again"))
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("__size"),
    )
    at = F.explode(F.when(F.col("__copies") > 1, F.array("__first", F.coalesce("__again", "__first"))).otherwise(F.array("__first"))).alias("__position")
    return keyed.join(plan, ["__id", "__source", "__size"]).select("__row", at).repartitionByRange("__position").sortWithinPartitions("__position").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    rows = materialise(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix")
    return curriculum(rows).select("doc_id", "size", "source_size", "target", "taken", "position", "key").orderBy(F.col("position").asc_nulls_last(), "key").drop("key")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, CASE (r - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS a, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, most / weight AS ratio, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, (SELECT max(level) FROM l WHERE ratio > level) AS water FROM l),
g AS (SELECT source, source_size, a, CASE WHEN water IS NULL OR ratio <= water THEN most ELSE water * weight END AS target FROM t),
o AS (SELECT d.*, source_size, target, a, floor(target)::BIGINT AS b, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS c FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, greatest(0, least(size, b - c)) + greatest(0, least(size, b - c - source_size)) AS taken, CASE WHEN target > 0 THEN (c + size / 2) / target END AS u FROM o)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN CASE WHEN a = 1.0 THEN u ELSE (sqrt(a * a + (1.0::DOUBLE - a) * 2 * 2 * u) - a) / ((1.0::DOUBLE - a) * 2) END END AS position FROM x"""
