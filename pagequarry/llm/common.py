"""What the corpus operators share: the shared scratch folder, materialised steps, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: doc_id of a row without one: it sorts after every other.
NO_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset one of our own if all run in this process (else an error)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/pagequarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an int that repartition(n, column) sends to it: rows with a number of their own go just there."""
    found: dict[int, int] = {}
    size = 24 * n + 64
    while len(found) < n:
        at = spark.range(size).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
        found = {r["p"]: r["k"] for r in at.collect()}
        size *= 2
    return [found[p] for p in range(n)]


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done and whose frames are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df_path: str, spark: SparkSession) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialise(), and the path to discard()."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
