"""New database files as a stream. Decoding has no state, so the decoders apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.page import decode_pages
from ..sources.pages import binary_pages


def stream_pages(spark: SparkSession, path: str, start_page: int = 1, files_per_trigger: int = 16) -> DataFrame:
    """Decoded pages of the files in a folder, and of those that come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode_pages(binary_pages(files.select("path", "content"), start_page))
