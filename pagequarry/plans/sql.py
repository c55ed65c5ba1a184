"""Temporary SQL views and functions over database files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.labels import FINGERPRINTS, NAMED_FLAGS, PAGE_FLAGS, STATES
from ..operators.entries import entries, parse_issues, tree_pages
from ..operators.header import decode_headers
from ..operators.page import decode_pages, page_tags
from ..sources.pages import read_headers, read_pages


#: HotSpot interprets methods of more bytes than this; Spark then makes several smaller ones of a projection.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def compiled(spark: SparkSession) -> SparkSession:
    """The session, with wide decoding projections cut into methods that get compiled; a limit that it has stays."""
    name, most = METHOD_LIMIT
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)
    return spark


def register_views(spark: SparkSession, path: str, mode: str = "PERMISSIVE", **options) -> None:
    """db_header, page, page_tag, page_entry and parse_issue of the files at path; the session is compiled()."""
    compiled(spark)
    decode_headers(read_headers(spark, path), mode=mode).createOrReplaceTempView("db_header")
    pages = decode_pages(read_pages(spark, path, **options), mode)
    trees = tree_pages(pages)
    pages.createOrReplaceTempView("page")
    page_tags(pages).createOrReplaceTempView("page_tag")
    entries(trees).where("error IS NULL").drop("error").createOrReplaceTempView("page_entry")
    parse_issues(trees).createOrReplaceTempView("parse_issue")


def _functions() -> dict[str, str]:
    labels = " ".join(f"WHEN version = {v} AND revision = {r} THEN '{n}'" for (v, r), n in FINGERPRINTS.items())
    states = " ".join(f"WHEN {c} THEN '{n}'" for c, n in STATES.items())
    flags = ", ".join(f"IF(flags & {PAGE_FLAGS[n]} > 0, '{n}', NULL)" for n in NAMED_FLAGS)
    byte = lambda i: f"CAST(conv(hex(substring(b, {i + 1}, 1)), 16, 10) AS INT)"
    valid = " AND ".join(f"{byte(i)} < {most}" for i, most in enumerate((60, 60, 24, 31, 12)))
    ticks = f"(((CAST(datediff(make_date({byte(5)} + 1900, {byte(4)} + 1, 1), DATE'1601-01-01') AS BIGINT) + {byte(3)}) * 24 + {byte(2)}) * 3600 + {byte(1)} * 60 + {byte(0)}) * 10000000"
    return {
        "ese_page_offset(n BIGINT, page_size BIGINT) RETURNS BIGINT": "(n + 1) * page_size",
        "ese_fingerprint(version BIGINT, revision BIGINT) RETURNS STRING": f"CASE {labels} ELSE 'Other' END",
        "ese_state(code BIGINT) RETURNS STRING": f"CASE code {states} ELSE 'Unknown' END",
        "ese_page_flags(flags BIGINT) RETURNS ARRAY<STRING>": f"array_compact(array({flags}))",
        "ese_filetime(b BINARY) RETURNS BIGINT": f"CASE WHEN octet_length(b) >= 8 AND {valid} THEN {ticks} END",
    }


def register_functions(spark: SparkSession) -> list[str]:
    for head, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in _functions()]
