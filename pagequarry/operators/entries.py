"""Tree pages: which kind a page is, its root header, and its entries."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import first_error, piece, settled, u8, u16, u32
from ..functions.labels import has_flag, is_branch
from .page import tag_payload

#: Revision from which a root header may have 25 bytes.
LONG_ROOT_REVISION = 0x14
COMMON_KEY_FLAG = 4


def page_kind(flags: Column | str = "page_flags") -> Column:
    """Branch, then Leaf, then Root; NULL for others."""
    return F.when(is_branch(flags), F.lit("Branch")).when(has_flag(flags, "Leaf"), F.lit("Leaf")).when(has_flag(flags, "Root"), F.lit("Root"))


def root_header(data: Column, revision: Column) -> tuple[Column, Column]:
    """(header, error) of a root page's first payload: 16 bytes, or 25 whose last three fields stand one byte later."""
    size = F.octet_length(data)
    long = (size == 25) & (revision >= LONG_ROOT_REVISION)
    shift = F.when(long, F.lit(1)).otherwise(F.lit(0))
    header = F.struct(
        size.alias("header_size"),
        u32(data, 0).alias("number_of_pages"),
        u32(data, shift + 4).alias("parent_father_data_page"),
        u32(data, shift + 8).alias("extent_space"),
        u32(data, shift + 12).alias("space_tree_page_number"),
    )
    good = long | (size == 16)
    return F.when(good, header), F.when(~good, F.concat(F.lit("root header of "), size, F.lit(" bytes")))


def tree_pages(pages: DataFrame, kind: Column | None = None) -> DataFrame:
    """Decoded pages with kind, root_header, common_page_key (the first payload of branches and leaves), and in error what loses a page."""
    kind, (first, first_error_) = page_kind() if kind is None else kind, tag_payload(0)
    rows = pages.select("*", kind.alias("kind"), first.alias("__first"), first_error_.alias("__first_error"))
    root, root_error = root_header(F.col("__first"), F.col("revision"))
    error = F.coalesce("error", F.when(F.col("kind").isNull(), F.lit("no such page kind")), "__first_error", F.when(F.col("kind") == "Root", root_error))
    out = rows.select(
        *(c for c in pages.columns if c != "error"),
        "kind",
        F.when(F.col("kind") == "Root", root).alias("root_header"),
        F.when(F.col("kind") != "Root", F.col("__first")).alias("common_page_key"),
        error.alias("error"),
    )
    return settled(out, "error")


def root_pages(pages: DataFrame) -> DataFrame:
    """tree_pages() of pages that are known to be roots, whatever else their flags say: entries() of those that are leaves too are leaf entries."""
    return tree_pages(pages, F.lit("Root"))


def entries(pages: DataFrame) -> DataFrame:
    """A row for each tag but the first of tree_pages() without error: the entry, or the error that drops it."""
    at = F.explode_outer(F.when(F.size("tags") > 1, F.sequence(F.lit(1), F.size("tags") - 1)))
    rows = pages.where("error IS NULL").select("page_number", "kind", "page_flags", "data", "header_size", "tags", at.alias("tag_number")).where("tag_number IS NOT NULL")
    payload, error = tag_payload(F.col("tag_number"))
    rows = rows.select("page_number", "kind", "page_flags", "tag_number", F.get("tags", F.col("tag_number"))["tag_flags"].alias("tag_flags"), payload.alias("payload"), error.alias("error"))
    size = F.octet_length("payload")
    rows = settled(rows, "payload", "error").withColumn("page_key_size", u16("payload", 0))
    rows = rows.withColumn("error", F.coalesce("error", first_error((size < 6, "entry is under 6 bytes"), (size < F.col("page_key_size") + 6, "entry is shorter than its key says"))))
    key, good = F.col("page_key_size"), F.col("error").isNull()
    leaf = (F.col("kind") == "Leaf") | ((F.col("kind") == "Root") & has_flag("page_flags", "Leaf"))
    rows = rows.select(
        "*",
        F.when(good, piece("payload", 2, key)).alias("page_key"),
        F.when(good, u32("payload", key + 2)).alias("child_page_number"),
        F.when(good & leaf, piece("payload", key + 6, size - key - 6)).alias("rest"),
        F.when(leaf, F.when(has_flag("page_flags", "Index"), F.lit("Index")).when(has_flag("page_flags", "SpaceTree"), F.lit("SpaceTree")).otherwise(F.lit("TableValue"))).alias("payload_kind"),
    )
    in_tree, left = F.col("payload_kind") == "SpaceTree", F.octet_length("rest")
    local = u16("rest", 2)
    tree_error = first_error((left < 8, "space tree entry is under 8 bytes"), (left < local + 8, "space tree entry is shorter than its key says"))
    rows = rows.withColumn("local", F.when(in_tree, local)).withColumn("error", F.coalesce("error", F.when(in_tree, tree_error)))
    rows = settled(rows, "error", "rest", "local")
    good = F.col("error").isNull()
    own = good & in_tree
    return rows.select(
        "page_number",
        "kind",
        F.when(F.col("payload_kind").isNotNull(), F.lit("Leaf")).otherwise(F.lit("Branch")).alias("entry_kind"),
        "tag_number",
        "tag_flags",
        F.when(good, key).alias("page_key_size"),
        F.when(good, F.col("page_key")).alias("page_key"),
        F.when(good, F.col("child_page_number")).alias("child_page_number"),
        "payload_kind",
        F.when(good & (F.col("payload_kind") == "Index"), F.col("rest")).alias("record_page_key"),
        F.when(own, F.when(F.col("tag_flags") == COMMON_KEY_FLAG, u16("rest", 0)).otherwise(F.lit(0))).alias("common_page_key_size"),
        F.when(own, F.col("local")).alias("local_page_key_size"),
        F.when(own, piece("rest", 4, F.col("local"))).alias("space_key"),
        F.when(own, piece("rest", F.col("local") + 4, left - F.col("local") - 8)).alias("entry_data"),
        F.when(own, u32("rest", left - 4)).alias("num_pages"),
        F.when(good & (F.col("payload_kind") == "TableValue"), F.col("rest")).alias("table_value"),
        "error",
    )


def page_entries(pages: DataFrame) -> DataFrame:
    return entries(pages).where("error IS NULL").drop("error")


def parse_issues(pages: DataFrame) -> DataFrame:
    """Pages that are lost, and entries that are dropped (tag_number not NULL)."""
    lost = pages.where("error IS NOT NULL").select("page_number", F.lit(None).cast("int").alias("tag_number"), "error")
    return lost.unionByName(entries(pages).where("error IS NOT NULL").select("page_number", "tag_number", "error"))


def page_key(data: Column) -> tuple[Column, Column]:
    """(suffix, prefix and page number, error) of a payload; the number is 0 unless just 4 bytes are left for it."""
    size, suffix, prefix = F.octet_length(data), u8(data, 0), u8(data, 1)
    error = first_error((size < 2, "page key is under 2 bytes"), (size < suffix + prefix + 2, "page key is shorter than its parts say"))
    rest = size - suffix - prefix - 2
    number = F.when(rest == 4, u32(data, suffix + prefix + 2)).otherwise(F.lit(0).cast("long"))
    key = F.struct(piece(data, 2, suffix).alias("suffix"), piece(data, suffix + 2, prefix).alias("prefix"), number.alias("page_number"))
    return F.when(error.isNull(), key), error


def nth_page_key(pages: DataFrame, n: int) -> DataFrame:
    """page_number, key, error: of each decoded page's tag n + 1, whatever the page is."""
    payload, lost = tag_payload(n + 1)
    rows = pages.select("page_number", payload.alias("payload"), lost.alias("lost"))
    key, error = page_key(F.col("payload"))
    return rows.select("page_number", F.when(F.col("lost").isNull(), key).alias("key"), F.coalesce("lost", error).alias("error"))


def edges(pages: DataFrame) -> DataFrame:
    """What pages refer to (an extra): src_page, dst_page, edge_kind."""
    good = pages.where("error IS NULL")
    part = lambda c, kind: good.where(c > 0).select(F.col("page_number").alias("src_page"), c.alias("dst_page"), F.lit(kind).alias("edge_kind"))
    child = page_entries(pages).where("entry_kind = 'Branch'").select(F.col("page_number").alias("src_page"), F.col("child_page_number").alias("dst_page"), F.lit("child").alias("edge_kind"))
    out = part(F.col("previous_page_number"), "previous").unionByName(part(F.col("next_page_number"), "next"))
    return out.unionByName(part(F.col("root_header")["space_tree_page_number"], "space_tree")).unionByName(child)


def reachable(edge_table: DataFrame, start: DataFrame, kinds: tuple[str, ...] = ("child",)) -> DataFrame:
    """page, depth: pages that edges lead to from start's page (an extra); a join for each level until no new page comes, and a page is visited once."""
    steps = edge_table.where(F.col("edge_kind").isin(*kinds)).select(F.col("src_page").alias("page"), "dst_page").distinct()
    seen = start.select(F.col("page").cast("long").alias("page"), F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in count(1):
        front = front.select("page").join(steps, "page").select(F.col("dst_page").alias("page")).distinct().join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = seen.checkpoint()  # else a plan with a part for each level
    return seen
