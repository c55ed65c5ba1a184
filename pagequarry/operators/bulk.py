"""Page headers and tags through Arrow and numpy: the fast path for large files, equal to the expressions in page.py."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .page import HEADER_SIZE, WIDE_REVISION, WIDE_SIZES

LAYOUT = np.dtype({"names": ["last_modification_time", "previous_page_number", "next_page_number", "father_data_page_id", "available_data_size", "available_uncommitted_data_size", "available_data_offset", "available_page_tag", "page_flags"], "formats": ["<u8", "<u4", "<u4", "<u4", "<u2", "<u2", "<u2", "<u2", "<u4"], "offsets": [8, 16, 20, 24, 28, 30, 32, 34, 36], "itemsize": 40})
_WIDE = {np.dtype("<u2"): "int", np.dtype("<u4"): "bigint", np.dtype("<u8"): "decimal(20,0)"}
HEADERS = "page_number bigint, " + ", ".join(f"{n} {_WIDE[LAYOUT[n]]}" for n in LAYOUT.names)
TAGS = "page_number bigint, tag_number int, value_offset int, tag_flags int, value_size int"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}


def _whole(batch: pa.RecordBatch):
    for number, data, revision, size in zip(*(batch.column(c).to_pylist() for c in ("page_number", "data", "revision", "page_size")), strict=True):
        if data is not None and len(data) == size and size >= HEADER_SIZE:
            yield number, data, revision, size


def page_headers(pages: DataFrame) -> DataFrame:
    """HEADERS of those pages that have the size of a page."""

    def decode(batches):
        for b in batches:
            rows = list(_whole(b))
            if rows:
                heads = np.frombuffer(b"".join(r[1][:HEADER_SIZE] for r in rows), LAYOUT)
                columns = [pa.array([r[0] for r in rows], pa.int64())]
                for n in LAYOUT.names:
                    kind = _ARROW[_WIDE[LAYOUT[n]]]
                    values = heads[n]
                    columns.append(pa.array(values.astype(np.uint64)).cast(kind) if kind == _ARROW["decimal(20,0)"] else pa.array(values.astype(np.int64)).cast(kind))
                yield pa.RecordBatch.from_arrays(columns, names=["page_number", *LAYOUT.names])

    return pages.select("page_number", "data", "revision", "page_size").mapInArrow(decode, HEADERS)


def page_tags(pages: DataFrame) -> DataFrame:
    """TAGS of those pages."""

    def decode(batches):
        for b in batches:
            out = []
            for number, data, revision, size in _whole(b):
                count, flags = int.from_bytes(data[34:36], "little"), int.from_bytes(data[36:40], "little")
                if flags & 8 or count < 2 or size <= count:
                    continue
                n = min(count, size // 4)
                slots = np.frombuffer(data[size - 4 * n :], "<u2").reshape(n, 2)[::-1].astype(np.int32)
                bits = 15 if revision >= WIDE_REVISION and size in WIDE_SIZES else 13
                sizes, offsets, marks = slots[:, 0] & (1 << bits) - 1, slots[:, 1] & (1 << bits) - 1, slots[:, 1] >> bits
                bad = np.flatnonzero(sizes + offsets > size)
                n = int(bad[0]) if len(bad) else n
                out.append((np.full(n, number, np.int64), np.arange(n, dtype=np.int32), offsets[:n], marks[:n], sizes[:n]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["page_number", "tag_number", "value_offset", "tag_flags", "value_size"])

    return pages.select("page_number", "data", "revision", "page_size").mapInArrow(decode, TAGS)
