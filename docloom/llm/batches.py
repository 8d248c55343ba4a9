"""Arrow batches and flat byte buffers: the form in which the numpy kernels see texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel takes at once; a longer document comes alone.
SLICE_BYTES = 4 << 20
#: Rows that it takes at once, however short.
SLICE_ROWS = 4096


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator:
    """Consecutive row ranges of a batch or table with at most `limit` bytes of text each (one row at least)."""
    data = batch.column(column)
    _, at = string_buffers(data)
    start, n = 0, len(at) - 1
    while start < n:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(n, start + rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop
