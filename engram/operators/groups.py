"""Many small groups of rows worked off by one call of Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Rows, and bytes of rows, of whole groups that a task takes at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 15, 8 << 20


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where each group begins in rows that are sorted by ``keys``."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows_at_once: int = ROWS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``keys``, put together to tables of whole groups."""
    held, n, size = [], 0, 0
    for batch in batches:
        held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
        if n >= rows_at_once or size >= bytes_at_once:
            table = pa.Table.from_batches(held)
            last = int(starts(table, keys)[-1])  # the last group may go on
            if last:
                yield table.slice(0, last)
            rest = table.slice(last)
            held, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if n:
        yield pa.Table.from_batches(held)
