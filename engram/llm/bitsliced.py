"""Exact top-k by inner product over a bit-sliced index.

Components are integers floor(scale * x). A block of rows keeps, for each component, one bitmap per bit of the
distance from the component's least value, without the ``dropped`` lowest bits: the quantised slices. For a query, the
slices of a component are added once for each bit of the query's weight, with carry-save adders on whole bitmaps; a
negative weight adds the complements. The sums stand in slices of their own. The k-th best sum is read from the most
significant slice downward, the bits dropped bound each score from above, and rows that may still belong to the best are
resolved with exact integer products. The result is exact.

Vectors that are null, empty or hold null or non-finite components, and rows without a key, take no part; a query meets
vectors of its own length. Ties go to the smaller key, each repeated row counts by itself, an empty table gives no rows.
Scores must fit 64-bit integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.vectors import BLOCK, CHUNK, best_of, nearest, usable

#: Queries that are added up at once, so that their bitmaps stay in a core's cache.
AT_ONCE = 32


def slices_of(values: np.ndarray, dropped: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per component its bitmaps, lowest kept bit first, and each component's least value."""
    least = values.min(axis=0)
    shifted = ((values - least) >> dropped).astype(np.uint64)
    pad = -len(values) % 64
    out = []
    for column in np.pad(shifted, ((0, pad), (0, 0))).T:
        bits = int(column.max()).bit_length()
        out.append(np.stack([np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
                             for b in range(bits)]) if bits else np.zeros((0, len(column) // 64), np.uint64))
    return out, least


def add(columns: list[list[np.ndarray]], weight: int, bitmap: np.ndarray) -> None:
    """Puts a bitmap into the column of its weight; three in a column become one there and a carry."""
    while True:
        while len(columns) <= weight:
            columns.append([])
        held = columns[weight]
        if len(held) < 2:
            held.append(bitmap)
            return
        a, b = held
        both = a ^ b
        carry = a & b
        carry |= both & bitmap
        both ^= bitmap
        columns[weight] = [both]
        weight, bitmap = weight + 1, carry


def settle(columns: list[list[np.ndarray]], shape: tuple[int, int]) -> list[np.ndarray]:
    """Adds the two bitmaps that may be left in a column; the sums, lowest slice first."""
    planes, carry, i = [], None, 0
    while i < len(columns) or carry is not None:
        held = (columns[i] if i < len(columns) else []) + ([carry] if carry is not None else [])
        carry = None
        if len(held) == 3:
            both = held[0] ^ held[1]
            carry = (held[0] & held[1]) | (both & held[2])
            planes.append(both ^ held[2])
        elif len(held) == 2:
            carry = held[0] & held[1]
            planes.append(held[0] ^ held[1])
        else:
            planes.append(held[0] if held else np.zeros(shape, np.uint64))
        i += 1
        if carry is not None and not carry.any():
            carry = None
    return planes


def kth_value(planes: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th highest sum of its rows (the least, if fewer), from the top slice downward."""
    kept, sure = among.copy(), np.zeros(len(among), np.int64)
    value = np.zeros(len(among), np.int64)
    k = np.minimum(k, np.bitwise_count(among).sum(axis=1).astype(np.int64))
    for i in range(len(planes) - 1, -1, -1):
        high = kept & planes[i]
        count = np.bitwise_count(high).sum(axis=1).astype(np.int64)
        take = sure + count >= k
        value += take.astype(np.int64) << i
        sure += np.where(take, 0, count)
        kept = np.where(take[:, None], high, kept & ~planes[i])
    return value


def at_least(planes: list[np.ndarray], among: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """The rows whose sum reaches the bar of their query."""
    bar = np.maximum(bar, 0)
    above, equal = np.zeros_like(among), among.copy()
    for i in range(len(planes) - 1, -1, -1):
        bit = ((bar >> i) & 1).astype(bool)[:, None]
        above |= np.where(bit, np.uint64(0), equal & planes[i])
        equal &= np.where(bit, planes[i], ~planes[i])
    return above | equal


def search(scale: float, k: int, dropped: int):
    def run(keys: np.ndarray, rows: np.ndarray, q_keys: np.ndarray, queries: np.ndarray):
        values, weights = np.floor(scale * rows).astype(np.int64), np.floor(scale * queries).astype(np.int64)
        slices, _ = slices_of(values, dropped)
        n, words = len(values), -(-len(values) // 64)
        full = np.packbits(np.pad(np.ones(n, np.uint8), (0, words * 64 - n)), bitorder="little").view(np.uint64)
        order = np.argsort(keys, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(weights), AT_ONCE):
            w, own = weights[start:start + AT_ONCE], q_keys[start:start + AT_ONCE]
            shape = (len(w), words)
            among = np.broadcast_to(full, shape).copy()
            lo, hi = np.searchsorted(keys[order], own, "left"), np.searchsorted(keys[order], own, "right")
            for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
                for r in order[a:b]:
                    among[i, r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
            columns: list[list[np.ndarray]] = []
            for d, bitmaps in enumerate(slices):
                size, down = np.abs(w[:, d]), np.where(w[:, d] < 0, ~np.uint64(0), np.uint64(0))[:, None]
                signed = [bitmap ^ down for bitmap in bitmaps]  # a negative weight adds what is missing to the most
                for bit in range(int(size.max()).bit_length()):
                    mask = np.where((size >> bit) & 1, ~np.uint64(0), np.uint64(0))[:, None]
                    for b, bitmap in enumerate(signed):
                        add(columns, b + bit, bitmap & mask)
            planes = settle(columns, shape)
            # what the dropped bits can add to any row: less than the sum of the weights times their range
            slack = -(-np.abs(w).sum(axis=1) * ((1 << dropped) - 1) >> dropped) if dropped else np.zeros(len(w), np.int64)
            near = at_least(planes, among, kth_value(planes, among, k) - slack)
            for i, row in enumerate(near):
                at = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
                exact = values[at] @ w[i]
                top = best_of(keys[at], exact, k)
                found.append((np.full(len(top), own[i]), keys[at[top]], exact[top]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or ([], [], [])))
    return run


def top_k(df: DataFrame, key: str, vector: str, asks: Column, k: int, scale: float = 256.0, dropped: int = 2,
          block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``asks`` holds, a condition on ``key``."""
    rows = usable(df, key, vector)
    return nearest(rows, rows.where(asks), k, search(scale, k, dropped), "long", block, chunk)


def every(n: int) -> Column:
    return F.col("key") % n == 0
