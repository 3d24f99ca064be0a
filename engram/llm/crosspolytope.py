"""Approximate nearest neighbours by cosine with cross-polytope hashing.

A unit vector is turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and
falls to the nearest signed axis, one bucket per table. A query probes, in each table, the axes it lies nearest to; rows
in a probed bucket are candidates and are ranked again by their exact cosine in double precision. Every row is indexed
and nothing is capped. More ``tables`` or ``probes`` raise recall and cost; without ``probes`` their number follows the width. A query that meets
fewer than k rows in the buckets of a block probes all of them there, so it gets k neighbours, or all rows where there are fewer.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a key, take no part; a query
meets vectors of its own length. Ties go to the smaller key, each repeated row counts by itself, an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.vectors import BLOCK, CHUNK, best_of, nearest, usable

TABLES, PROBES = 24, 4


def probes_for(dim: int) -> int:
    """Buckets to probe in each table: four up to a padded width of 64, beyond it a sixteenth of all, as wider vectors without structure need more for the same recall."""
    width = 1 << max(0, dim - 1).bit_length()
    return PROBES if width <= 64 else width // 8


def rotated(units: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Rows turned by the table's pseudo-rotation, padded to a power of two; lengths grow by one common factor."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    out = np.zeros((len(units), width))
    out[:, :units.shape[1]] = units
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out = out * s
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def buckets(units: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis, plus one on the negative side."""
    turned = rotated(units, table, seed)
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(turned)), axis] < 0)


def probed(units: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """For each query which buckets it probes: the signed axes it lies nearest to."""
    turned = rotated(units, table, seed)
    sides = np.stack([turned, -turned], axis=2).reshape(len(units), -1)
    out = np.zeros(sides.shape, bool)
    near = np.argpartition(-sides, min(probes, sides.shape[1]) - 1, axis=1)[:, :probes]
    np.put_along_axis(out, near, True, axis=1)
    return out


def search(k: int, tables: int, probes: int | None, seed: int):
    def run(keys: np.ndarray, rows: np.ndarray, q_keys: np.ndarray, queries: np.ndarray):
        long, q_long = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)
        keys, rows, long = keys[long > 0], rows[long > 0], long[long > 0]
        q_keys, queries, q_long = q_keys[q_long > 0], queries[q_long > 0], q_long[q_long > 0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(keys) and len(q_keys):
            units, q_units = rows / long[:, None], queries / q_long[:, None]
            near = np.zeros((len(keys), len(q_keys)), bool)
            asked = probes or probes_for(rows.shape[1])
            for t in range(tables):
                # per bucket the queries that probe it
                near |= np.ascontiguousarray(probed(q_units, t, seed, asked).T)[buckets(units, t, seed)]
            near = np.ascontiguousarray(near.T)
            # a query that found fewer than k rows, itself aside, probes every bucket of the block
            near[near.sum(axis=1) <= k] = True
            for i, own in enumerate(q_keys):
                at = np.flatnonzero(near[i])
                at = at[keys[at] != own]
                score = (rows[at] @ queries[i]) / (long[at] * q_long[i])
                top = best_of(keys[at], score, k)
                found.append((np.full(len(top), own), keys[at[top]], score[top]))
        ids = list(zip(*found, strict=True)) or ([], [], [])
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(ids, (np.int64, np.int64, np.float64), strict=True))
    return run


def neighbours(df: DataFrame, key: str, vector: str, asks: Column, k: int, tables: int = TABLES, probes: int | None = None, seed: int = 7,
               block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``asks`` holds, a condition on ``key``."""
    rows = usable(df, key, vector)
    return nearest(rows, rows.where(asks), k, search(k, tables, probes, seed), "double", block, chunk)


def every(n: int) -> Column:
    return F.col("key") % n == 0
