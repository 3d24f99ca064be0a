"""Small graphs searched in tasks: whole graphs are dealt out by user, and a task walks many of them at a time.

Rows are (user_id, kind, a, b, …): a source or node ``a``, an edge from ``a`` to ``b``, or an end ``a`` with an optional ``b``. Every vertex has a cell for
each start of its graph, in which a search keeps what it knows. Larger graphs are left to joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.session import cut

#: Rows of one graph up to which a task searches it.
ROWS_IN_TASK = 1 << 11
ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 17, 1 << 22
NODE, EDGE, END = 0, 1, 2


def tagged(kind: int, df: DataFrame, a: str, b: str | None = None, **more: str) -> DataFrame:
    return df.select("user_id", F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast(df.schema[a].dataType)).alias("b"),
                     *[F.col(c).alias(n) for n, c in more.items()])


def edge_rows(edges: DataFrame, **more: str) -> DataFrame:
    return tagged(EDGE, edges.filter("user_id is not null and src is not null and dst is not null"), "src", "dst", **more)


def gathered(*parts: DataFrame, bound: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the graphs that fit a task, and the users of the others, if there are any."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = cut(rows)
    large = cut(rows.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > (ROWS_IN_TASK if bound is None else bound)).select("user_id"))
    return (rows, None) if large.isEmpty() else (rows.join(large, "user_id", "left_anti"), large)


def in_tasks(rows: DataFrame, run: Callable[[Graphs], Iterator[pa.Table]], schema: StructType) -> DataFrame:
    def whole(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        """Pieces of whole graphs of bounded work, and the graph that may go on."""
        first = np.flatnonzero(np.diff(_codes(table["user_id"])[0], prepend=-1))
        ends = np.append(first[1:], table.num_rows)
        work = np.cumsum((ends - first).astype(float) ** 2) // CELLS_AT_ONCE
        at = [0, *ends[np.flatnonzero(np.diff(work))].tolist()]
        at = sorted({x for x in at if last or x <= first[-1]} | {table.num_rows if last else int(first[-1])})
        return [table.slice(x, y - x) for x, y in zip(at, at[1:])], table.slice(at[-1])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pieces: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for piece in pieces:
                for table in run(Graphs(piece)):
                    yield from table.to_batches(max_chunksize=1 << 16)

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= ROWS_AT_ONCE:
                pieces, rest = whole(pa.Table.from_batches(held), False)
                yield from done(pieces)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield from done(whole(pa.Table.from_batches(held), True)[0])

    return rows.repartition("user_id").sortWithinPartitions("user_id").mapInArrow(part, schema)


def _codes(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of values and the values, nulls being one of them."""
    both = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    d = both.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy().astype(np.int64), d.dictionary


class Graphs:
    """Vertices are numbered by user and then in the order of their ids."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows, self.kind = rows, rows["kind"].to_numpy()
        user, self.users = _codes(rows["user_id"])
        code, values = _codes(rows["a"], rows["b"])
        order = pc.sort_indices(values).to_numpy()
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        key = np.concatenate([user, user]) * len(values) + rank[code]
        n, edge = len(user), self.kind == EDGE
        known = np.concatenate([np.ones(n, bool), edge | ~rows["b"].is_null().to_numpy()])
        keys, at = np.unique(key[known], return_inverse=True)
        vertex = np.full(2 * n, -1)
        vertex[known] = at
        self.a, self.b, self.n = vertex[:n], vertex[n:], len(keys)
        self.user, self.ids = keys // len(values), values.take(pa.array(order)).take(pa.array(keys % len(values)))
        self.edge = np.flatnonzero(edge)

    def of(self, kind: int) -> np.ndarray:
        return np.flatnonzero(self.kind == kind)

    def numbers(self, name: str) -> np.ndarray:
        """A column of doubles, nulls as not a number."""
        return self.rows[name].to_numpy().astype(float)

    def id(self, vertices: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(vertices))

    def name(self, vertices: np.ndarray) -> pa.Array:
        return self.users.take(pa.array(self.user[vertices]))

    def start_at(self, starts: np.ndarray) -> None:
        """A cell per vertex and start of the same graph."""
        self.starts = np.unique(starts)
        count = np.bincount(self.user[self.starts], minlength=len(self.users))
        self.first_start = np.cumsum(count) - count
        size = count[self.user]
        self.base = np.cumsum(size) - size
        self.vertex = np.repeat(np.arange(self.n), size)
        self.front = self.base[self.starts] + np.arange(len(self.starts)) - self.first_start[self.user[self.starts]]

    def start(self, cells: np.ndarray) -> np.ndarray:
        v = self.vertex[cells]
        return self.starts[self.first_start[self.user[v]] + cells - self.base[v]]

    def walk(self, src: np.ndarray, dst: np.ndarray) -> None:
        """From now on steps lead from ``src`` to ``dst``; ``self.step`` has their positions in these."""
        self.step = np.lexsort((dst, src))
        self.to, self.first = dst[self.step], np.searchsorted(src[self.step], np.arange(self.n + 1))

    def steps(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All steps from vertices, in order: index of the vertex, position of the step."""
        k = self.first[v + 1] - self.first[v]
        which = np.repeat(np.arange(len(v)), k)
        return which, self.first[v][which] + np.arange(len(which)) - (np.cumsum(k) - k)[which]

    def beyond(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All steps from vertices: index of the vertex, vertex it leads to."""
        which, step = self.steps(v)
        return which, self.to[step]

    def expand(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All steps from cells, in order: index of the cell, position of the step, cell it leads to."""
        v = self.vertex[cells]
        which, step = self.steps(v)
        return which, step, self.base[self.to[step]] + (cells - self.base[v])[which]

    def search(self, max_depth: int | None = None, in_order: bool = False) -> None:
        """Breadth-first. ``in_order`` takes the first cells along the paths that read first, else the parent with the least id."""
        self.depth, self.parent = np.full(len(self.vertex), -1, np.int32), np.full(len(self.vertex), -1)
        front, depth = self.front, 0
        self.depth[front] = 0
        while len(front) and (max_depth is None or depth < max_depth):
            depth += 1
            which, _, to = self.expand(front)
            new = self.depth[to] < 0
            found, at = np.unique(to[new], return_index=True)
            if in_order:
                at = np.sort(at)
                found = to[new][at]
            self.depth[found], self.parent[found] = depth, front[which[new][at]]
            front = found

    def trails(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vertices from each cell along its parents, and where each trail begins."""
        begin = np.concatenate([[0], np.cumsum(self.depth[cells] + 1)])
        flat, at, place = np.empty(begin[-1], np.int64), cells, begin[:-1]
        while len(at):
            flat[place] = self.vertex[at]
            up = self.parent[at]
            at, place = up[up >= 0], place[up >= 0] + 1
        return flat, begin

    def least(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """The first vertex of each vertex's component."""
        label = np.arange(self.n)
        while True:
            low, new = np.minimum(label[src], label[dst]), label.copy()
            np.minimum.at(new, src, low)
            np.minimum.at(new, dst, low)
            new = new[new]
            if (new == label).all():
                return label
            label = new


def pieces(cells: np.ndarray, size: int = 1 << 18) -> Iterator[np.ndarray]:
    for i in range(0, len(cells), size):
        yield cells[i:i + size]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Positions of the first row of each key, in order of all of them; the last two keys given last make the key."""
    order = np.lexsort(keys)
    a, b = keys[-1][order], keys[-2][order]
    return order[np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(order)])]
