"""Vector code compression by cover-tree Lloyd rounds.

Vectors become integers and are cut into equal parts. Each task builds a cover tree over each part of its own rows, once: the points of a node lie
within its radius of its centre, children have half the radius and their centres lie further apart than that. Points are kept in the order of the tree, so a subtree is
a range and its sum is a difference of cumulative sums. A round sends the codebooks down the trees: an entry that the triangle inequality rules out for
a whole node is dropped, a node with one entry left is assigned as a whole, and only points of leaves that stay ambiguous are compared one by one. Entries are then replaced by
the floor of their means. All sums are integers, so results do not depend on how rows are dealt.

Only the codebooks (16 entries a part) and their sums go through the driver. Copies of a row make a node of radius 0 and are assigned at once.

Vectors that are null, empty or hold null or non-finite components take no part. Rows without a key are coded, but come last among the rows a codebook starts
from; of rows that share a key the smaller vector comes first. Vectors of each length are coded by themselves, with codebooks of their own; a length that is not a multiple of
the parts is cut as evenly as possible. With fewer rows than entries, codebooks are as short as the rows are few. Ties go to the lower entry. An empty table has no codes.
A component beyond 2^26 after scaling raises ValueError, since distances would not fit. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from engram.session import cut

#: Rows under one tree, points below which a node is not parted, and the largest component.
ROWS, LEAF, LARGEST = 4_096, 16, 1 << 26
#: A bound is widened by this share, so that rounding never rules out an entry.
SLACK = 1 + 1e-9

Codebooks = dict[int, list[np.ndarray]]


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer points to integer entries, one entry at a time."""
    out = np.empty((len(points), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        diff = points - entry
        np.einsum("ij,ij->i", diff, diff, out=out[:, j])
    return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi) in a row."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + sizes, sizes)


class CoverTree:
    """``order`` lists points in the order of the tree; node i holds order[lo:hi], its centre first, and children first .. first + children - 1."""

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.radius = order, radius
        self.lo, self.hi, self.first, self.children = nodes

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        flat, order = points.astype(np.float64), np.arange(len(points))
        lo, hi, first, children, radius = [0], [len(points)], [], [], []
        node = 0
        while node < len(lo):
            mine = order[lo[node]:hi[node]]
            diff = flat[mine] - flat[mine[0]]
            far = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            radius.append(far.max(initial=0.0))
            first.append(len(lo))
            groups = []
            if radius[node] > 0 and len(mine) > leaf:
                near = far <= radius[node] / 2
                groups.append(mine[near])
                rest = mine[~near]
                while len(rest):
                    diff = flat[rest] - flat[rest[0]]
                    near = np.einsum("ij,ij->i", diff, diff) <= (radius[node] / 2) ** 2
                    near[0] = True
                    groups.append(rest[near])
                    rest = rest[~near]
                start = lo[node]
                for group in groups:
                    lo.append(start)
                    start += len(group)
                    hi.append(start)
                order[lo[node]:hi[node]] = np.concatenate(groups)
            children.append(len(groups))
            node += 1
        return cls(order, np.array([lo, hi, first, children], np.int32), np.array(radius))

    def nodes(self) -> np.ndarray:
        return np.array([self.lo, self.hi, self.first, self.children], np.int32)

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """The nearest entry of each point (in the order of the tree), the ranges (lo, hi, entry) that were assigned as a whole and the points that were not."""
        labels, whole, single = np.empty(len(points), np.int64), [], []
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(nodes):
            exact = squares(points[self.lo[nodes]], entries)
            exact[~alive] = np.iinfo(np.int64).max
            far, radius = np.sqrt(exact.astype(np.float64)), self.radius[nodes]
            alive &= far <= ((far.min(axis=1) + 2 * radius) * SLACK)[:, None]
            settled = (alive.sum(axis=1) == 1) | (radius == 0)
            best = exact.argmin(axis=1)[settled]
            lo, hi = self.lo[nodes[settled]], self.hi[nodes[settled]]
            labels[ranges(lo, hi)] = np.repeat(best, hi - lo)
            whole.append((lo, hi, best))
            nodes, alive = nodes[~settled], alive[~settled]
            leaves = self.children[nodes] == 0
            lo, hi = self.lo[nodes[leaves]], self.hi[nodes[leaves]]
            at = ranges(lo, hi)
            if len(at):
                exact = squares(points[at], entries)
                exact[~np.repeat(alive[leaves], hi - lo, axis=0)] = np.iinfo(np.int64).max
                labels[at] = exact.argmin(axis=1)
                single.append(at)
            nodes, alive = nodes[~leaves], alive[~leaves]
            first, many = self.first[nodes], self.children[nodes]
            nodes, alive = ranges(first, first + many), np.repeat(alive, many, axis=0)
        return labels, whole, np.concatenate(single) if single else np.zeros(0, np.int64)


def totals(labels: np.ndarray, whole: list, single: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    """(n, 1 + width): how many points each entry has and their sum, whole ranges as differences of cumulative sums."""
    running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points, axis=0, out=running[1:])
    out = np.zeros((n, 1 + points.shape[1]), np.int64)
    for lo, hi, best in whole:
        np.add.at(out, best, np.column_stack([hi - lo, running[hi] - running[lo]]))
    np.add.at(out, labels[single], np.column_stack([np.ones(len(single), np.int64), points[single]]))
    return out


def trees(rows: DataFrame, parts: int, scale: int, block: int = ROWS) -> DataFrame:
    """Blocks (dim, keys, labels, points, order, nodes, radius, sizes) of at most ``block`` rows (key, label, vector) of one length, with a tree for each part."""
    label = rows.schema["label"].dataType
    schema = StructType([*StructType.fromDDL("dim int, keys array<long>").fields, StructField("labels", ArrayType(label)),
                         *StructType.fromDDL("points binary, order binary, nodes binary, radius binary, sizes array<int>").fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}

        def block_of(dim: int) -> pa.RecordBatch:
            mine = held.pop(dim)
            keys, labels = pa.concat_arrays([m[0] for m in mine]), pa.concat_arrays([m[1] for m in mine])
            data = np.concatenate([m[2] for m in mine])
            points, built = [], []
            for start, stop in bounds(dim, parts):
                part = np.ascontiguousarray(data[:, start:stop])
                built.append(CoverTree.build(part))
                points.append(part[built[-1].order].astype("<i4").tobytes())
            joined = lambda xs, kind: b"".join(np.ascontiguousarray(x).astype(kind).tobytes() for x in xs)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), one(keys), one(labels), pa.array([b"".join(points)]), pa.array([joined([t.order for t in built], "<i4")]),
                 pa.array([joined([t.nodes() for t in built], "<i4")]), pa.array([joined([t.radius for t in built], "<f8")]),
                 one(pa.array([len(t.radius) for t in built], pa.int32()))], names)

        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                data = np.floor(flat[(ends[at] - dim)[:, None] + np.arange(dim)] * scale)
                if np.abs(data).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST} after scaling")
                data, done = data.astype(np.int64), 0
                keys, labels = batch.column("key").take(pa.array(at)), batch.column("label").take(pa.array(at))
                while done < len(at):
                    room = block - sum(len(m[2]) for m in held.get(dim, []))
                    held.setdefault(dim, []).append((keys.slice(done, room), labels.slice(done, room), data[done:done + room]))
                    done += room
                    if done <= len(at):
                        yield block_of(dim)
        for dim in list(held):
            yield block_of(dim)

    return rows.mapInArrow(run, schema)


def read_block(batch: pa.RecordBatch, row: int, parts: int) -> tuple[int, list[tuple[CoverTree, np.ndarray]]]:
    """The length of the vectors of a block, and of each part its tree and its points in the order of the tree."""
    value = {name: batch.column(name)[row] for name in ("dim", "points", "order", "nodes", "radius", "sizes")}
    dim, sizes = value["dim"].as_py(), value["sizes"].as_py()
    points, order, nodes = (np.frombuffer(value[name].as_buffer(), "<i4").astype(np.int64) for name in ("points", "order", "nodes"))
    radius = np.frombuffer(value["radius"].as_buffer(), "<f8")
    n, node, out = len(order) // parts, 0, []
    for i, ((start, stop), size) in enumerate(zip(bounds(dim, parts), sizes)):
        tree = CoverTree(order[i * n:(i + 1) * n], nodes[4 * node:4 * (node + size)].reshape(4, size), radius[node:node + size])
        out.append((tree, points[n * start:n * stop].reshape(n, stop - start)))
        node += size
    return dim, out


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the rows with the smallest keys, for each length of vectors."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("key"), "vector")
    chosen = (rows.select(F.size("vector").alias("dim"), "key", "vector").withColumn("nth", F.row_number().over(order))
              .where(F.col("nth") <= entries).select("dim", "nth", "vector").collect())
    found: dict[int, list[np.ndarray]] = {}
    for dim, _, vector in sorted(chosen, key=lambda r: (r[0], r[1])):
        found.setdefault(dim, []).append(np.floor(np.array(vector, np.float64) * scale).astype(np.int64))
    return {dim: [np.array(vs)[:, a:b] for a, b in bounds(dim, parts)] for dim, vs in found.items()}


def next_codebooks(blocks: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """Each entry replaced by the floor of the mean of its points; one without points stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: [np.zeros((len(b), 1 + b.shape[1]), np.int64) for b in bs] for dim, bs in books.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, trees_of = read_block(batch, row, parts)
                for i, (tree, points) in enumerate(trees_of):
                    sums[dim][i] += totals(*tree.assign(points, books[dim][i]), points, len(books[dim][i]))
        for dim, all_sums in sums.items():
            for i, part in enumerate(all_sums):
                used = np.flatnonzero(part[:, 0])
                if len(used):
                    width = part.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used) * width, dim, np.int32)), pa.array(np.full(len(used) * width, i, np.int32)),
                         pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(part[used].ravel())],
                        ["dim", "part", "entry", "place", "total"])

    summed = (blocks.mapInArrow(run, "dim int, part int, entry int, place int, total long")
              .groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("total")).collect())
    found = {(r.dim, r.part, r.entry, r.place): r.total for r in summed}
    out = {dim: [b.copy() for b in bs] for dim, bs in books.items()}
    for dim, part, entry, place in found:
        if place:
            out[dim][part][entry, place - 1] = found[dim, part, entry, place] // found[dim, part, entry, 0]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def codes(blocks: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """(key, label, code, error, codebooks_sha256) of each row."""
    label = blocks.schema["labels"].dataType.elementType
    schema = StructType([*StructType.fromDDL("key long").fields, StructField("label", label), *StructType.fromDDL("code string, error long, codebooks_sha256 string").fields])
    digests = {dim: digest(bs) for dim, bs in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, trees_of = read_block(batch, row, parts)
                n = len(trees_of[0][1])
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for i, (tree, points) in enumerate(trees_of):
                    labels, _, _ = tree.assign(points, books[dim][i])
                    diff = points - books[dim][i][labels]
                    code[tree.order, i] = labels
                    error[tree.order] += np.einsum("ij,ij->i", diff, diff)
                text = code.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[row].values, batch.column("labels")[row].values, pa.array([text[j:j + step] for j in range(0, n * step, step)], pa.string()),
                     pa.array(error), pa.array([digests[dim]] * n, pa.string())], [f.name for f in schema.fields])

    return blocks.mapInArrow(run, schema)


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): the entry of each part in two hex digits, the squared distance to the entries and its sum over
    the rows of the same label, which may be null."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry is written in two hex digits")
    v = F.col("vector")
    rows = (df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(F.size("vector") > 0)
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    books = first_codebooks(rows, parts, entries, scale)
    blocks = cut(trees(rows, parts, scale))
    for _ in range(rounds):
        books = next_codebooks(blocks, books, parts)
    coded = cut(codes(blocks, books, parts))
    # a frequent label is summed in each task first, and its rows meet the sum under several salts
    salts = 16
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = F.col("label").eqNullSafe(F.col("of")) & (F.pmod(F.xxhash64("key", "code"), F.lit(salts)) == F.col("salt"))
    return coded.join(sums, met).select(F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")
