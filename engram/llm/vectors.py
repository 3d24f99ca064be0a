"""Vectors in blocks: a stated set of queries against all rows, block against block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Rows of a block and queries of a chunk: what one task holds at a time.
BLOCK, CHUNK = 8_192, 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, vector) that can take part: a key, and a vector without null or non-finite components."""
    v = F.col("vector")
    return (df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
            .where(F.col("key").isNotNull() & (F.size(v) > 0))
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def packed(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Blocks (keys, data, dim) of at most ``rows`` vectors of one length, and about how many there are.

    Rows are dealt out evenly, so equal rows do not meet in one block.
    """
    n = max(1, -(-df.count() // rows))
    kind = np.float32 if isinstance(df.schema["vector"].dataType.elementType, FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_pydict({"keys": [keys.tobytes()], "data": [data.tobytes()], "dim": pa.array([dim], pa.int32())})

        for batch in batches:
            vectors = batch.column("vector")
            keys, lengths = batch.column("key").to_numpy(), vectors.value_lengths().to_numpy()
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(lengths)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for i in range(0, len(at), rows):
                    held.setdefault(int(dim), []).append((keys[at[i:i + rows]], data[i:i + rows]))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        parts = held.pop(int(dim))
                        extra = sum(len(p[0]) for p in parts) - rows
                        if extra:
                            last = parts.pop()
                            cut = len(last[0]) - extra
                            parts.append((last[0][:cut], last[1][:cut]))
                            held[int(dim)] = [(last[0][cut:], last[1][cut:])]
                        yield block(int(dim), parts)
        for dim, parts in held.items():
            yield block(dim, parts)

    return df.repartition(n).mapInArrow(run, "keys binary, data binary, dim int"), n


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def nearest(df: DataFrame, queries: DataFrame, k: int, search: Search, score: str, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each query among all usable rows but its own.

    ``search(keys, rows, query_keys, queries)`` gives (query_key, key, score) of the best of one block. The best of
    all blocks meet per query and the smaller key wins a tie. Of repeated query keys the least vector asks.
    Each repeated row is a candidate of its own.
    """
    kind = np.float32 if isinstance(df.schema["vector"].dataType.elementType, FloatType) else np.float64
    blocks, n_blocks = packed(df, block)
    asked, n_chunks = packed(queries.groupBy("key").agg(F.min("vector").alias("vector")), chunk)
    parts = max(1, n_blocks // 2)
    left = blocks.withColumn("part", F.expr(f"pmod(xxhash64(keys), {parts})"))
    right = (asked.withColumns({"q_keys": F.col("keys"), "q_data": F.col("data")})
             .select("dim", "q_keys", "q_data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")))
    # each block meets each chunk; both are few, large rows
    right = right.withColumn("chunk", F.expr(f"pmod(xxhash64(q_keys), {n_chunks})"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))
    met = left.join(right, ["part", "chunk", "dim"]).select("dim", "keys", "data", "q_keys", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, keys, data, q_keys, q_data = (batch.column(i)[row] for i in range(5))
                array = lambda x, t: np.frombuffer(x.as_buffer(), t)
                found = search(array(keys, np.int64), array(data, kind).reshape(-1, dim.as_py()).astype(np.float64),
                               array(q_keys, np.int64), array(q_data, kind).reshape(-1, dim.as_py()).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, ties to the smaller key."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((keys[near], -scores[near]))[:k]]
