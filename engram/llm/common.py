"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about ``most_bytes`` each, a longer text by itself."""
    if batch.num_rows == 0:
        return
    _, offsets = flat_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other and where each row starts; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def ranked(df: DataFrame, group: str, cells: Column, order: list[str], name: str = "nth") -> DataFrame:
    """Numbers the rows of each group from 0 without bringing a group into one task.

    A row falls into the cell ``cells`` of its group. Rows are numbered inside (group, cell), and the counts
    of the cells before are added, so a group with a third of all rows is sorted by as many tasks as it has cells.
    A group is never null: counts meet the rows by plain equality, for which rows stay where they were numbered. Ties beyond ``order`` lie between rows that agree in it.
    """
    df = df.withColumn("_cell", cells)
    counts = df.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)))
    return inside.join(before, [group, "_cell"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_cell", "_row", "_before")


#: Bits of the bitmap of ``among``, in words of 64: 2^18 rows of two numbers at most, whatever the table.
PLACES = 1 << 24


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column``, a hash, is in the one column of ``ids``, and a few others that share a place of a bitmap with one.

    Only the bitmap is sent to the tasks, so what a join on ``column`` has no use for is not shuffled. Beyond some ten million ids it rules out little, but never a row of ``ids``.
    """
    place = F.pmod(F.col(column), F.lit(PLACES))
    known = ids.toDF(column).groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("_bits"))
    at = df.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(known), "_word")
    return at.where(F.getbit("_bits", (place % 64).cast("int")) == 1).select(*df.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Nodes go by a hash, which puts them in random order. Each round every node points to its smallest smaller neighbour,
    pointers are followed to their ends, which lie few steps away in a random order, and the links are carried over to the
    ends. Minima are combined before the shuffle; it ends when no link is left.
    """
    named = links.where("a <> b").select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"), "a", "b")
    nodes = cut(named.select(F.col("x").alias("id"), F.col("a").alias("node")).unionByName(named.select(F.col("y").alias("id"), F.col("b").alias("node"))).distinct())
    edges = cut(named.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    labels = nodes.withColumn("root", F.col("id"))
    while not edges.isEmpty():
        up = cut(edges.groupBy("hi").agg(F.min("lo").alias("to")))
        while not up.join(up.select(F.col("hi").alias("to")), "to", "left_semi").isEmpty():
            further = up.select(F.col("hi").alias("to"), F.col("to").alias("further"))
            up = cut(up.join(further, "to", "left").select("hi", F.coalesce("further", "to").alias("to")))
        labels = cut(labels.join(up.withColumnRenamed("hi", "root"), "root", "left").select("id", "node", F.coalesce("to", "root").alias("root")))
        left = edges.join(up, "hi").where("lo <> to").select(F.col("to").alias("a"), "lo")
        moved = left.join(up.select(F.col("hi").alias("lo"), F.col("to").alias("lower")), "lo", "left").select("a", F.coalesce("lower", "lo").alias("b"))
        edges = cut(moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
