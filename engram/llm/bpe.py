"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in whatever task holds it. The split
into pre-tokens looks only forward, so once two neighbours agree on one boundary in their overlap they agree on all
later ones: that boundary is where they are stitched. Pieces between stitches are then encoded one by one and the ids
are put in a row again. Decoding concatenates the bytes of the ids.

A text of one chunk needs no stitch. A text whose neighbours never agree (a pre-token longer than the overlap) is
pre-tokenised whole, which is the same split.

Nulls and empty texts give no ids. Rows are independent: repeated rows, ties and an empty table need no rule.
Other columns of the input are passed on; ``out`` replaces a column of that name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from engram.llm.common import lists, slices

CHUNK, OVERLAP = 32_768, 2_048
#: Distinct pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 100_000
#: Ids that are decoded at a time.
DECODED = 1 << 18


class Codec:
    """The vocabulary in one worker."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.pattern = pattern
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}

    @cached_property
    def bpe(self) -> tiktoken.Encoding:
        """Only workers that encode need it."""
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks={raw: i for i, raw in enumerate(self.bytes) if raw}, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        pieces = self.split.findall(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for piece in set(pieces).difference(known):
            known[piece] = np.array(self.bpe.encode_ordinary(piece), np.int32).tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def boundaries(self, text: str) -> np.ndarray:
        """Where pre-tokens start behind a character that is no white space: places at which a text may be parted."""
        starts = [m.start() for m in self.split.finditer(text)]
        return np.array([s for s in starts if s and not text[s - 1].isspace()], np.int64)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _with_ids(docs: DataFrame, text: str, out: str, ranks_path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                rows = [c.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
                ids = lists(np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], np.int64), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType(), False))]))


def _boundaries(chunks: DataFrame, ranks_path: str, pattern: str, chunk: int) -> DataFrame:
    """(_digest, nth, head, tail): the boundaries in the head and in the tail of each chunk, counted from the start of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, "part"):
                heads, tails = [], []
                for nth, part in zip(batch.column("nth").to_pylist(), batch.column("part").to_pylist(), strict=True):
                    at = c.boundaries(part)
                    heads.append((at[at < len(part) - chunk] if len(part) > chunk else at) + nth * chunk)
                    tails.append(at[at >= chunk] + nth * chunk)
                both = [lists(np.concatenate(x) if x else np.zeros(0, np.int64), np.array([len(y) for y in x], np.int64), pa.int64()) for x in (heads, tails)]
                yield pa.RecordBatch.from_arrays([batch.column("_digest"), batch.column("nth"), *both], ["_digest", "nth", "head", "tail"])

    return chunks.mapInArrow(run, "_digest string, nth int, head array<long>, tail array<long>")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out`` (array of int)."""
    docs = docs.drop(out)
    size = F.coalesce(F.char_length(text), F.lit(0))
    short = _with_ids(docs.where(size <= chunk + overlap), text, out, ranks_path, pattern)

    # a long text is known by its digest, so copies of it are encoded once and rows need no key of their own
    long = docs.where(size > chunk + overlap).withColumn("_digest", F.sha2(text, 256))
    texts = long.select("_digest", F.col(text).alias("whole")).dropDuplicates(["_digest"])
    parts = F.expr(f"transform(sequence(0, cast((char_length(whole) - 1) div {chunk} as int)), i -> substring(whole, i * {chunk} + 1, {chunk + overlap}))")
    chunks = texts.select("_digest", F.posexplode(parts).alias("nth", "part")).repartition("_digest", "nth")
    marked = _boundaries(chunks, ranks_path, pattern, chunk)
    order = Window.partitionBy("_digest").orderBy("nth")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    ends = marked.select("_digest", "nth", cut.alias("stop"), F.lead("nth").over(order).isNull().alias("last"))
    # a text whose neighbours agree everywhere is parted at the stitches, another one not at all
    stitches = ends.groupBy("_digest").agg(F.max(F.col("stop").isNull() & ~F.col("last")).alias("broken"), F.array_sort(F.collect_list("stop")).alias("stops"))
    bounds = F.expr("if(broken, array(0L, cast(char_length(whole) as bigint)), concat(array(0L), stops, array(cast(char_length(whole) as bigint))))")
    parted = texts.join(stitches, "_digest").withColumn("bounds", bounds).select(
        "_digest", "whole", "bounds", F.posexplode(F.expr("slice(bounds, 1, size(bounds) - 1)")).alias("nth", "start"))
    stitched = parted.select("_digest", "nth", F.expr("substring(whole, cast(start as int) + 1, cast(bounds[nth + 1] - start as int))").alias("piece"))
    pieces = _with_ids(stitched.repartition("_digest", "nth"), "piece", "ids", ranks_path, pattern).drop("piece")
    joined = pieces.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("nth", "ids"))).alias("all")).select(
        "_digest", F.flatten(F.col("all.ids")).alias(out))
    return short.unionByName(long.join(joined, "_digest").drop("_digest"))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in ``out``; null ids give no bytes. ``ids`` itself stays."""
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for whole in batches:
            counts = np.cumsum(np.nan_to_num(whole.column(ids).value_lengths().to_numpy(zero_copy_only=False).astype(float)))
            # a row belongs to the slice its last id falls in, so a slice holds about DECODED ids or one longer row
            for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(counts // DECODED)) + 1):
                if not len(rows):
                    continue
                batch = whole.slice(rows[0], len(rows))
                column = batch.column(ids).fill_null([]) if batch.column(ids).null_count else batch.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
                raw = b"".join(map(c.bytes.__getitem__, flat.tolist()))
                at = np.concatenate([[0], np.cumsum(c.lengths[flat])])[np.concatenate([[0], ends]).astype(np.int64)]
                data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))
