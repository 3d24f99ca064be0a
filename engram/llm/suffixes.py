"""Removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller doc_id, in a text of smaller hash under the
same doc_id, or in the same document at an earlier byte); no doc_id comes before all others. Two such strings are equal only if their least q-grams are, and stand at one offset in them. So each string's start is
filed under its least q-gram, and neighbouring starts with one least q-gram make up one run: about one suffix in thirty is sorted.

Initial buckets hold the runs of one q-gram. A run alone in its bucket repeats nothing. In a bucket, runs equal over all
bytes they cover are pointed to their first one, and all their strings repeat. First runs that differ are refined: a run is
split by the offset of the q-gram, and each part gets the bucket of the longer bytes that all strings at those offsets share,
and is compared with the parts there by all bytes they cover. Refinement goes on with what is still open, down to
single strings, so only the edges of repeats reach the lower levels.

Buckets are 64-bit hashes. Rows that share a doc_id, or have none, are documents of their own (``part``, the hash of the text, tells them
apart); equal rows are one document, worked on once, and get equal results. A null text is
empty; a text shorter than ``length`` repeats nothing. An empty table gives no rows. Other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import flat_bytes, free, slices
from engram.llm.shingles import INVERSE, ODD, mixed
from engram.session import cut

#: Bytes of a q-gram; bytes of text hashed at a time; text bytes of a batch of documents; how much narrower each level is.
Q, AT_ONCE, BATCH, NARROWER = 24, 1 << 18, 1 << 20, 4
NO_DOC = -(1 << 63)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(31).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = np.full(size + 1, ODD, np.uint64), np.full(size + 1, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


class Hashed:
    """Hashes of all substrings of some bytes from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        size = AT_ONCE
        while size < len(data):
            size *= 2
        self.values, self.up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def runs(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one least q-gram: row, first start in its text, starts, offset of the q-gram from the first start, bucket, all bytes."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashed = Hashed(data)
    # the upper half orders q-grams, the lower half is the place, so the leftmost wins a tie
    least = (hashed.all(q) * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - q + 1, dtype=np.uint64)
    width, reach = length - q + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[:reach - width], least[width - reach:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int8)  # +1 where a text's starts begin, -1 where they end
    rows = np.flatnonzero(lengths >= length)
    inside[offsets[rows]] += 1
    inside[offsets[rows + 1] - length + 1] -= 1
    valid = np.cumsum(inside[:len(at)]).astype(bool)
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[offsets[rows]] = True
    start = np.flatnonzero(new)
    count = np.add.reduceat(valid.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    gram = at[start]
    return (row, start - offsets[row], count, gram - start, hashed.of(gram, gram + q).view(np.int64), hashed.of(start, start + count - 1 + length).view(np.int64))


def _runs(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(bucket, whole, doc, part, place, known) of every text.

    Of runs equal in all bytes within some MB of text only the first goes to its bucket. The others are ``known`` to repeat it and
    are dealt out evenly, so copies of one text do not meet in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in (piece for batch in batches for piece in slices(batch, "text")):
            parts: list[tuple[np.ndarray, ...]] = []
            for batch in slices(big, "text", AT_ONCE):
                row, start, count, gram, bucket, whole = runs(*flat_bytes(batch.column("text")), length, q)
                parts.append((bucket, whole, batch.column("doc").to_numpy()[row], batch.column("part").to_numpy()[row], start << 16 | count << 8 | gram))
            bucket, whole, doc, part, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, part, doc, whole))
            bucket, whole, doc, part, place = bucket[order], whole[order], doc[order], part[order], place[order]
            new = np.ones(len(whole), bool)
            new[1:] = whole[1:] != whole[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            known = (doc != doc[first]) | (part != part[first]) | (place != place[first])
            spread = mixed((doc.astype(np.int64) ^ part.astype(np.int64)).view(np.uint64) * np.uint64(ODD) + place.astype(np.int64).view(np.uint64)).view(np.int64)
            bucket = np.where(known, spread, bucket)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(whole, pa.int64()), pa.array(doc, pa.int64()), pa.array(part, pa.int64()),
                                              pa.array(place, pa.int64()), pa.array(known)], ["bucket", "whole", "doc", "part", "place", "known"])

    return docs.mapInArrow(run, "bucket long, whole long, doc long, part long, place long, known boolean")


def _sorted_out(found: DataFrame) -> DataFrame:
    """Marks each member of a bucket: ``repeats`` an earlier one in all bytes, or still ``open`` as others there differ."""
    bucket = Window.partitionBy("bucket")
    before = F.lag("whole").over(bucket.orderBy("whole", "doc", "part", "place"))
    first = F.min(F.struct("doc", "part", "place")).over(Window.partitionBy("bucket", "whole").orderBy("whole", "doc", "part", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = (found.withColumn("same", F.coalesce(before == F.col("whole"), F.lit(False))).withColumn("first", first)
            .withColumn("mixed", F.min("whole").over(bucket) != F.max("whole").over(bucket)))
    # parts of one run stand at one place: neither is the earlier
    repeats = F.col("known") | F.col("same") & (F.struct("doc", "part", "place") > F.col("first"))
    return seen.withColumn("repeats", repeats).withColumn("open", F.col("mixed") & ~F.col("same") & ~F.col("known")).where("repeats or open").drop("same", "first", "mixed")


def _cut_out(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(doc, part, start, count, gram, bytes) of open runs, with the bytes they cover."""
    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        by_doc: dict[tuple[int, int], list[int]] = {}
        for doc, part, place in zip(*(wanted.column(c).to_pylist() for c in ("doc", "part", "place")), strict=True):
            by_doc.setdefault((doc, part), []).append(place)
        out: list[tuple] = []
        for doc, part, text in zip(*(texts.column(c).to_pylist() for c in ("doc", "part", "text")), strict=True):
            raw = (text or "").encode() if (doc, part) in by_doc else b""
            for place in by_doc.get((doc, part), ()):
                start, count, gram = place >> 16, place >> 8 & 255, place & 255
                piece = raw[start:start + count - 1 + length]
                if len(piece) == count - 1 + length:
                    out.append((doc, part, start, count, gram, piece))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc", "part", "start", "count", "gram", "bytes"])

    return docs.groupBy("batch").cogroup(open_.groupBy("batch")).applyInArrow(run, "doc long, part long, start long, count long, gram long, bytes binary")


def _split(open_: DataFrame, length: int, grid: int) -> DataFrame:
    """Parts of runs whose q-gram lies in one stretch of ``grid`` offsets; the bucket is what all strings of that stretch share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("bytes"))
            doc, part, start, count, gram = (batch.column(c).to_numpy() for c in ("doc", "part", "start", "count", "gram"))
            least = gram - count + 1  # the q-gram lies at ``gram`` of the first string and at ``least`` of the last
            n = gram // grid - least // grid + 1
            row = np.repeat(np.arange(len(n)), n)
            cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (least // grid)[row]
            high, low = np.minimum(gram[row], (cell + 1) * grid - 1), np.maximum(least[row], cell * grid)
            hashed, base, gram = Hashed(data), offsets[row], gram[row]
            shared = hashed.of(base + gram - cell * grid, base + gram - (cell + 1) * grid + 1 + length)
            first, last = base + gram - high, base + gram - low + length
            bucket = mixed(shared + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            whole = mixed(hashed.of(first, last) + high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            blob = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc[row]), pa.array(part[row]), pa.array(start[row] + gram - high),
                 pa.array(high - low + 1), pa.array(high), pa.array([blob[x:y] for x, y in zip(first, last, strict=True)], pa.binary())],
                ["bucket", "whole", "doc", "part", "start", "count", "gram", "bytes"])

    return open_.mapInArrow(run, "bucket long, whole long, doc long, part long, start long, count long, gram long, bytes binary").withColumns({"place": F.col("start"), "known": F.lit(False)})


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, part, copies): equal rows once; ``part`` tells apart the texts of one doc_id, and is 0 where there is one row."""
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NO_DOC)))
    several = cut(docs.groupBy("doc").count().where("count > 1").select("doc"))
    alone = docs.withColumns({"part": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    if several.isEmpty():
        return alone
    shared = docs.join(several, "doc", "left_semi").groupBy("doc_id", "text", "doc").agg(F.count(F.lit(1)).alias("copies"))
    return alone.join(several, "doc", "left_anti").unionByName(cut(shared.withColumn("part", F.xxhash64("text"))))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, q: int = Q, batch_bytes: int = BATCH, narrower: int = NARROWER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` holds the bytes that are left."""
    spark = docs.sparkSession
    docs = _documents(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch = F.expr(f"pmod(xxhash64(doc, part), {max(1, -(-size // batch_bytes))})")

    found = cut(_sorted_out(_runs(docs.select("doc", "part", "text"), length, q)).select("doc", "part", "place", "repeats"))
    free(spark)
    repeated = found.where("repeats").select("doc", "part", F.shiftright("place", 16).alias("start"), F.expr("shiftright(place, 8) & 255").alias("count"))
    open_ = cut(_cut_out(docs.withColumn("batch", batch), found.where("not repeats").withColumn("batch", batch), length))
    free(spark)
    grid = length - q + 1  # the runs stand for the widest stretch
    while grid > 1:
        grid = -(-grid // narrower)
        level = cut(_sorted_out(_split(open_, length, grid)).select("doc", "part", "start", "count", "gram", "bytes", "repeats"))
        repeated = repeated.unionByName(level.where("repeats").select("doc", "part", "start", "count"))
        open_ = level.where("not repeats").drop("repeats")
    free(spark)

    def run(texts: pa.Table, gone: pa.Table) -> pa.Table:
        doc, part = (gone.column(c).to_numpy() for c in ("doc", "part"))
        order = np.lexsort((part, doc))
        doc, part = doc[order], part[order]
        start = gone.column("start").to_numpy()[order]
        stop = start + gone.column("count").to_numpy()[order] - 1 + length
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        by_doc = dict(zip(zip(doc[first].tolist(), part[first].tolist(), strict=True), zip(first, np.append(first, len(order))[1:], strict=True), strict=True))
        out: list[tuple] = []
        for doc_id, doc, part, text, copies in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "doc", "part", "text", "copies")), strict=True):
            raw = (text or "").encode()
            a, b = by_doc.get((doc, part), (0, 0))
            change = np.zeros(len(raw) + 1, np.int64)
            inside = stop[a:b] <= len(raw)
            np.add.at(change, start[a:b][inside], 1)
            np.add.at(change, stop[a:b][inside], -1)
            covered = np.cumsum(change[:-1]) > 0
            spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(len(covered) > 0 and covered[0])
            kept = np.frombuffer(raw, np.uint8)[~covered].tobytes() if spans else raw
            out.append((doc_id, len(raw), len(raw) - len(kept), spans, kept, copies))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "copies"])

    left = (docs.withColumn("batch", batch).groupBy("batch").cogroup(repeated.withColumn("batch", batch).groupBy("batch"))
            .applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, copies long"))
    return left.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy", "copies")
