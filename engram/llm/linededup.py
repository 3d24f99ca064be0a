"""Line dedup with a sharded minimal perfect hash.

Lines are known by a 128-bit hash of their key. Hashes are counted over all documents and dealt to shards; each shard
builds a minimal perfect hash over its distinct hashes that leads to compact arrays: fingerprint, number of documents,
last document. Documents do not join lines: a batch of documents asks each shard once for the hashes it holds, the shard
looks them up in its arrays, and what comes back is applied to the batch. A line that every document holds is asked
for once a batch, not once a document.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at least ``shortest`` code points
that at least ``least`` documents hold lose all their lines except in the largest doc_id that holds them.

Each row is a document: rows that repeat a doc_id count one by one and keep a line together if theirs is the largest id. A
null doc_id is smaller than any other. Null and empty texts are one empty line. An empty table gives no rows. Other columns
are passed on; ``n_lines`` and ``n_dropped`` replace columns of those names, and the text becomes what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from engram.llm.common import slices
from engram.session import cut

SPACE = b" \t\n\v\f\r"
#: Text bytes of a batch of documents and distinct hashes of a shard, on average.
BATCH, SHARD = 1 << 20, 1 << 16
NO_DOC = -(1 << 63)


def keys_of(text: str, shortest: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and the 16-byte hash of each key that is long enough."""
    lines = (text or "").encode().split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        long = len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode()) >= shortest
        hashes.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, hashes


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bitmaps, each holding the keys that met no other there."""

    ROOM = 2  # bits per key and level

    @staticmethod
    def spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> list[np.ndarray]:
        levels = []
        while len(keys):
            at = cls.spots(keys, len(levels), cls.ROOM * len(keys))
            alone = np.bincount(at.astype(np.int64), minlength=cls.ROOM * len(keys)) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            levels.append(np.array([cls.ROOM * len(keys)], np.int64).view(np.uint8))
            keys = keys[~alone[at.astype(np.int64)]]
        return levels

    @classmethod
    def find(cls, levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for some that are not in the set; others of those get any place."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for i in range(0, len(levels), 2):
            size = int(levels[i + 1].view(np.int64)[0])
            alone = np.unpackbits(levels[i], count=size, bitorder="little").astype(np.int64)
            before = np.cumsum(alone) - alone
            at = cls.spots(keys[open_], i, size).astype(np.int64)
            hit = alone[at] == 1
            out[open_[hit]] = base + before[at[hit]]
            open_, base = open_[~hit], base + int(alone.sum())
        return out


def _postings(docs: DataFrame, shortest: int) -> DataFrame:
    """(batch, h, g, n, last): how many documents of a batch hold a hash, and the largest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                seen: dict[tuple[int, bytes], list[int]] = {}
                for batch, doc, text in zip(*(part.column(c).to_pylist() for c in ("batch", "doc", "text")), strict=True):
                    for h in {x for x in keys_of(text, shortest)[1] if x is not None}:
                        entry = seen.get((batch, h))
                        if entry is None:
                            seen[batch, h] = [1, doc]
                        else:
                            entry[0] += 1
                            entry[1] = max(entry[1], doc)
                halves = np.frombuffer(b"".join(k[1] for k in seen), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "batch": pa.array([k[0] for k in seen], pa.int64()), "h": pa.array(halves[:, 0]), "g": pa.array(halves[:, 1]),
                    "n": pa.array([v[0] for v in seen.values()], pa.int64()), "last": pa.array([v[1] for v in seen.values()], pa.int64())})

    held = docs.mapInArrow(run, "batch long, h long, g long, n long, last long")
    return held.groupBy("batch", "h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _index(counts: DataFrame) -> DataFrame:
    """One row per shard: the perfect hash and its arrays."""
    def run(t: pa.Table) -> pa.Table:
        h, g, n, last = (t.column(c).to_numpy() for c in ("h", "g", "n", "last"))
        keys = h.view(np.uint64) ^ PerfectHash.spots(g.view(np.uint64), 99, 2**63)
        keys, one = np.unique(keys, return_index=True)  # of two hashes alike in 64 bits, as good as never, one would be kept
        levels = PerfectHash.build(keys)
        place = PerfectHash.find(levels, keys)
        arrays = [np.zeros(len(keys), k) for k in (np.uint32, np.uint32, np.int64)]
        for array, values in zip(arrays, (g[one].view(np.uint64) >> np.uint64(32), np.minimum(n[one], 2**32 - 1), last[one]), strict=True):
            array[place] = values
        return pa.table({"shard": t.column("shard")[:1], "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
                         **{k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(("fingerprints", "counts", "lasts"), arrays, strict=True)}})

    return counts.groupBy("shard").applyInArrow(run, "shard long, levels array<binary>, fingerprints binary, counts binary, lasts binary")


def _probe(postings: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """(batch, h, g, last) of the hashes of a batch that enough documents hold."""
    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        h, g = asked.column("h").to_numpy(), asked.column("g").to_numpy()
        row = shard.to_pylist()[0]
        levels = [np.frombuffer(x, np.uint8) for x in row["levels"]]
        prints, counts, lasts = (np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint32), ("counts", np.uint32), ("lasts", np.int64)))
        at = PerfectHash.find(levels, h.view(np.uint64) ^ PerfectHash.spots(g.view(np.uint64), 99, 2**63))
        hit = np.flatnonzero((at >= 0) & (prints[at] == g.view(np.uint64) >> np.uint64(32)) & (counts[at] >= least))
        return pa.table({"batch": asked.column("batch").take(pa.array(hit)), "h": pa.array(h[hit]), "g": pa.array(g[hit]), "last": pa.array(lasts[at[hit]])})

    return postings.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, "batch long, h long, g long, last long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, shortest: int = 20,
          batch_bytes: int = BATCH, shard_keys: int = SHARD) -> DataFrame:
    """``docs`` with the text that is left, ``n_lines`` (before) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batch = F.expr(f"pmod(xxhash64(`{key}`, `{text}`), {max(1, -(-size // batch_bytes))})")
    postings = cut(_postings(docs.select(batch.alias("batch"), F.coalesce(F.col(key).cast("long"), F.lit(NO_DOC)).alias("doc"), F.col(text).alias("text")), shortest))
    shard = F.expr(f"pmod(h, {max(1, -(-postings.count() // shard_keys))})").alias("shard")
    counts = postings.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(shard, "h", "g", "n", "last")
    hits = _probe(postings.select(shard, "batch", "h", "g"), _index(counts), least)

    names = docs.columns
    at_key, at_text = names.index(key), names.index(text)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        halves = np.stack([found.column(c).to_numpy() for c in ("h", "g")], axis=1).astype(np.int64)
        last = dict(zip((x.tobytes() for x in halves), found.column("last").to_pylist(), strict=True))
        texts, n_lines, n_dropped = [], [], []
        for doc, whole in zip(rows.column(at_key + 1).to_pylist(), rows.column(at_text + 1).to_pylist(), strict=True):
            lines, hashes = keys_of(whole, shortest)
            doc = NO_DOC if doc is None else doc
            kept = [line for line, h in zip(lines, hashes, strict=True) if h is None or last.get(h, doc) == doc]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        out = rows.set_column(at_text + 1, text, pa.array(texts, pa.string())).remove_column(0)
        return out.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_dropped", pa.array(n_dropped, pa.int64()))

    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    inner = docs.select(batch.alias("_batch"), *docs.columns)
    return inner.groupBy("_batch").cogroup(hits.withColumnRenamed("batch", "_batch").groupBy("_batch")).applyInArrow(run, schema)
