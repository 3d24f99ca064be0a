"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples) and tokens that bear loss. Each task packs
the examples of its own partition out of a bounded pool: the next one is, among those that fit whole, the one whose
demand has the largest dot product with what the sequence has left (both in shares of the limits, weighted by the mean demand of the pool).
When none fits whole, or one segment is left, the best that can fill the sequence to the end is cut there and its rest
goes back to the pool. A sequence that cannot be filled is parted into pieces of powers of two, which need no padding.
Nothing is shuffled, so a hot source, a long document or copies of one do not matter.

An example is a row: repeated rows, rows that share a key and rows without one are examples of their own. A null or empty text
has only the end token. Null ids are an example without tokens and are placed nowhere. Of ties the row that came first is
taken. An empty table has no sequences. Columns beyond those named are not carried, so they cannot clash.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from engram.llm.common import slices

#: Pre-tokens that a worker remembers with their ids (twice as many with those it has not met again since), and how long one may be.
REMEMBERED, LONGEST = 1 << 17, 64
#: A pool takes examples until it holds so many tokens or pieces.
POOL_TOKENS, POOL_PIECES = 1 << 20, 512
#: Bytes of plain ASCII and of the letters of Latin-1, and the two signs among those; text with other bytes is not for the quick split.
PLAIN, SIGNS = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3]), (b"\xc3\x97", b"\xc3\xb7")
SPLIT = rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\x80-\xff]+"


def plain(raw: bytes) -> bool:
    return not raw.translate(None, PLAIN) and SIGNS[0] not in raw and SIGNS[1] not in raw


def little(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes that cannot be seen: 256 and on, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in seen)}


class Remembered(dict):
    """Ids of pre-tokens. When it is full it starts anew, and takes over what is met again."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word) or self.encode(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class WordCodec:
    """Ids of lower-cased word BPE. A run between white space is parted into pre-tokens, each encoded once and remembered;
    a run that is not plain is left whole for the tokenizer to part."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.split, self.known = re.compile(SPLIT), Remembered(self.ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four little-endian bytes each."""
        raw = text.encode().lower()
        self.known.trim()
        if plain(raw):
            return b"".join(map(self.known.__getitem__, self.split.findall(raw)))
        parts: list[bytes] = []
        for run in raw.split():
            if plain(run):
                parts.extend(map(self.known.__getitem__, self.split.findall(run)))
            else:
                parts.append(little(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids))
        return b"".join(parts)

    def ids(self, word: bytes) -> bytes:
        """Ids of a plain pre-token."""
        shown = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(self.letters)
        return little([token.id for token in self.merge(shown)])


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def with_ids(docs: DataFrame, path: str, text: str = "text", out: str = "ids", end: int = 2) -> DataFrame:
    """``docs`` with the ids of ``text`` and the id ``end`` in ``out``: a binary of four little-endian bytes an id. ``out`` replaces a column of that name."""
    docs = docs.drop(out)
    last = little([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in slices(whole, text):
                ids = pa.array([(c.encode(t) if t else b"") + last for t in batch.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, docs.select(F.lit(b"")).schema[0].dataType)]))


class Pool:
    """Pieces that wait, as (example, start, length, prompt) with what they ask of a sequence."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.int64)
        self.pieces: list[tuple[int, int, int, int]] = []
        self.asks = np.zeros((0, 3), np.int64)
        self.live = np.zeros(0, bool)

    def ask(self, piece: tuple[int, int, int, int]) -> tuple[int, int, int]:
        _, start, length, prompt = piece
        return length, 1, min(length, max(start + length - prompt, 0))

    def put(self, pieces: list[tuple[int, int, int, int]]) -> None:
        self.pieces = [p for p, live in zip(self.pieces, self.live.tolist()) if live] + pieces
        self.asks = np.concatenate([self.asks[self.live], np.array([self.ask(p) for p in pieces], np.int64).reshape(-1, 3)])
        self.live = np.ones(len(self.pieces), bool)

    def part(self, piece: tuple[int, int, int, int], left: np.ndarray) -> int:
        """How much of the front of a piece fits into what is left."""
        _, start, length, prompt = piece
        return int(min(length, left[0], max(prompt - start, 0) + left[2]))

    def sequence(self) -> list[tuple[int, int, int]]:
        """(example, start, length) of the pieces of the next sequence."""
        left, placed = self.limits.copy(), []
        weights = self.asks[self.live].mean(axis=0) / self.limits**2
        while left[0] > 0 and left[1] > 0 and self.live.any():
            worth = self.asks @ (weights * left)
            fits = self.live & (self.asks <= left).all(axis=1)
            fills = self.live & (self.asks[:, 0] >= left[0]) & (self.asks[:, 0] - self.asks[:, 2] >= left[0] - left[2])
            chosen = fits if fits.any() and not (left[1] == 1 and fills.any()) else fills if fills.any() else self.live
            at = int(np.where(chosen, worth, -1.0).argmax())
            example, start, length, prompt = self.pieces[at]
            size = self.part(self.pieces[at], left)
            if size == 0:  # no loss is left, and the best that waits starts with loss
                break
            placed.append((example, start, size))
            left -= self.ask((example, start, size, prompt))
            self.live[at] = size < length
            if size < length:
                self.pieces[at] = (example, start + size, length - size, prompt)
                self.asks[at] = self.ask(self.pieces[at])
        return placed


def powers(pieces: list[tuple[int, int, int]], tokens: int) -> list[list[tuple[int, int, int]]]:
    """A sequence as it is when it is full, else parted into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    if total == tokens:
        return [pieces]
    parts, left, size = [[]], total, 1 << (total.bit_length() - 1)
    for example, start, length in pieces:
        while length:
            taken = min(length, size)
            parts[-1].append((example, start, taken))
            start, length, size, left = start + taken, length - taken, size - taken, left - taken
            if size == 0 and left:
                size = 1 << (left.bit_length() - 1)
                parts.append([])
    return parts


def pack(examples: DataFrame, key: str, ids: str = "ids", prompt: str | None = None, tokens: int = 4096, segments: int = 64, loss: int = 4096) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of each example of ``examples``.

    ``ids`` is a binary of four bytes an id. The first ``prompt`` ids (a column; none by default, null for 0) bear no loss. A piece takes up ``length`` ids
    of its example from ``start`` and lies at ``offset`` of its sequence.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("every limit must be at least 1")
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    if key in names:
        raise ValueError(f"{key} is a column of the result")
    asked = examples.select(F.col(key).alias("key"), F.col(ids).alias("ids"), (F.lit(0) if prompt is None else F.coalesce(F.col(prompt), F.lit(0))).cast("long").alias("prompt"))
    schema = StructType([StructField("key", asked.schema["key"].dataType),
                         *StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held, count = Pool((tokens, segments, loss)), {}, 0
        serial = TaskContext.get().partitionId() << 32
        kind = None

        def sequences(until: int) -> Iterator[pa.RecordBatch]:
            """Packs until the pool holds at most so many tokens and half its pieces."""
            nonlocal serial
            rows, size = [], 0
            while (waiting := int(pool.asks[pool.live, 0].sum())) and (waiting > until or until and int(pool.live.sum()) > POOL_PIECES // 2):
                for part in powers(pool.sequence(), tokens):
                    offset = 0
                    for example, start, length in part:
                        name, data, left = held[example]
                        rows.append((name, start, length, data[4 * start:4 * (start + length)], len(data) // 4, serial, offset))
                        offset, size = offset + length, size + length
                        held[example] = (name, data, left - length)
                        if left == length:
                            del held[example]
                    serial += 1
                if size > POOL_TOKENS:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", *names])

        for whole in batches:
            kind = whole.schema.field("key").type
            for batch in slices(whole, "ids"):
                fresh = []
                for name, data, front in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), batch.column("prompt").to_pylist()):
                    if not data:
                        continue
                    n, start = len(data) // 4, 0
                    held[count] = (name, data, n)
                    while start < n:  # no piece asks for more than a sequence has
                        size = pool.part((count, start, n - start, front), pool.limits)
                        fresh.append((count, start, size, front))
                        start += size
                    count += 1
                    if len(fresh) >= POOL_PIECES:
                        pool.put(fresh)
                        fresh = []
                        yield from sequences(POOL_TOKENS // 2)
                pool.put(fresh)
                if pool.asks[:, 0].sum() > POOL_TOKENS or len(pool.pieces) > POOL_PIECES:
                    yield from sequences(POOL_TOKENS // 2)
        yield from sequences(0)

    return asked.mapInArrow(run, schema).withColumnRenamed("key", key)
