"""Mixing sources to target weights with Pfair scheduling.

Each source is a task that needs a slot for each of its blocks. Block j of a source with weight w of W may not come before
slot floor(j * W / w) and must come before slot ceil((j + 1) * W / w). Earliest deadline first fills one slot at a time; as the weights
add up to W it meets all deadlines, so after any number of slots each source is less than one block off its share. Weights are
taken as the exact fractions that they are and the whole mix is scheduled, in one task that holds a few numbers per source and
writes a row per slot; rows find their slots by a join with that table. Only with ``slots`` are weights rounded to such a round.

The mix ends with the slot that brings the last row that was still missing. A source whose rows are used up before that
starts over (``epoch``), inside a block if need be, so every block is full and rows have the shares that blocks have. No row of a
source with a weight is left out, and small sources repeat up to their weights; a source without one, or with weight 0, sends nothing.

Rows of a source are numbered in an order by hash, inside cells, so a source with a third of all rows is numbered by many tasks.
A null source is a source of its own. Nulls elsewhere, empty and long texts and repeated rows need no rule: every row is
placed. An empty table gives no rows. Other columns are passed on; the three results replace columns of their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ranked
from engram.session import cut

#: Rows of a block, rows of a numbering cell, and slots that are scheduled at a time.
BLOCK, CELL, AT_ONCE = 64, 128, 1 << 16


def turns(weights: list[int]) -> Iterator[int]:
    """The source of each slot, without end."""
    total, sent = sum(weights), [0] * len(weights)
    waiting = [(0, i) for i, w in enumerate(weights) if w]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for slot in count() if waiting else ():
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(sent[i] + 1) * total // weights[i]), i))
        _, i = heapq.heappop(ready)
        yield i
        sent[i] += 1
        heapq.heappush(waiting, (sent[i] * total // weights[i], i))


def schedule(weights: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one round of sum(weights) slots."""
    slots: list[list[int]] = [[] for _ in weights]
    for slot, i in enumerate(islice(turns(weights), sum(weights))):
        slots[i].append(slot)
    return slots


def whole_numbers(aims: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``aims``."""
    exact = [Fraction(a) for a in aims]
    if any(a < 0 for a in exact):
        raise ValueError("weights must not be negative")
    unit = lcm(*(a.denominator for a in exact))
    return [int(a * unit) for a in exact]


def _plan(shares: list[int], blocks: list[int]):
    """Writes (_s, _q, slot) up to the slot with which each source has sent its ``blocks``."""
    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, missing, order, slot = [0] * len(shares), sum(1 for w, b in zip(shares, blocks, strict=True) if w and b), turns(shares), 0
        while missing:
            owner: list[int] = []
            nth: list[int] = []
            while missing and len(owner) < AT_ONCE:
                i = next(order)
                owner.append(i)
                nth.append(sent[i])
                sent[i] += 1
                missing -= sent[i] == blocks[i]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(nth, pa.int64()), pa.array(range(slot, slot + len(owner)), pa.int64())], ["_s", "_q", "slot"])
            slot += len(owner)

    return run


def mix(docs: DataFrame, source: str = "source", order: str = "doc_id", weights: dict[str | None, float] | None = None, temperature: float = 0.7,
        block: int = BLOCK, slots: int | None = None) -> DataFrame:
    """``docs`` with ``slot`` (the place of the row's block in the mix), ``epoch`` and ``block`` (of its source); rows come once per epoch.

    ``weights`` gives the share of each source; without it shares follow the rows of a source to the power ``temperature``.
    ``slots`` rounds the shares to a round of about so many slots, one at least for each source with a weight.
    The names of the sources and a few numbers each are held by the driver.
    """
    docs = docs.drop("slot", "epoch", "block")
    spark = docs.sparkSession
    counts = sorted(((r[0], r[1]) for r in docs.groupBy(source).count().collect()), key=lambda x: (x[0] is not None, str(x[0])))
    shares = whole_numbers([(weights or {}).get(name, 0.0) if weights else n**temperature for name, n in counts])
    if slots is not None:
        shares = [max(1, round(Fraction(slots * a, sum(shares)))) if a else 0 for a in shares]
    plan = cut(spark.range(0, 1, 1, 1).mapInArrow(_plan(shares, [-(-n // block) for _, n in counts]), "_s int, _q long, slot long"))
    sent = {r[0]: r[1] for r in plan.groupBy("_s").count().collect()}

    known = F.broadcast(spark.createDataFrame([(name, i, n, sent[i] * block, 1 + n // CELL) for i, (name, n) in enumerate(counts) if i in sent],
                                              f"_name {docs.schema[source].dataType.simpleString()}, _s int, _n long, _sent long, _cells long"))
    rows = docs.join(known, F.col(source).eqNullSafe(F.col("_name"))).drop("_name").withColumn("_hash", F.xxhash64(*docs.columns))
    numbered = ranked(rows, "_s", F.pmod("_hash", "_cells"), ["_hash", order], "_nth")
    again = numbered.withColumn("epoch", F.explode(F.expr("sequence(0L, (_sent - 1 - _nth) div _n)"))).withColumn("_q", F.expr(f"(epoch * _n + _nth) div {block}"))
    return again.join(plan, ["_s", "_q"]).select(*docs.columns, "slot", "epoch", F.col("_q").alias("block"))
