"""Greedy grouping in which groups pool the words of their members (C-04 … C-06).

Rows are taken in order. A row joins the first group, in order of creation, whose pooled words it overlaps enough, and its words join the pool; a row
without such a group opens one. Groups of rows with few words in all are settled in one task each, larger ones by rounds of joins; both
follow the same rule, so the bound decides where the work is done and never what comes out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from engram import vocab as V
from engram.operators.groups import BYTES_AT_ONCE, ROWS_AT_ONCE, starts, whole
from engram.operators.pairs import contradicts, distinct_pairs, distinct_sets
from engram.session import cut

#: Words of all rows together up to which one task settles a group of rows.
WORDS_IN_TASK = 1 << 18
#: Rows of a group up to which its sets meet as bits, and different words beyond which these are numbered anew.
ROWS_IN_BITS, WORDS_IN_BITS = 1 << 8, 1 << 14


def settle(sets: list[list[int]], threshold: float, apart: bool) -> list[int]:
    """The row whose group each row joins, for sets of small word numbers in order."""
    home, sizes, first = [], [], []
    pools: dict[int, set[int]] = {}
    rows: dict[int, list[int]] = {}
    members: list[int] = []
    for i, words in enumerate(sets):
        at = -1
        if words and sizes:
            shared = Counter(chain.from_iterable(pools.get(w, ()) for w in words))
            few = len(words)
            fits = [g for g in (sorted(shared) if threshold > 0 else range(len(sizes))) if sizes[g] and shared[g] / min(few, sizes[g]) >= threshold]
            if apart and fits:
                met = Counter(chain.from_iterable(rows.get(w, ()) for w in words))
                against = {members[r] for r, n in met.items() if 2 <= n < few and n < len(sets[r]) and n / min(len(sets[r]), few) >= V.CONTRADICT_AT}
                fits = [g for g in fits if g not in against]
            if fits:
                at = fits[0]
        if at < 0:
            at = len(sizes)
            sizes.append(0)
            first.append(i)
        members.append(at)
        home.append(first[at])
        for w in words:
            held = pools.setdefault(w, set())
            if at not in held:
                held.add(at)
                sizes[at] += 1
            if apart:
                rows.setdefault(w, []).append(i)
    return home


def settle_in_bits(sets: list[np.ndarray], n_words: int, threshold: float) -> list[int]:
    """What ``settle`` gives where nothing is kept apart, for few sets of word numbers below ``n_words``."""
    if n_words > WORDS_IN_BITS:
        used, at = np.unique(np.concatenate(sets), return_inverse=True)
        sets, n_words = np.split(at, np.cumsum([len(s) for s in sets])[:-1]), len(used)
    home, first, pools, sizes = [], [], [], []
    for i, words in enumerate(sets):
        row = np.zeros(n_words, bool)
        row[words] = True
        mine, few, at = int.from_bytes(np.packbits(row).tobytes()), len(words), -1
        if few:
            for g, size in enumerate(sizes):
                if size and (pools[g] & mine).bit_count() / min(few, size) >= threshold:
                    at = g
                    break
        if at < 0:
            at = len(first)
            first.append(i)
            pools.append(mine)
            sizes.append(few)
        else:
            pools[at] |= mine
            sizes[at] = pools[at].bit_count()
        home.append(first[at])
    return home


def _in_tasks(rows: DataFrame, keys: list[str], threshold: float, apart: bool) -> DataFrame:
    """(keys, id, leader) of groups of rows that one task can hold; a task walks many of them at a time."""
    kind = rows.schema["id"].dataType
    schema = StructType([*[rows.schema[k] for k in keys], StructField("id", kind), StructField("leader", kind)])

    def settled(table: pa.Table) -> pa.Table:
        words = table.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
        begins = np.concatenate([[0], ends[:-1]]).astype(int)
        at, home = [*starts(table, keys).tolist(), table.num_rows], []
        for a, b in zip(at, at[1:]):
            if not apart and b - a <= ROWS_IN_BITS:
                sets = [numbers[x:y] + 1 for x, y in zip(begins[a:b], ends[a:b])]
                home += [a + h for h in settle_in_bits(sets, len(coded.dictionary) + 1, threshold)]
            else:
                home += [a + h for h in settle([numbers[x:y].tolist() for x, y in zip(begins[a:b], ends[a:b])], threshold, apart)]
        return pa.table([*[table.column(k) for k in keys], table.column("id"), table.column("id").take(pa.array(home, pa.int64()))], [f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, keys, ROWS_AT_ONCE, BYTES_AT_ONCE):
            yield from settled(table).to_batches(max_chunksize=1 << 16)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "ord", "id").mapInArrow(run, schema)


def _by_rounds(rows: DataFrame, keys: list[str], threshold: float, apart: bool) -> DataFrame:
    """(keys, id, leader) by rounds in which every row is placed against the groups of the round before.

    An index holds when each word entered each pool, so a row sees every pool as it was before the row. After r rounds the first r rows of all are settled, in
    practice nearly all; it ends when no row moves. Rows meet groups, not other rows, so copies do not multiply.
    """
    base = cut(rows.select(*keys, "id", F.struct("ord", "id").alias("o"), "words", F.size("words").alias("n"), F.hex(F.xxhash64("words")).alias("sig")))
    postings = cut(base.select(*keys, "o", "n", F.explode("words").alias("w")))
    longest = base.agg(F.max("n")).first()[0] or 0
    placed = cut(base.select(*keys, "o", "sig", F.col("o").alias("leader")))
    conflicts = cut(_conflicts(base, keys)) if apart else None
    while True:
        index = cut(postings.join(placed.drop("sig"), [*keys, "o"]).groupBy(*keys, "leader", "w").agg(F.min("o").alias("since")))
        met = (postings.join(index, [*keys, "w"]).filter((F.col("leader") < F.col("o")) & (F.col("since") < F.col("o")))
               .groupBy(*keys, "o", "n", "leader").agg(F.count("*").alias("shared")))
        met = cut(met.filter(F.col("shared") > 0))
        sure = met.filter(F.col("shared") / F.col("n") >= threshold).select(*keys, "o", "leader")
        # else the pool must be smaller than the row: count its words at that time, no further than they matter
        led = base.select(*keys, F.col("o").alias("leader"), F.col("n").alias("_n"))
        most = F.floor(F.col("shared") / threshold + 1e-9) if threshold > 0 else F.lit(longest)
        unsure = met.filter(F.col("shared") / F.col("n") < threshold).withColumn("_most", most).join(led, [*keys, "leader"]).filter(F.col("_n") <= F.col("_most"))
        growth = index.withColumn("size", F.row_number().over(Window.partitionBy(*keys, "leader").orderBy("since", "w"))).filter(F.col("size") <= longest).drop("w")
        pooled = (unsure.join(growth, [*keys, "leader"]).filter((F.col("since") < F.col("o")) & (F.col("size") <= F.col("_most") + 1))
                  .groupBy(*keys, "o", "leader", "shared").agg(F.max("size").alias("pool")))
        small = pooled.filter(F.col("shared") / F.col("pool") >= threshold).select(*keys, "o", "leader")
        fits = sure.unionByName(small)
        if apart:
            seen = placed.groupBy(*keys, "leader", "sig").agg(F.min("o").alias("since")).withColumnRenamed("sig", "other")
            against = (fits.join(placed.select(*keys, "o", "sig"), [*keys, "o"]).join(conflicts, [*keys, "sig"]).join(seen, [*keys, "leader", "other"])
                       .filter(F.col("since") < F.col("o")).select(*keys, "o", "leader").distinct())
            fits = fits.join(against, [*keys, "o", "leader"], "left_anti")
        chosen = fits.groupBy(*keys, "o").agg(F.min("leader").alias("_leader"))
        moved = cut(placed.join(chosen, [*keys, "o"], "left").select(*keys, "o", "sig", F.coalesce("_leader", "o").alias("leader"), F.col("leader").alias("_old")))
        placed = moved.drop("_old")
        if moved.filter(F.col("leader") != F.col("_old")).isEmpty():
            return placed.select(*keys, F.col("o.id").alias("id"), F.col("leader.id").alias("leader"))


def _conflicts(base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sig, other): word sets that contradict each other, each pair both ways; equal sets are one."""
    _, sets = distinct_sets(base, keys, "sig", "words")
    pairs = distinct_pairs(sets, keys, V.CONTRADICT_AT, "overlap").filter(contradicts())
    return pairs.select(*keys, F.col("id_a").alias("sig"), F.col("id_b").alias("other")).unionByName(pairs.select(*keys, F.col("id_b").alias("sig"), F.col("id_a").alias("other")))


def leaders(df: DataFrame, keys: Sequence[str], id_col: str | Column, words: str | Column, order: str | Column, threshold: float, apart: bool = False,
            words_in_task: int = WORDS_IN_TASK) -> DataFrame:
    """(keys, id, leader): the first row of the group that each row joins.

    Overlap is the shared words over the smaller of row and pool. With ``apart`` a row never joins a group that holds an earlier row it contradicts. Rows
    are taken by ``order``, then id, and ids must be unique within ``keys``. Rows without words lead themselves.
    Words may be texts or numbers that stand for them.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = list(keys)
    kind = df.select(col(words).alias("words")).schema["words"].dataType
    every = cut(df.select(*keys, col(id_col).alias("id"), col(order).alias("ord"), F.array_distinct(F.coalesce(col(words), F.array().cast(kind))).alias("words")))
    large = cut(every.groupBy(*keys).agg(F.sum(F.size("words")).alias("_all")).filter(F.col("_all") > words_in_task).select(*keys))
    if large.isEmpty():
        return _in_tasks(every, keys, threshold, apart)
    small = _in_tasks(every.join(large, keys, "left_anti"), keys, threshold, apart)
    return small.unionByName(_by_rounds(every.join(large, keys, "left_semi").withColumn("words", F.sort_array("words")), keys, threshold, apart))
