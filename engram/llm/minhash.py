"""Near-duplicate documents with bottom-k sketches from one hash function.

The sketch of a document is the ``k`` smallest hashes of its distinct word shingles. Texts with equal sets are one class from the start.
Two sets similar enough share a number of sketch values: all that the threshold asks for where both sketches are whole sets, else
at least ``needed(k)`` of them but for one link in 10^10. Hence

1. values that one class alone holds say nothing, and a class with too few shared values has no partner;
2. the classes left are taken with their full sets: a value that one of them alone holds is no overlap either, and the smaller of
   two similar sets shares 2t / (1 + t) of its values with the larger, the larger t. A class short of both has no partner.
   Of the shared values of the others, rarest first, only as many enter the inverted lists that two partners must meet there;
3. members of a list are first held against one member each, twice, by exact Jaccard on the full sets, which joins large groups
   of copies with few comparisons;
4. what still lies in different components of a list is compared in bounded blocks by exact Jaccard on the full sets, which travel
   with the members, not with pairs of them. No list, pair or candidate is capped.

A document without words has an empty set and is linked with nothing. Each row is a document; equal rows get equal results. A null
doc_id is a member of its class and never its smallest id unless all are null. An empty table gives no rows. Other columns do not take part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import among, components, free, lists, slices
from engram.llm.shingles import shingle_sets
from engram.session import cut, discard

K = 64
#: Members of a list that one comparison block holds, and about how many values of their sets.
BLOCK, VALUES = 512, 1 << 17


@cache
def needed(k: int, percent: int, risk: float = 1e-10) -> int:
    """Sketch values that two sets at the threshold share but for ``risk``: the smallest k of the union fall in both with that chance."""
    t, below, i = percent / 100, 0.0, 0
    while i < k:
        below += comb(k, i) * t**i * (1 - t) ** (k - i)
        if below > risk:
            break
        i += 1
    return i


def _sets(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, text_key, node, n, sketch) per row; node is a hash of the set, null for an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                sets = shingle_sets(batch.column("text"), words)
                node = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
                sketch = [s[:k].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     lists(np.concatenate(sketch), np.array([len(s) for s in sketch]), pa.int64())], ["doc_id", "text_key", "node", "n", "sketch"])

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, n long, sketch array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, n, full): the whole set in rising order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                sets = shingle_sets(batch.column("text"), words)
                n = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()), pa.array(n, pa.int64()),
                                                  lists(np.concatenate(sets).view(np.int64), n, pa.int64())], ["node", "n", "full"])

    return docs.mapInArrow(run, "node long, n long, full array<long>")


def _shared(members: DataFrame) -> DataFrame:
    """(node, n, v, c): values that more than one node holds, and how many do."""
    held = members.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return members.join(held, "v").select("node", "n", "v", "c")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs)
    few = among(sets, "node", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    x, y = few.select(F.col("node").alias("a"), F.col("full").alias("x")), few.select(F.col("node").alias("b"), F.col("full").alias("y"))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _meetings(members: DataFrame, what: list[str]) -> tuple[DataFrame, DataFrame]:
    """(v, same, own, others) for the members of each list (v, blocks) packed into blocks, every two of which meet once; and the table of blocks they are read from."""
    own = cut(members.withColumn("i", F.pmod(F.xxhash64("node", "v"), "blocks").cast("int"))
              .groupBy("v", "blocks", "i").agg(F.collect_list(F.struct(*what)).alias("own")))
    mates = own.where("i > 0").select("v", F.col("i").alias("j"), F.col("own").alias("others"))
    later = own.where("i < blocks - 1").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)))
    meetings = own.select("v", F.lit(True).alias("same"), "own", F.lit(None).cast(own.schema["own"].dataType).alias("others")).unionByName(
        later.join(mates, ["v", "j"]).select("v", F.lit(False).alias("same"), "own", "others"))
    return meetings, own


def _partnered(meetings: DataFrame, percent: int) -> DataFrame:
    """(v, node, n, component, left) of members that meet one of another component which sizes and what is left of their sets do not rule out."""
    names = ["node", "n", "component", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, v in enumerate(batch.column("v").to_pylist()):
                one = [batch.column("own")[row].values.field(c).to_numpy(zero_copy_only=False) for c in names]
                same = batch.column("same")[row].as_py()
                two = one if same else [batch.column("others")[row].values.field(c).to_numpy(zero_copy_only=False) for c in names]
                (_, n, component, left), (_, n_, component_, left_) = one, two
                fits = (np.not_equal.outer(component, component_) & (np.minimum.outer(left, left_) * (100 + percent) >= percent * np.add.outer(n, n_))
                        & (100 * np.minimum.outer(n, n_) >= percent * np.maximum.outer(n, n_)))
                for side, has in ((one, fits.any(axis=1)),) if same else ((one, fits.any(axis=1)), (two, fits.any(axis=0))):
                    if has.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(has.sum(), v)), *(pa.array(x[has]) for x in side)], ["v", *names])

    return meetings.mapInArrow(run, "v long, node long, n long, component long, left int").distinct()


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """The number of values that each set of ``one`` shares with each of ``two``: products of 0/1 matrices of some values at a time."""
    n = np.array([len(s) for s in (*one, *two)])
    sets = np.repeat(np.arange(len(n)), n)
    values, at, held = np.unique(np.concatenate([*one, *two]), return_inverse=True, return_counts=True)
    twice = held > 1
    place, shared = np.cumsum(twice) - 1, twice[at]
    order = np.argsort(place[at][shared], kind="stable")
    sets, place = sets[shared][order], place[at][shared][order]
    out = np.zeros((len(one), len(two)), np.int64)
    for start in range(0, int(twice.sum()), columns):
        here = slice(*np.searchsorted(place, [start, start + columns]))
        bits = np.zeros((len(n), min(columns, int(twice.sum()) - start)), np.float32)  # counts below 2^24 are exact
        bits[sets[here], place[here] - start] = 1
        out += (bits[:len(one)] @ bits[len(one):].T).astype(np.int64)
    return out


def _linked(meetings: DataFrame, percent: int) -> DataFrame:
    """(a, b) of similar sets of different components, by exact Jaccard on full sets; of the links between what already hangs together in a meeting one stays."""
    def side(members: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        full = members.field("full")
        at, values = full.offsets.to_numpy(), full.values.to_numpy()
        sets = [values[x:y] for x, y in itertools.pairwise(at)]
        return members.field("node").to_numpy(), members.field("component").to_numpy(), sets, np.diff(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for row, same in enumerate(batch.column("same").to_pylist()):
                node, component, sets, n = side(batch.column("own")[row].values)
                node_, component_, sets_, n_ = (node, component, sets, n) if same else side(batch.column("others")[row].values)
                both = _overlaps(sets, sets_)
                similar = np.not_equal.outer(component, component_) & (100 * both >= percent * (np.add.outer(n, n_) - both))
                root: dict[int, int] = {}

                def end(x: int, root: dict[int, int] = root) -> int:
                    while (up := root.get(x, x)) != x:
                        root[x] = x = root.get(up, up)
                    return x

                for i, j in np.argwhere(np.triu(similar) if same else similar).tolist():
                    x, y = end(int(component[i])), end(int(component_[j]))
                    if x != y:
                        root[x] = y
                        links.append((int(node[i]), int(node_[j])))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

    return cut(meetings.mapInArrow(run, "a long, b long").distinct())


def _grouped(docs: DataFrame, key: str, text: str, words: int, percent: int, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows as ``_sets`` gives them, and (node, root) of classes that are linked with others.

    Tables and shuffle files go as soon as the steps that read them are done, so the disk holds those of one step.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    base = cut(_sets(docs, words, k))
    classes = base.where("n > 0").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes)

    postings = classes.select("node", "n", F.explode("sketch").alias("v"))
    held = postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # a set so small that all its partners are whole in their sketches shares what the threshold asks for
    wanted = F.when(100 * F.col("n") <= percent * k, F.expr(f"({percent} * n + 99) div 100")).otherwise(F.lit(needed(k, percent)))
    open_ = cut(postings.join(held, "v").groupBy("node", "n").agg(F.count(F.lit(1)).alias("h")).where(F.col("h") >= wanted).select("node"))
    needed_texts = cut(classes.join(open_, "node", "left_semi").select("text_key"))
    discard(classes)
    free(spark)
    # an inner join, as a semi join would be moved below the bitmap and shuffle every text; what it repeats is one node
    texts = among(docs.select("text_key", "text"), "text_key", needed_texts).join(needed_texts, "text_key")
    sets = cut(_full_sets(texts.select("text"), words).dropDuplicates(["node"]))
    free(spark)

    members = cut(_shared(sets.select("node", "n", F.explode("full").alias("v"))))
    free(spark)
    fit = cut(members.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n")).where(f"100 * h >= {percent} * n").select("node"))
    free(spark)
    held = _shared(members.join(fit, "node", "left_semi").select("node", "n", "v")).groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("c", "v"))).alias("held"))
    as_larger = F.expr(f"size(held) - ({percent} * n + 99) div 100")
    keys = cut(held.withColumn("larger", as_larger).where("larger >= 0")
               .select("node", "n", F.size("held").alias("h"), F.posexplode(F.expr("slice(held, 1, cast(larger + 1 as int))")).alias("nth", "e"))
               .select("node", "n", F.col("e.v").alias("v"), (F.col("h") - F.col("nth")).alias("left")))
    # two partners meet at the first value they share, and from there on each still holds what they must share; in a
    # list where nobody holds enough for a partner of its own size there is no pair
    able = F.max(F.col("left") * (100 + percent) >= 2 * percent * F.col("n"))
    every, keys = keys, cut(keys.join(keys.groupBy("v").agg(able.alias("able"), F.count(F.lit(1)).alias("c")).where("able and c > 1").select("v"), "v", "left_semi"))
    discard(every)
    discard(members)
    free(spark)
    open_ = keys.select("node").distinct()

    links, labels = None, open_.withColumn("component", F.col("node"))
    for salt in (None, 1):
        # one member of each list stands for it: the smallest, then any
        pick = F.col("node") if salt is None else F.xxhash64("node", "v", F.lit(salt))
        at = keys.join(labels, "node")
        leader = at.groupBy("v").agg(F.min_by(F.struct("node", "n", "component", "left"), pick).alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
        stars = (at.join(leader.where("low <> high"), "v").where((F.col("component") != F.col("first.component")) &
                 (100 * F.least("n", "first.n") >= percent * F.greatest("n", "first.n")) &
                 (F.least("left", "first.left") * (100 + percent) >= percent * (F.col("n") + F.col("first.n"))))
                 .select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct())
        found = _verified(stars, sets, percent)
        links = found if links is None else links.unionByName(found)
        free(spark)
        labels = cut(open_.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
        free(spark)

    at = keys.join(labels, "node")
    mixed = at.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    # members are packed into blocks first, and blocks of a list meet, not members; full sets travel only for members that have a partner left
    meetings, packed = _meetings(at.join(mixed.select("v", "c"), "v").withColumn("blocks", F.expr(f"cast(1 + c div {block} as int)")), ["node", "n", "component", "left"])
    partnered = cut(_partnered(meetings, percent))
    discard(packed, keys)
    free(spark)
    many = partnered.groupBy("v").agg(F.expr(f"cast(1 + greatest(count(1) div {block}, sum(n) div {VALUES}) as int)").alias("blocks"))
    whole = among(sets, "node", partnered.select("node")).select("node", "full")
    meetings, packed = _meetings(partnered.join(many, "v").join(whole, "node"), ["node", "component", "full"])
    last = _linked(meetings, percent)
    discard(sets, packed, partnered)
    roots = components(links.unionByName(last)).select("node", F.col("component").alias("root"))
    free(spark)
    return base, roots


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, copies): the first doc_id and hash of the text in each group, no doc_id last, and how many equal rows have it.

    Each row without words is a group of its own; such rows come once with ``copies`` 1, as all of them stay.
    """
    base, labels = _grouped(docs, key, text, words, percent, k, block)
    rows = base.where("node is not null").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = rows.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "copies")).alias("first"))
    empty = base.where("node is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("copies")).distinct()
    return first.select("first.doc_id", "first.text_key", "first.copies").unionByName(empty)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    base, labels = _grouped(docs, key, text, words, percent, k, block)
    ids = base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left")
    known = ids.withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(smallest, "root").select("node", "component_id")
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
