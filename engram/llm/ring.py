"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``SLOTS`` places. Each shard owns several virtual nodes at hashed places, and a row belongs to the arc of the
first node at or after the place its text hashes to, so equal texts lie side by side. Loads are bounded exactly: the first
``n mod shards`` shards hold one row more than the others. A shard takes its own arcs in ring order up to its bound;
what overflows goes on clockwise, in ring order, to the next nodes whose shards have room. Only overflowing rows move.

Data meet the ring as counts: rows are counted per cell, a part of one place of bounded size, and the walk round the
ring runs over the nodes (shards * ``NODES`` of them, whatever the data). Rows are then numbered inside their cell, so a text that
a third of all rows share is sorted by many tasks.

A null text has no bytes and hashes to a place of its own; an empty one to another. A null doc_id is kept and sorts first.
Equal rows get neighbouring numbers in some order, which gives the same rows. Fewer rows than shards leave shards empty;
an empty table gives no rows. Other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import ranked
from engram.session import cut

#: Places of the ring and virtual nodes of a shard.
SLOTS, NODES = 8_192, 32
#: Rows of a cell on average.
CELL = 128


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("null")), text.isNull())


def nodes(spark: SparkSession, shards: int, per_shard: int = NODES, slots: int = SLOTS) -> DataFrame:
    """The ring: (node, shard, at) in clockwise order, at most one node at a place."""
    every = spark.range(shards * per_shard).select(F.expr(f"cast(id div {per_shard} as int)").alias("shard"), (F.col("id") % per_shard).alias("copy"))
    placed = every.select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "copy"), F.lit(slots)).alias("at"))
    # where two nodes fall together the smaller hash of place and shard stays
    single = placed.groupBy("at").agg(F.min_by("shard", F.xxhash64("at", "shard")).alias("shard"))
    return single.select(F.row_number().over(Window.orderBy("at")).alias("node"), "shard", "at")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, arc_shard) per row; arc_shard is where the ring alone would put it."""
    t = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), text_hash(t).alias("hash"))
    rows = cut(rows.withColumn("place", F.pmod("hash", F.lit(slots))))

    spark = docs.sparkSession
    counts = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"))  # at most ``slots`` rows
    ring = nodes(spark, shards, slots=slots)  # at most shards * NODES rows
    following = Window.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = Window.partitionBy()
    homes = cut(spark.range(slots).select(F.col("id").alias("place")).join(ring, F.col("place") == F.col("at"), "left")
                .withColumn("next", F.first("node", ignorenulls=True).over(following))
                # places behind the last node belong to the first one; they come last in its arc
                .select("place", F.coalesce("next", F.min("node").over(first)).alias("node"), F.col("next").isNull().alias("behind"))
                .join(counts, "place"))
    counted = ring.join(homes.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select(
        "node", "shard", F.coalesce("n", F.lit(0)).alias("n")).withColumn("total", F.sum("n").over(first))
    by_shard = Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)")
    own = (counted.withColumn("bound", bound)
           .withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
           .withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("bound") - F.col("before"))))
           .withColumn("over", F.col("n") - F.col("kept")))
    own = cut(own.withColumn("over_from", F.coalesce(F.sum("over").over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))

    # the walk: twice round the nodes; a node takes from the front of what overflowed so far as its shard has room
    room = (F.col("bound") - F.sum("kept").over(Window.partitionBy("shard"))).alias("room")
    steps = own.select("node", "shard", F.col("over").alias("more"), "over_from", "kept", room)
    walk = steps.agg(F.array_sort(F.collect_list(F.struct("node", "shard", "more", "over_from", "kept", "room"))).alias("steps")).withColumn("taken", F.expr(f"""
        aggregate(
          concat(steps, transform(steps, s -> named_struct('node', s.node, 'shard', s.shard, 'more', 0L, 'over_from', s.over_from, 'kept', s.kept, 'room', s.room))),
          named_struct('head', 0L, 'tail', 0L,
                       'room', transform(sequence(0, {shards - 1}), i -> coalesce(get(filter(steps, s -> s.shard = i), 0).room, 0L)),
                       'taken', cast(array() as array<struct<shard:int, start:bigint, stop:bigint>>)),
          (a, s) -> if(a.tail + s.more = a.head or a.room[s.shard] = 0,
            named_struct('head', a.head, 'tail', a.tail + s.more, 'room', a.room, 'taken', a.taken),
            named_struct('head', a.head + least(a.room[s.shard], a.tail + s.more - a.head), 'tail', a.tail + s.more,
              'room', transform(a.room, (r, i) -> if(i = s.shard, r - least(r, a.tail + s.more - a.head), r)),
              'taken', concat(a.taken, array(named_struct('shard', s.shard, 'start', a.head, 'stop', a.head + least(a.room[s.shard], a.tail + s.more - a.head))))))
        ).taken"""))
    # runs: rows [lo, hi) of a node's arc go to a shard
    kept = own.where("kept > 0").select("node", "shard", F.lit(0).cast("long").alias("lo"), F.col("kept").alias("hi"))
    moved = (walk.select("steps", F.explode("taken").alias("t"))
             .select("t", F.explode(F.filter("steps", lambda s: (s["over_from"] < F.col("t.stop")) & (s["over_from"] + s["more"] > F.col("t.start")))).alias("s"))
             .select("s.node", "t.shard", (F.greatest("t.start", "s.over_from") - F.col("s.over_from") + F.col("s.kept")).alias("lo"),
                     (F.least("t.stop", F.col("s.over_from") + F.col("s.more")) - F.col("s.over_from") + F.col("s.kept")).alias("hi")))
    runs = kept.unionByName(moved).withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(
        Window.partitionBy("shard").orderBy("node", "lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("lo"))
    plan = cut(runs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "shard", "base"))).alias("runs")))

    # where a place starts inside its arc, and how many cells it has
    inside = Window.partitionBy("node").orderBy("behind", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = homes.join(ring, "node").select("place", "node", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start"),
                                             F.expr(f"1 + n div {CELL}").alias("cells"), F.col("shard").alias("arc_shard"))
    known = F.broadcast(cut(starts.join(F.broadcast(plan), "node")))  # at most ``slots`` places
    placed = rows.join(known, "place")
    numbered = ranked(placed, "place", F.pmod(F.xxhash64("hash", "doc_id", "size"), F.col("cells")), ["hash", F.col("doc_id").asc_nulls_first()])
    nth = F.col("start") + F.col("nth")
    run = F.filter("runs", lambda r: (r["lo"] <= nth) & (nth < r["hi"]))[0]
    return numbered.withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"), (F.col("run.base") + nth).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "arc_shard")
