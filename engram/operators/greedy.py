"""Order-dependent choices over conflict pairs, without walking a group row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import cut


def losers(pairs: DataFrame) -> DataFrame:
    """Who drops out when rows are taken in order and a taken row excludes its later partners.

    ``pairs`` holds (first, second, rank): ``first`` precedes ``second`` and ``rank`` orders the
    firsts. Returns (loser, winner) with the earliest taken partner as winner. Each round takes every
    row that has no undecided predecessor, so rounds grow with the longest chain of
    decisions, not with the group; a hot group of copies ends in one round.
    """
    every = cut(pairs.select("first", "second", "rank"))
    edges, gone_all = every, None
    while not edges.isEmpty():
        taken = edges.select("first").distinct().join(edges.select(F.col("second").alias("first")).distinct(), "first", "left_anti")
        gone = cut(edges.join(taken, "first", "left_semi").select("second").distinct())
        gone_all = gone if gone_all is None else gone_all.unionByName(gone)
        edges = cut(edges.join(gone, "second", "left_anti")
                    .join(gone.withColumnRenamed("second", "first"), "first", "left_anti"))
    kept = every if gone_all is None else every.join(gone_all.withColumnRenamed("second", "first"), "first", "left_anti")
    return (kept.groupBy(F.col("second").alias("loser"))
            .agg(F.min_by("first", F.struct("rank", "first")).alias("winner")))
