"""Fitting rows into a budget and dropping near copies (C-03, C-07 … C-09).

Groups are the candidates of one query, at most the pool size; folds over them stay small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from engram import vocab as V
from engram.operators.groups import starts, whole


def _fill(items: Column, budget: Column, used: Column) -> Column:
    """Ids taken in order while they still fit; rows that do not fit are passed over."""
    start = F.struct(used.cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + item["cost"] <= budget
        return F.when(fits, F.struct((acc["used"] + item["cost"]).alias("used"),
                                     F.array_append(acc["kept"], item["id"]).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step)


def fill_in_order(rows: DataFrame, key: str, id_col: str, order: str, cost: str, budget: int,
                  used: str | None = None) -> DataFrame:
    """Sequential fill in rank order (C-09). ``used`` names tokens already spent per group."""
    item = F.struct(F.col(order).alias("o"), F.col(id_col).cast("long").alias("id"), F.col(cost).cast("long").alias("cost"))
    spent = F.max(used) if used else F.lit(0)
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"), spent.alias("_used"))
    packed = grouped.withColumn("_p", _fill(F.col("_items"), F.lit(budget), F.coalesce("_used", F.lit(0))))
    return packed.select(key, F.col("_p.used").alias("used_tokens"), F.col("_p.kept").alias("kept_ids"))


def fill_by_ratio(rows: DataFrame, key: str, id_col: str, value: str, cost: str, budget: int) -> DataFrame:
    """Greedy value-per-token fill (C-08): the chosen rows, unchanged."""
    ratio = F.round(-F.col(value) / F.greatest(F.lit(1), F.col(cost)), 15)
    packed = fill_in_order(rows.withColumn("_ratio", F.struct(ratio, F.col(id_col))), key, id_col, "_ratio", cost, budget)
    chosen = packed.select(key, F.explode("kept_ids").alias(id_col))
    return rows.join(chosen, [key, id_col], "left_semi")


def knapsack_mask(values: np.ndarray, costs: np.ndarray, budget: int) -> np.ndarray:
    """Best subset by value under a cost limit; of equal subsets the one built from earlier rows."""
    best = np.zeros(budget + 1)
    took = np.zeros((len(values), budget + 1), dtype=bool)
    for i, (value, cost) in enumerate(zip(values.tolist(), costs.tolist())):
        if cost <= budget:
            with_row = best[: budget + 1 - cost] + value
            better = np.greater(with_row, best[cost:], out=took[i, cost:])
            np.copyto(best[cost:], with_row, where=better)
    mask, left = np.zeros(len(values), dtype=bool), budget
    for i in range(len(values) - 1, -1, -1):
        if took[i, left]:
            mask[i] = True
            left -= int(costs[i])
    return mask


def optimize_budget(rows: DataFrame, key: str, id_col: str, budget: int, value: str = "utility_score",
                    cost: str = "token_cost", method: str = "exact") -> DataFrame:
    """Rows worth their tokens, whatever their number: ``method`` "exact" solves the knapsack (C-07), "ratio" fills by value per token (C-08).

    The exact way holds a table of rows x budget for one group; groups are candidate pools, bounded by definition.
    """
    if budget <= 0:
        return rows.limit(0)
    feasible = rows.filter(F.col(cost) <= budget)
    if method == "ratio":
        return rows.join(fill_by_ratio(feasible, key, id_col, value, cost, budget).select(key, id_col), [key, id_col], "left_semi")

    schema = StructType([rows.schema[key], StructField("id", rows.schema[id_col].dataType)])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, [key]):
            at = starts(table, [key])
            group = pa.array(np.searchsorted(at, np.arange(table.num_rows), "right"))
            table = table.append_column("_group", group).sort_by([("_group", "ascending"), ("value", "descending"), ("id", "ascending")])
            values, costs = table.column("value").to_numpy().astype(float), table.column("cost").to_numpy()
            mask = [knapsack_mask(values[a:b], costs[a:b], budget) for a, b in zip(at, [*at[1:], table.num_rows])]
            yield from table.select([key, "id"]).filter(pa.array(np.concatenate(mask))).to_batches(max_chunksize=1 << 16)

    exact = (feasible.select(key, F.col(id_col).alias("id"), F.col(value).cast("double").alias("value"), F.col(cost).cast("long").alias("cost"))
             .repartition(key).sortWithinPartitions(key).mapInArrow(choose, schema).withColumnRenamed("id", id_col))
    return rows.join(exact, [key, id_col], "left_semi")


def drop_near_copies(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], id_col: str, score: str) -> DataFrame:
    """Keep the better of near copies (C-03): a row goes when a kept, better row is its near copy.

    ``pairs`` lists near copies once as (id_a, id_b). Only rows that have one are folded.
    """
    both = pairs.select(F.col("id_a").alias(id_col), F.col("id_b").alias("_other")).unionByName(
        pairs.select(F.col("id_b").alias(id_col), F.col("id_a").alias("_other")))
    partners = both.groupBy(id_col).agg(F.collect_set("_other").alias("_others"))
    item = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("id"), F.col("_others").alias("others"))
    folded = rows.join(partners, id_col).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(F.array().cast("array<long>").alias("kept"), F.array().cast("array<long>").alias("gone"))

    def step(acc: Column, row: Column) -> Column:
        taken = F.arrays_overlap(acc["kept"], row["others"])
        return F.when(taken, F.struct(acc["kept"].alias("kept"), F.array_append(acc["gone"], row["id"].cast("long")).alias("gone"))) \
            .otherwise(F.struct(F.array_append(acc["kept"], row["id"].cast("long")).alias("kept"), acc["gone"].alias("gone")))

    gone = folded.select(*keys, F.explode(F.aggregate("_items", start, step)["gone"]).alias(id_col))
    return rows.join(gone, [*keys, id_col], "left_anti")
