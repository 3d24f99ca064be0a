"""Which memories support a concept or a trait (J-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def supported_ids(rows: DataFrame, ids: str = "supporting_memory_ids") -> DataFrame:
    return rows.select(F.explode(ids).alias("memory_id")).distinct()


def with_flag(memories: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return (memories.join(ids.withColumn(name, F.lit(True)), "memory_id", "left")
            .withColumn(name, F.coalesce(name, F.lit(False))))


def membership_flags(memories: DataFrame, concepts: DataFrame, traits: DataFrame) -> DataFrame:
    flagged = with_flag(memories, supported_ids(concepts), "in_concept")
    return with_flag(flagged, supported_ids(traits), "in_identity")


def recent_identity_flags(memories: DataFrame, traits: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = traits.filter(F.col("last_reinforced_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return with_flag(memories, supported_ids(recent), "recent_identity")
