"""Personalised context, response guidance and explanations (P-13, P-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import vocab as V
from engram.operators import identity as I
from engram.sources.store import top_per_group


def personalized_context(queries: DataFrame, traits: DataFrame, concepts: DataFrame, words=V.TRAIT_QUERY_WORDS, top_concepts: int = 10) -> DataFrame:
    """Relevant traits, reranked concepts, style, instructions and a routing hint per query (P-13)."""
    chosen = I.relevant_traits(queries, traits, words=words)
    item = F.struct("rank", F.col("node_type").alias("type"), F.col("node_value").alias("value"), "confidence", "relevance")
    per = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("traits"), F.avg("confidence").alias("_t"))
    asked = queries.select("query_id", "user_id", "query")
    boosted = I.concepts_by_identity(concepts, chosen).select("query_id", "concept_id", "concept_name", "confidence", "relevance_to_identity")
    plain = concepts.join(asked.join(chosen.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "user_id"), "user_id").select(
        "query_id", "concept_id", "concept_name", "confidence", F.col("confidence").alias("relevance_to_identity"))
    top = top_per_group(boosted.unionByName(plain), ["query_id"], [F.desc(F.round("relevance_to_identity", 12)), F.col("concept_id")], top_concepts)
    named = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept_name"))), lambda s: s["concept_name"]).alias("concepts"), F.avg("confidence").alias("_c"))
    df = asked.join(per, "query_id", "left").join(named, "query_id", "left").join(I.communication_style(traits), "user_id", "left")
    none = F.array().cast("array<string>")
    kinds = F.coalesce(F.transform("traits", lambda t: t["type"]), none)
    habits = F.coalesce(F.transform(F.filter("traits", lambda t: t["type"] == "behavior"), lambda t: t["value"]), none)
    return df.select("query_id", "user_id", F.coalesce(F.transform("traits", lambda t: t["value"]), none).alias("trait_values"), F.coalesce("concepts", none).alias("concepts"),
                     F.coalesce("primary_style", F.lit("standard")).alias("primary_style"),
                     I.instructions(F.coalesce("primary_style", F.lit("standard")), habits).alias("instructions"), I.routing_hint(kinds).alias("routing_hint"),
                     F.coalesce((F.col("_t") + F.col("_c")) / 2, F.lit(0.0)).alias("confidence_level"))


def response_guidance(traits: DataFrame) -> DataFrame:
    """Style, summary, interests, goals and skill level per user (P-13)."""
    lists = I.profile(traits).groupBy("user_id").pivot("node_type", ["goal", "interest", "skill", "value"]).agg(F.first("items"))
    none = F.array().cast("array<string>")

    def names(c: str, n: int | None = None) -> Column:
        items = F.transform(c, lambda s: s["value"])
        return F.coalesce(F.slice(items, 1, n) if n else items, none)

    level = F.aggregate("skill", F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size("skill")
    df = lists.select("user_id", names("goal").alias("goals"), names("interest", 3).alias("key_interests"), names("value").alias("values"),
                      I.skill_level(F.when(F.size("skill") > 0, level)).alias("skill_level"))
    return df.join(I.profile_text(traits), "user_id", "left").join(I.communication_style(traits).select("user_id", "primary_style"), "user_id", "left")


# ---- P-14 ------------------------------------------------------------------------------
def explain_memories(memories: DataFrame, events: DataFrame, newest: int | None = None) -> DataFrame:
    """State and reasons of each memory with its lifecycle events, a row for each, newest first; ``newest`` keeps so many (P-14).

    A memory without events has one row without them.
    """
    order = [F.desc("timestamp"), F.col("event_type")]
    trail = (events.withColumn("rank", F.row_number().over(Window.partitionBy("memory_id").orderBy(*order))) if newest is None
             else top_per_group(events, ["memory_id"], order, newest))
    keep = [c for c in ("utility_score", "selection_reason", "archive_reason", "forget_reason") if c in memories.columns]
    told = trail.select("memory_id", "rank", "event_type", "old_state", "new_state", "reason", "confidence")
    return memories.select("memory_id", "user_id", "content", "cognitive_state", *keep).join(told, "memory_id", "left")


def explain_latest(log: DataFrame, moment: str, key: str) -> DataFrame:
    """Latest run row per user."""
    return log.groupBy("user_id").agg(F.max_by(F.struct(*log.columns), F.struct(moment, key)).alias("r")).select("r.*")


def explain_decisions(decisions: DataFrame, newest: int = 10) -> DataFrame:
    return top_per_group(decisions, ["user_id"], [F.desc("ts"), F.desc("decision_id")], newest)
