"""Predicted usefulness of memories for queries (W-03, W-07, J-09, SC-34 … SC-40)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import relevance as R
from engram.operators.eligibility import retrievable
from engram.sources.store import top_per_group


#: Queries of a user whose words are looked for in a text together.
QUERIES_AT_ONCE = 64


def candidate_pool(memories: DataFrame, size: int = V.CANDIDATE_POOL, types: Sequence[str] | None = None) -> DataFrame:
    """The most important healthy rows per user (W-03); trimmed per partition before the shuffle."""
    rows = memories.filter(retrievable(None, types))
    return top_per_group(rows, ["user_id"], [F.desc("importance_score"), F.col("memory_id")], size, "pool_rank")


def user_traits(traits: DataFrame, limit: int = 30, min_confidence: float = 0.3) -> DataFrame:
    """Per user the leading traits as one array (W-07)."""
    top = top_per_group(traits.filter(F.col("confidence") >= min_confidence), ["user_id"],
                        [F.desc("importance"), F.col("node_id")], limit)
    item = F.struct("rank", F.col("node_type").alias("type"), F.col("node_value").alias("value"), "confidence", "importance",
                    R.trait_terms(F.col("node_value")).alias("term"))
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("traits"))


def user_concepts(concepts: DataFrame, limit: int = 50) -> DataFrame:
    top = top_per_group(concepts, ["user_id"], [F.desc("confidence"), F.col("concept_id")], limit)
    term, parts = R.concept_terms(F.col("concept_name"))
    item = F.struct("rank", F.col("concept_name").alias("name"), "description", "confidence", "support_count",
                    term.alias("term"), parts.alias("parts"))
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("concepts"))


def score_utility(candidates: DataFrame, queries: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column,
                  weights: Mapping[str, float] = V.UTILITY_WEIGHTS) -> DataFrame:
    """One row per (query, candidate of its user) with every dimension, the utility and its reason.

    ``queries`` comes from ``understand``. What does not depend on the query is worked out once per memory, before the rows multiply; a text is
    searched once for the words that ``QUERIES_AT_ONCE`` queries of its user, traits and concepts ask for.
    """
    content, kind = F.col("content"), F.col("memory_type")
    none = F.array().cast("array<string>")
    asked = queries.select("query_id", "user_id", "goal", "keywords", "required_knowledge")
    blocks = asked.groupBy("user_id").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).alias("_n"))
    asked = asked.join(blocks, "user_id").withColumn("_block", F.pmod(F.xxhash64("query_id"), "_n")).drop("_n")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none))))
    sought = asked.groupBy("user_id", "_block").agg(every("keywords").alias("_keywords"), every("required_knowledge").alias("_topics"))
    place = lambda c, within, after: F.transform(c, lambda x: after + F.array_position(within, x).cast("int") - 1)
    n_keywords, n_topics = F.size("_keywords"), F.size("_topics")
    asked = (asked.join(sought, ["user_id", "_block"])
             .withColumns({"_at": place("keywords", F.col("_keywords"), F.lit(0)), "_needs": place("required_knowledge", F.col("_topics"), n_keywords)}).drop("_keywords", "_topics"))
    items = [F.transform("_keywords", lambda k: F.array(k)), F.transform("_topics", R.topic_words), F.transform("traits", R.trait_words), F.transform("concepts", R.concept_words)]
    sought = (sought.join(user_traits(traits), "user_id", "left").join(user_concepts(concepts), "user_id", "left")
              .withColumns({"_items": F.concat(*[F.coalesce(x, F.array().cast("array<array<string>>")) for x in items]), "_first": n_keywords + n_topics}).drop("_keywords", "_topics"))
    found, first, n_traits = F.col("_found"), F.col("_first"), F.greatest(F.size("traits"), F.lit(0))
    per_memory = (candidates.join(sought, "user_id").withColumn("_found", R.contained(F.lower(content), F.col("_items"))).withColumns({
                      "identity_alignment": R.identity_alignment(content, kind, F.col("traits"), F.slice(found, first + 1, n_traits)),
                      "concept_relevance": R.concept_relevance(content, kind, F.col("concepts"), F.slice(found, first + 1 + n_traits, F.size(found))),
                      "importance": R.known_importance(F.col("importance_score")),
                      "reinforcement": R.reinforcement_blend(F.col("reinforcement_score"), F.col("memory_strength")),
                      "confidence": R.stability(F.col("memory_strength"), F.col("decay_rate")),
                      "recency": R.exponential_recency(as_of, F.coalesce("last_accessed", "created_at")),
                      "_hit": F.slice(found, F.lit(1), first),
                  }).drop("traits", "concepts", "_items", "_first", "_found"))
    hits = tuple(F.size(F.filter(c, lambda i: F.get("_hit", i))) for c in ("_at", "_needs"))
    both = per_memory.join(asked, ["user_id", "_block"]).withColumn(
        "goal_alignment", R.goal_alignment(content, kind, F.col("keywords"), F.col("required_knowledge"), hits)).drop("_block", "_hit", "_at", "_needs")
    dims = {n: F.col(n) for n in V.UTILITY_WEIGHTS}
    return (both.withColumn("utility_score", R.utility(dims, kind, weights))
            .withColumn("selection_reason", R.selection_reason(dims, weights)))
