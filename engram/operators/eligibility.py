"""Row filters (FLT-01 … FLT-19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import text as T
from engram.functions.relevance import whole_days
from engram.sources.store import top_per_group


def retrievable(min_importance: float | None = 0.0, types: Sequence[str] | None = None) -> Column:
    """Healthy rows only; an unknown strength or entropy passes (FLT-01). Pushes down to the scan."""
    ok = (~F.col("cognitive_state").isin(*V.INACTIVE_STATES)
          & (F.col("memory_strength").isNull() | (F.col("memory_strength") >= V.RETRIEVAL_MIN_STRENGTH))
          & (F.col("entropy_score").isNull() | (F.col("entropy_score") <= V.RETRIEVAL_MAX_ENTROPY)))
    if min_importance is not None:
        ok = ok & (F.col("importance_score") >= min_importance)
    return ok & F.col("memory_type").isin(*types) if types else ok


def consolidation_candidates(memories: DataFrame, min_importance: float = 0.6, newest: int = 1000) -> DataFrame:
    """The newest important episodic and semantic rows per user (FLT-02)."""
    rows = memories.filter(F.col("memory_type").isin("episodic", "semantic")
                           & F.col("cognitive_state").isin("active", "reinforced", "semantic_candidate")
                           & (F.col("importance_score") >= min_importance))
    return top_per_group(rows, ["user_id"], [F.desc("created_at"), F.col("memory_id")], newest)


def revivable() -> Column:
    return F.col("cognitive_state").isin(*V.REVIVABLE_STATES)


def active() -> Column:
    return ~F.col("cognitive_state").isin(*V.INACTIVE_STATES)


def search_concepts(concepts: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Concepts of the asking user whose name or description holds the term, most confident first (FLT-06)."""
    term = F.lower("term")
    hit = F.contains(F.lower("concept_name"), term) | F.contains(F.lower("description"), term)
    found = concepts.join(queries.select("query_id", "user_id", "term"), "user_id").filter(hit)
    return top_per_group(found, ["query_id"], [F.desc("confidence"), F.col("concept_id")], limit)


def list_concepts(concepts: DataFrame, min_confidence: float = 0.5, limit: int = 50) -> DataFrame:
    rows = concepts.filter(F.col("confidence") >= min_confidence)
    return top_per_group(rows, ["user_id"], [F.desc("confidence"), F.col("concept_id")], limit)


def event_trail(events: DataFrame, event_type: str | None = None, newest: int = 50) -> DataFrame:
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return top_per_group(rows, ["user_id", "memory_id"], [F.desc("ts"), F.desc("event_id")], newest)


def recent_history(history: DataFrame, as_of: Column, days: int, event_type: str | None = None,
                   newest: int = 100) -> DataFrame:
    rows = history.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    if event_type is not None:
        rows = rows.filter(F.col("event_type") == event_type)
    return top_per_group(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], newest)


def sound_concept(min_confidence: float = 0.7, min_support: int = 2, min_name: int = 3, min_text: int = 20) -> Column:
    """Quality gate of a generated concept (FLT-10)."""
    return ((F.col("confidence") >= min_confidence) & (F.col("support_count") >= min_support)
            & (F.length("concept_name") >= min_name) & (F.length("description") >= min_text))


def emerging_trait(min_confidence: float = 0.6, max_evidence: int = 3) -> Column:
    return (F.col("confidence") >= min_confidence) & (F.col("evidence_count") <= max_evidence)


def fading_traits(traits: DataFrame, as_of: Column, idle_days: int = 30, min_decay: float = 0.1) -> DataFrame:
    """Traits that lost evidence, with how much they should lose (FLT-12)."""
    days = whole_days(as_of, F.col("last_reinforced_at"))
    return (traits.filter((F.col("last_reinforced_at") < as_of - F.make_dt_interval(F.lit(idle_days)))
                          & (F.col("confidence") > 0.3))
            .withColumn("decay_amount", days * F.col("decay_rate")).filter(F.col("decay_amount") >= min_decay))


def stance_memories(memories: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS,
                    types: Sequence[str] | None = None) -> DataFrame:
    """Rows that state a preference or choice, with their verb bucket (FLT-13, FLT-17)."""
    rows = memories if types is None else memories.filter(F.col("memory_type").isin(*types))
    return rows.withColumn("verb_bucket", T.stance_bucket(F.col("content"), buckets)).filter(F.col("verb_bucket").isNotNull())


def not_retired() -> Column:
    return ~F.coalesce(F.col("retired"), F.lit(False))


def users_to_reinforce(traits: DataFrame, as_of: Column, min_confidence: float = 0.7, days: int = 7) -> DataFrame:
    """Users with a strong trait not reinforced lately (FLT-15)."""
    return (traits.filter((F.col("confidence") >= min_confidence)
                          & (F.col("last_reinforced_at") < as_of - F.make_dt_interval(F.lit(days))))
            .select("user_id").distinct())


def owned_rows(rows: DataFrame, users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of users that the given tenants own (FLT-16)."""
    return rows.join(users.join(tenants.select("tenant_id"), "tenant_id", "left_semi").select("user_id"),
                     "user_id", "left_semi")


def newest(rows: DataFrame, keys: Sequence[str], moment: str, key: str, n: int) -> DataFrame:
    """Newest N rows per group: logs, snapshots, projects, decisions (FLT-18, FLT-19, W-02)."""
    return top_per_group(rows, keys, [F.desc(moment), F.desc(key)], n)
