"""Disorder and health of the memory store per user (A-11 … A-14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import quality as Q
from engram.functions import text as T
from engram.operators import clusters as C
from engram.operators.pairs import contradictions
from engram.session import cut


@dataclass
class Signals:
    """What disorder is measured by: members of duplicate groups, conflicts counted per user, rows in conflict."""

    members: DataFrame
    conflicts: DataFrame
    rows: DataFrame


def signals(memories: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> Signals:
    conflicts, rows = contradictions(memories, buckets)
    return Signals(cut(C.duplicate_clusters(memories)), conflicts, rows)


def store_entropy(memories: DataFrame, concepts: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS,
                  found: Signals | None = None) -> DataFrame:
    """Redundancy, conflicts, fragmentation, obsolescence and their weighted sum (A-11)."""
    found = found or signals(memories, buckets)
    low = (F.col("cognitive_state") == "decaying") | F.coalesce(F.col("memory_strength") < 0.2, F.lit(False))
    base = memories.groupBy("user_id").agg(F.count("*").alias("total_memories"), F.count_if(low).alias("_low"))
    dup = found.members.groupBy("user_id").agg(F.count("*").alias("_dup"), F.count_distinct("cluster_id").alias("duplicate_clusters"))
    thin = F.coalesce(F.when(F.col("support_count") != 0, F.col("support_count")), F.lit(1)) <= 1
    frag = concepts.groupBy("user_id").agg((F.count_if(thin) / F.count("*")).alias("fragmentation"))
    df = base.join(dup, "user_id", "left").join(found.conflicts, "user_id", "left").join(frag, "user_id", "left")
    n = F.col("total_memories")
    df = df.withColumns({
        "duplicate_clusters": F.coalesce("duplicate_clusters", F.lit(0)), "conflict_count": F.coalesce("conflict_count", F.lit(0)),
        "redundancy": F.coalesce("_dup", F.lit(0)) / n,
        "conflicts": F.least(F.lit(1.0), F.coalesce("conflict_count", F.lit(0)) / F.greatest(F.lit(1.0), n / 4)),
        "fragmentation": F.coalesce("fragmentation", F.lit(0.0)), "obsolete": F.col("_low") / n})
    return df.withColumn("entropy_score", Q.entropy_score(*[F.col(c) for c in ("redundancy", "conflicts", "fragmentation", "obsolete")])).drop("_dup", "_low")


def per_memory_entropy(memories: DataFrame, concepts: DataFrame, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS,
                       texts: DataFrame | None = None) -> DataFrame:
    """Rows in a duplicate group or a conflict carry the store score, the rest a low one (A-12).

    The store score looks at rows not forgotten, as the measurement does. ``texts`` (memory_id, memory_type, content) are for ``memories`` that carry none.
    """
    live = memories.filter(F.col("cognitive_state") != "forgotten")
    found = signals(live if texts is None else live.join(texts, ["memory_id", "memory_type"]), buckets)
    score = store_entropy(live, concepts, buckets, found).select("user_id", F.col("entropy_score").alias("_store"))
    flagged = found.members.select("memory_id").unionByName(found.rows).distinct().withColumn("_flag", F.lit(True))
    df = memories.join(flagged, "memory_id", "left").join(score, "user_id", "left")
    calm = F.least(F.coalesce("entropy_score", F.lit(0.0)), F.lit(0.05))
    return df.withColumn("entropy_score", F.when(F.col("_flag"), F.col("_store")).otherwise(calm)).select(*memories.columns)


def storage_growth(memories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Share of rows from the last days, and strength-weighted over raw tokens of active rows (A-14)."""
    tokens = T.budget_tokens(F.col("content"))
    active = ~F.col("cognitive_state").isin(*V.INACTIVE_STATES)
    known = F.coalesce(F.when(F.col("memory_strength") != 0, F.col("memory_strength")), F.lit(0.5))
    raw = F.sum(F.when(active, tokens))
    return memories.groupBy("user_id").agg(
        (F.count_if(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) / F.count("*")).alias("storage_growth_ratio"),
        F.coalesce(F.sum(F.when(active, tokens * known)) / raw, F.lit(1.0)).alias("token_efficiency"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed density per user; ``edges`` only between present nodes."""
    n = nodes.groupBy("user_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("user_id").agg(F.count("*").alias("n_edges"))
    df = n.join(e, "user_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    nn = F.col("n_nodes")
    return df.withColumn("density", F.when(nn > 1, F.col("n_edges") / (nn * (nn - 1))).otherwise(0.0))


def health_report(memories: DataFrame, concepts: DataFrame, concept_density: DataFrame, trait_density: DataFrame,
                  as_of: Column, buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> DataFrame:
    """Ratios, strengths, entropy, graph complexity and the health score per user (A-13).

    Entropy is taken over active rows; a user without any is measured over all of them.
    """
    active = ~F.col("cognitive_state").isin(*V.INACTIVE_STATES)
    strength = F.coalesce("memory_strength", F.lit(0.0))
    base = memories.groupBy("user_id").agg(
        F.count("*").alias("total_memories"), F.count_if(active).alias("active_memories"),
        (F.count_if(F.col("cognitive_state") == "forgotten") / F.count("*")).alias("forgotten_ratio"),
        (F.count_if(F.col("cognitive_state") == "archived") / F.count("*")).alias("archive_ratio"),
        F.avg(strength).alias("average_strength"),
        F.coalesce(F.avg(F.when(active, strength)), F.lit(0.0)).alias("average_strength_active"),
        F.avg(F.coalesce("decay_rate", F.lit(0.0))).alias("average_decay"))
    measured = (memories.join(base.select("user_id", "active_memories"), "user_id").filter(active | (F.col("active_memories") == 0))
                .select("user_id", "memory_id", "memory_type", "content", "cognitive_state", "memory_strength"))
    measured = cut(measured)
    entropy = store_entropy(measured, concepts, buckets).select("user_id", "redundancy", "entropy_score")
    graph = (base.select("user_id").join(concept_density.select("user_id", F.col("density").alias("_c")), "user_id", "left")
             .join(trait_density.select("user_id", F.col("density").alias("_t")), "user_id", "left")
             .select("user_id", Q.band_score((F.coalesce("_c", F.lit(0.0)) + F.coalesce("_t", F.lit(0.0))) / 2, 0.05, 0.45).alias("graph_complexity")))
    df = (base.join(entropy, "user_id", "left").join(graph, "user_id").join(storage_growth(memories, as_of), "user_id")
          .withColumn("duplicate_ratio", F.coalesce("redundancy", F.lit(0.0))).drop("redundancy"))
    return df.withColumn("cognitive_health_score", Q.health_score(
        F.col("duplicate_ratio"), F.col("archive_ratio"), F.col("forgotten_ratio"), F.col("average_strength_active"),
        F.coalesce("entropy_score", F.lit(0.0)), F.col("graph_complexity")))
