"""The offline pass: replay, discovery, refinement, healing, evolution, synthesis (P-07, P-09)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import lifecycle as L
from engram.functions import scoring as S
from engram.functions import text as T
from engram.operators import analytics as A
from engram.operators import clusters as C
from engram.operators import graph as G
from engram.operators import identity as I
from engram.operators import utility as UT
from engram.operators.eligibility import active
from engram.operators.extract import discover_patterns
from engram.operators.memberships import recent_identity_flags, with_flag
from engram.operators.pairs import contradictory_pairs
from engram.operators.understanding import required_knowledge
from engram.plans.evolution import supersede
from engram.session import cut, spread
from engram.sources.store import reclaim_vectors, top_per_group


def select_for_replay(memories: DataFrame, traits: DataFrame, as_of: Column, batch: int = V.REPLAY_BATCH,
                      buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS) -> DataFrame:
    """The rows of each user most worth a second look (W-10, SC-57)."""
    rows = memories.filter(active())
    pairs = contradictory_pairs(rows, buckets)
    torn = pairs.select(F.explode(F.array("id_a", "id_b")).alias("memory_id")).distinct()
    df = with_flag(recent_identity_flags(rows, traits, as_of), torn, "conflicting")
    predicted = F.col("prediction_confidence") if "prediction_confidence" in memories.columns else F.lit(None).cast("double")
    df = df.withColumn("replay_priority", L.replay_priority(F.col("importance_score"), predicted, F.col("memory_strength"), F.col("reinforcement_count"),
                                                            F.col("recent_identity"), F.col("conflicting")))
    return top_per_group(df, ["user_id"], [F.desc(F.round("replay_priority", 12)), F.col("memory_id")], batch, "replay_rank")


def rescore(rows: DataFrame, lexicon: S.Lexicon = S.DEFAULT) -> DataFrame:
    """Heuristic scores from scratch for replayed rows."""
    made = S.heuristic_scores(F.col("content"), F.col("memory_type"), lexicon)
    df = rows.withColumns({f"_{n}": made[n] for n in V.SCORE_NAMES})
    return df.withColumn("_importance", S.weighted_importance({n: F.col(f"_{n}") for n in V.SCORE_NAMES}))


def replay(memories: DataFrame, chosen: DataFrame, lexicon: S.Lexicon = S.DEFAULT) -> DataFrame:
    """Memories with the chosen rows scored anew; reinforcement is left as it is."""
    names = [n for n in V.SCORE_NAMES if n != "reinforcement"]
    new = rescore(chosen, lexicon).select("memory_id", *[f"_{n}" for n in names], "_importance")
    df = memories.join(new, "memory_id", "left")
    return df.withColumns({**{f"{n}_score": F.coalesce(f"_{n}", f"{n}_score") for n in names},
                           "importance_score": F.coalesce("_importance", "importance_score")}).drop(*[f"_{n}" for n in names], "_importance")


def future_goals(traits: DataFrame, signals=V.GOAL_SIGNALS, flags: str = T.ANY_CASE, limit: int = 3) -> DataFrame:
    """Up to three goals a user's leading goals and interests point to, else the default one."""
    rows = traits.filter(F.col("node_type").isin("goal", "interest") & (F.col("confidence") >= 0.4))
    top = top_per_group(rows, ["user_id"], [F.desc("importance"), F.col("node_id")], 5)
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_value"))), lambda s: F.lower(F.translate(s["node_value"], "_", " ")))
    text = top.groupBy("user_id").agg(F.array_join(words, " ").alias("t"))
    hits = []
    for goal, patterns in signals.items():
        hit = F.lit(False)
        for p, _ in patterns:
            hit = hit | F.col("t").rlike(flags + p)
        hits.append(F.when(hit, F.lit(goal)))
    found = F.slice(F.array_compact(F.array(*hits)), 1, limit)
    goals = text.select("user_id", found.alias("goals"))
    every = traits.select("user_id").distinct().join(goals, "user_id", "left")
    return every.select("user_id", F.when(F.size("goals") > 0, F.col("goals")).otherwise(F.array(F.lit(V.DEFAULT_GOAL))).alias("goals"))


def forward_utility(memories: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column, signals=V.GOAL_SIGNALS,
                    knowledge: Mapping[str, Sequence[str]] = V.GOAL_KNOWLEDGE, flags: str = T.ANY_CASE) -> DataFrame:
    """Mean utility of active rows for their user's likely goals, and what follows from it (P-09)."""
    rows = memories.filter(active())
    goals = rows.select("user_id").distinct().join(future_goals(traits, signals, flags), "user_id", "left")
    asked = goals.select("user_id", F.posexplode(F.coalesce("goals", F.array(F.lit(V.DEFAULT_GOAL)))).alias("pos", "goal"))
    queries = asked.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("pos").cast("string")).alias("query_id"), "user_id", "goal",
                           T.keywords(F.translate("goal", "_", " ")).alias("keywords"), required_knowledge(F.col("goal"), knowledge).alias("required_knowledge"))
    scored = UT.score_utility(rows, queries, traits, concepts, as_of)
    mean = scored.groupBy("user_id", "memory_id").agg(F.avg("utility_score").alias("future_utility"), F.first("memory_strength").alias("_s"))
    weak = F.col("future_utility") < V.FUTURE_WEAK_AT
    strength = F.when(weak, F.greatest(F.lit(0.0), F.coalesce("_s", F.lit(0.5)) * V.FUTURE_WEAK_FACTOR)).otherwise(F.col("_s"))
    df = mean.withColumn("memory_strength", strength)
    action = F.when(~weak, "keep").when(F.col("memory_strength") < V.ARCHIVE_AT, "flag_for_archive").otherwise("weaken")
    return df.withColumn("action", action).drop("_s")


def refine_concepts(concepts: DataFrame, as_of: Column) -> DataFrame:
    """Merge, generalise, strengthen and retire (A-22). New concepts carry no id yet."""
    merged = cut(C.merge_concepts(concepts, C.concept_clusters(concepts)))
    wider = C.generalized_concepts(merged).drop("cluster_id").withColumn("created_at", as_of).withColumn("last_reinforced_at", F.lit(None).cast("timestamp")).withColumn("retired", F.lit(False))
    grown = C.strengthen_concepts(merged.unionByName(wider, allowMissingColumns=True), as_of)
    return C.retire_concepts(grown, as_of)


@dataclass
class Offline:
    """What one offline pass leaves behind."""

    memories: DataFrame
    vectors: DataFrame
    concepts: DataFrame
    traits: DataFrame
    edges: DataFrame
    shifts: DataFrame
    discovered: DataFrame
    events: DataFrame
    session: DataFrame


def offline_pass(memories: DataFrame, vectors: DataFrame, concepts: DataFrame, traits: DataFrame, edges: DataFrame, as_of: Column,
                 buckets: Mapping[str, Sequence[str]] = V.STANCE_BUCKETS, lexicon: S.Lexicon = S.DEFAULT, patterns=V.HIGHER_ORDER_PATTERNS,
                 signals=V.GOAL_SIGNALS, knowledge: Mapping[str, Sequence[str]] = V.GOAL_KNOWLEDGE, flags: str = T.ANY_CASE) -> Offline:
    """One pass over all users, in stages that each see the stage before (P-07)."""
    # read by several stages, and by few tasks where a well packed file holds them
    concepts, traits = cut(spread(concepts, "concept_id")), cut(spread(traits, "node_id"))
    chosen = cut(select_for_replay(memories, traits, as_of, buckets=buckets))
    replayed = cut(replay(memories, chosen, lexicon))
    discovered = cut(discover_patterns(replayed, concepts, traits, patterns))
    refined = cut(refine_concepts(concepts, as_of))
    settled, events = supersede(replayed, as_of, buckets)
    settled, events = cut(settled), cut(events)
    healed = cut(C.merge_traits(traits, C.trait_clusters(traits)))
    shifts = cut(I.identity_shifts(healed, as_of))
    shifted = I.apply_shifts(healed, shifts, as_of)
    pruned = G.prune_nodes(refined, "support_count", F.size(F.coalesce("related_concept_ids", F.array().cast("array<long>"))) > 0
                           if "related_concept_ids" in refined.columns else F.lit(False)).drop("pruned")
    pruned = cut(pruned)
    made = C.synthesized_concepts(pruned).withColumn("retired", F.lit(False)).withColumn("created_at", as_of)
    final_concepts = cut(pruned.unionByName(made, allowMissingColumns=True))
    final_traits = cut(G.prune_nodes(shifted, "evidence_count").drop("pruned"))
    stronger = G.strengthen_edges(edges).drop("strengthened")
    forward = cut(forward_utility(settled, final_traits, final_concepts, as_of, signals, knowledge, flags))
    weak = forward.select("memory_id", F.col("memory_strength").alias("_s"), F.col("action"))
    final = (settled.join(weak, "memory_id", "left")
             .withColumn("memory_strength", F.when(F.col("action").isin("weaken", "flag_for_archive"), F.col("_s")).otherwise(F.col("memory_strength"))).drop("_s", "action"))

    def per_user(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.count("*").alias(name))

    session = memories.select("user_id").distinct()
    for df, name in [(chosen, "memories_replayed"), (discovered, "patterns_discovered"), (events, "contradictions_resolved"), (shifts, "identity_shifts"),
                     (made, "knowledge_synthesized"), (forward.filter("action <> 'keep'"), "memories_weakened")]:
        session = session.join(per_user(df, name), "user_id", "left")
    session = session.fillna(0).join(A.storage_compression(final).select("user_id", "storage_compression_ratio"), "user_id", "left").withColumn("finished_at", as_of)
    return Offline(final, reclaim_vectors(vectors, final), final_concepts, final_traits, stronger, shifts, discovered, events, session)
