"""Consolidation of episodic and semantic rows into concepts (P-06)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.operators import analytics as A
from engram.operators import clusters as C
from engram.operators.density import density_clusters
from engram.operators.eligibility import consolidation_candidates, sound_concept
from engram.operators.graph import connected_components
from engram.operators.labels import top_word_label
from engram.operators.pairs import vector_pairs
from engram.session import cut


def concept_edges(vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """related_to edges between concepts of a user with close vectors (J-04). Vectors: (user_id, concept_id, embedding)."""
    pairs = vector_pairs(vectors, ["user_id"], "concept_id", threshold, strict=True)
    return pairs.select("user_id", F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.lit("related_to").alias("type"), F.col("score").alias("strength"))


def cluster_concepts(members: DataFrame, metrics: DataFrame, memories: DataFrame) -> DataFrame:
    """A concept per cluster, named by its leading words, as confident as it is tight.

    Names and descriptions from a landed response (SRC-07) replace these where one exists.
    """
    texts = members.join(memories.select("memory_id", "content"), "memory_id")
    labels = top_word_label(texts, ["user_id", "cluster_id"], "content", 3)
    per = members.groupBy("user_id", "cluster_id").agg(F.count("*").alias("support_count"), F.array_sort(F.collect_list("memory_id")).alias("supporting_memory_ids"))
    tight = metrics.select("cluster_id", "confidence", F.col("centroid").alias("embedding"))
    return (per.join(labels, ["user_id", "cluster_id"], "left").join(tight, "cluster_id")
            .select("user_id", F.col("cluster_id").alias("concept_id"), F.coalesce("label", F.concat(F.lit("concept_"), F.col("cluster_id").cast("string"))).alias("concept_name"),
                    F.concat(F.lit("Consolidated from "), F.col("support_count").cast("string"), F.lit(" related memories")).alias("description"),
                    "confidence", "support_count", "supporting_memory_ids", "embedding"))


@dataclass
class Consolidated:
    """What one consolidation run leaves behind."""

    memories: DataFrame
    concepts: DataFrame
    edges: DataFrame
    members: DataFrame
    metrics: DataFrame


def consolidate(memories: DataFrame, vectors: DataFrame, min_importance: float = 0.6, min_similarity: float = V.CLUSTER_AT,
                min_confidence: float = 0.7) -> Consolidated:
    """Cluster candidates, fold redundant rows together, derive concepts and their graph (P-06).

    At most the newest thousand rows of a user take part, by definition of the candidates.
    """
    candidates = cut(consolidation_candidates(memories, min_importance).drop("rank"))
    own = cut(candidates.select("user_id", "memory_id").join(vectors.select("memory_id", "embedding"), "memory_id"))
    found = cut(density_clusters(own, ["user_id"], "memory_id", min_similarity))
    members, metrics = C.merge_similar_clusters(cut(C.cluster_metrics(found, own)), found)
    members, metrics = cut(members), cut(metrics)
    redundant = vector_pairs(members.join(own.select("memory_id", "embedding"), "memory_id"), ["user_id", "cluster_id"], "memory_id", V.REDUNDANT_AT)
    groups = connected_components(redundant.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))).select(F.col("id").alias("memory_id"), "component")
    merged = cut(C.merge_groups(memories, groups))
    concepts = cut(cluster_concepts(members, metrics, memories).filter(sound_concept(min_confidence)))
    edges = concept_edges(concepts)
    support = concepts.select(F.explode("supporting_memory_ids").alias("memory_id")).distinct().withColumn("_s", F.lit(True))
    out = (C.apply_merge(memories, merged).join(support, "memory_id", "left")
           .withColumn("cognitive_state", F.when(F.col("_s"), "semantic_candidate").otherwise(F.col("cognitive_state"))).drop("_s"))
    return Consolidated(out, concepts, edges, members, A.consolidation_metrics(candidates, members, concepts, edges))
