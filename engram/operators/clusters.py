"""Grouping near-duplicates and related rows, and rolling the groups up (C-01 … C-06, A-19 … A-24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import text as T
from engram.operators.greedy import losers
from engram.operators.labels import one_new_word_each, top_word_label, top_words
from engram.operators.leaders import leaders
from engram.operators.pairs import vector_pairs
from engram.session import cut
from engram.sources.store import event_log, top_per_group


def leader_clusters(df: DataFrame, keys: Sequence[str], id_col: str, words: str, threshold: float,
                    exclude_conflicts: bool = False, order: str | None = None, min_size: int = 2) -> DataFrame:
    """(keys, id, cluster_id) of groups found by taking rows in order (C-04 … C-06).

    A row joins the first group whose pooled words it overlaps by at least ``threshold`` (overlap coefficient) and opens one
    otherwise; ``cluster_id`` is the row that opened it. With ``exclude_conflicts`` a row never joins a group that holds an
    earlier row it contradicts. The rule is the same for a group of any size (see ``leaders``).
    """
    keys = list(keys)
    placed = cut(leaders(df, keys, id_col, words, order or id_col, threshold, exclude_conflicts).withColumnRenamed("leader", "cluster_id"))
    sizes = placed.groupBy(*keys, "cluster_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    return placed.join(sizes.drop("_n"), [*keys, "cluster_id"], "left_semi").withColumnRenamed("id", id_col)


# ---- duplicates ----------------------------------------------------------------
def duplicate_clusters(memories: DataFrame, threshold: float = V.DUPLICATE_AT) -> DataFrame:
    """Near-duplicate groups of a user's mergeable rows, contradictions kept apart (C-04)."""
    rows = (memories.filter(F.col("memory_type").isin(*V.DUPLICATE_TYPES))
            .withColumn("_w", T.word_set(F.col("content"), V.STOPWORDS)))
    return leader_clusters(rows, ["user_id"], "memory_id", "_w", threshold, exclude_conflicts=True)


def merge_duplicates(memories: DataFrame, members: DataFrame, as_of: Column,
                     concepts: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories, concepts, evidence, events): each group makes or feeds a concept, its rows are archived (A-21).

    Evidence stays a table of (user_id, concept_name, memory_id): a group of copies may hold a
    large share of all rows, too many for one array. ``texts`` (memory_id, content) are for ``memories`` that carry none.
    """
    said = members.join((memories if texts is None else texts).select("memory_id", "content"), "memory_id")
    named = top_words(said, ["user_id", "cluster_id"], "content", 1).select(
        "user_id", "cluster_id", F.concat(T.capitalize(F.col("word")), F.lit(" Interest")).alias("concept_name"))
    sized = members.groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"))
    clusters = (sized.join(named, ["user_id", "cluster_id"], "left")
                .withColumn("concept_name", F.coalesce("concept_name", F.concat(F.lit("concept_"), F.col("cluster_id").cast("string")))))
    # groups of one user that got the same name feed one concept
    per_name = clusters.groupBy("user_id", "concept_name").agg(F.sum("n").alias("_n"), F.max_by("n", -F.col("cluster_id")).alias("_first_n"))
    if concepts is not None:
        known = concepts.groupBy("user_id", "concept_name").agg(F.max("confidence").alias("_conf"), F.max("support_count").alias("_support"))
        per_name = per_name.join(known, ["user_id", "concept_name"], "left")
    else:
        per_name = per_name.withColumns({"_conf": F.lit(None).cast("double"), "_support": F.lit(None).cast("long")})
    fresh = 0.5 + 0.1 * F.col("_first_n") + 0.05 * (F.col("_n") - F.col("_first_n"))
    made = per_name.select(
        "user_id", "concept_name",
        F.when(F.col("_conf").isNull(), F.concat(F.lit("Consolidated from "), F.col("_first_n").cast("string"), F.lit(" related memories"))).alias("description"),
        F.least(F.lit(1.0), F.coalesce(F.col("_conf") + 0.05 * F.col("_n"), fresh)).alias("confidence"),
        (F.coalesce("_support", F.lit(0)) + F.col("_n")).alias("support_count"))
    fate = (members.join(clusters.select("user_id", "cluster_id", "concept_name", "n"), ["user_id", "cluster_id"])
            .join(made.select("user_id", "concept_name", F.col("confidence").alias("_c")), ["user_id", "concept_name"]))
    evidence = fate.select("user_id", "concept_name", "memory_id")
    fate = cut(fate.select("memory_id", F.col("concept_name").alias("_name"), F.col("n").alias("_size"), "_c"))  # read for rows and for events
    df = memories.join(fate, "memory_id", "left")
    hit = F.col("_name").isNotNull()
    reason = F.concat(F.lit("Merged into concept '"), "_name", F.lit("'"))
    moved = df.filter(hit).withColumns({"old_state": F.col("cognitive_state"), "new_state": F.lit("archived"),
                                        "old_strength": F.col("memory_strength"), "new_strength": F.col("memory_strength")})
    events = event_log(moved, "merge", F.concat(reason, F.lit(" ("), F.col("_size").cast("string"), F.lit(" duplicates consolidated)")), F.col("_c"), as_of)
    old_reason = F.col("archive_reason") if "archive_reason" in memories.columns else F.lit(None).cast("string")
    out = df.withColumns({"cognitive_state": F.when(hit, "archived").otherwise(F.col("cognitive_state")),
                          "archive_reason": F.when(hit, reason).otherwise(old_reason)})
    return out.select(*memories.columns, *([] if "archive_reason" in memories.columns else ["archive_reason"])), made, evidence, events


# ---- vectors ---------------------------------------------------------------------
def cluster_metrics(members: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("user_id",), id_col: str = "memory_id") -> DataFrame:
    """Size, centroid and mean pairwise similarity per group (A-20).

    The pair mean follows from the summed unit vectors, so no pair is formed.
    """
    v = members.join(vectors.select(id_col, "embedding"), id_col)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dims = (v.withColumn("_len", length).select(*keys, "cluster_id", "_len", F.posexplode("embedding").alias("pos", "x"))
            .groupBy(*keys, "cluster_id", "pos")
            .agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"),
                 F.sum(F.when(F.col("_len") > 0, F.col("x").cast("double") / F.col("_len")).otherwise(0.0)).alias("unit")))
    packed = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    stats = dims.groupBy(*keys, "cluster_id").agg(
        F.max("n").alias("member_count"), F.transform(packed, lambda s: s["mean"]).alias("centroid"),
        F.sum(F.col("unit") * F.col("unit")).alias("_sq"))
    n = F.col("member_count")
    mean = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("_sq") - n) / (n * (n - 1)))).otherwise(0.0)
    return stats.withColumn("avg_similarity", mean).withColumn("confidence", F.col("avg_similarity")).drop("_sq")


def merge_similar_clusters(metrics: DataFrame, members: DataFrame, keys: Sequence[str] = ("user_id",),
                           threshold: float = V.CENTROID_MERGE_AT) -> tuple[DataFrame, DataFrame]:
    """(members, metrics) after an earlier cluster took the later ones near its centroid (C-02).

    What absorbs keeps its centroid and pair mean, counts all members and is as confident as the most confident of them.
    """
    keys = list(keys)
    pairs = vector_pairs(metrics, keys, "cluster_id", threshold, embedding="centroid")
    moves = cut(losers(pairs.select(F.col("id_a").alias("first"), F.col("id_b").alias("second"), F.col("id_a").alias("rank")))
                .select(F.col("loser").alias("cluster_id"), F.col("winner").alias("_into")))
    to = lambda df: df.join(moves, "cluster_id", "left").withColumn("_into", F.coalesce("_into", "cluster_id"))
    own = F.col("cluster_id") == F.col("_into")
    merged = to(metrics).groupBy(*keys, "_into").agg(
        F.sum("member_count").alias("member_count"), F.max(F.when(own, F.struct("centroid", "avg_similarity"))).alias("_own"), F.max("confidence").alias("confidence"))
    return (to(members).drop("cluster_id").withColumnRenamed("_into", "cluster_id"),
            merged.select(*keys, F.col("_into").alias("cluster_id"), "member_count", "_own.centroid", "_own.avg_similarity", "confidence"))


def merge_groups(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group built from its members, others dropped (A-19). ``groups``: (memory_id, component).

    The merged summary needs at most 1,000 characters, so the texts are cut before they gather and
    members beyond the first thousand cannot reach it.
    """
    rows = memories.join(groups, "memory_id")
    dims = [f"{n}_score" for n in V.SCORE_NAMES]
    order = F.struct((-F.col("importance_score")).alias("i"), F.col("memory_id").alias("id"))
    text = F.substring(F.coalesce("summary", "content"), 1, 1001)
    leading = top_per_group(rows.withColumn("_t", text), ["component"], [F.desc("importance_score"), F.col("memory_id")], 1001, "_r")
    joined = leading.groupBy("component").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]), " ").alias("_joined"))
    merged = rows.groupBy("component").agg(
        F.min_by("memory_id", order).alias("memory_id"), F.min_by("user_id", order).alias("user_id"),
        F.least(F.lit(1.0), F.max("importance_score")).alias("importance_score"),
        *[F.avg(d).alias(d) for d in dims], F.count("*").alias("n_merged"),
        F.array_sort(F.collect_set("memory_id")).alias("_ids")).join(joined, "component")
    summary = F.when(F.length("_joined") > 1000, F.concat(F.substring("_joined", 1, 1000), F.lit("..."))).otherwise(F.col("_joined"))
    return (merged.withColumn("summary", summary).withColumn("merged_from", F.array_remove(F.col("_ids"), F.col("memory_id")))
            .drop("_ids", "_joined"))


def apply_merge(memories: DataFrame, merged: DataFrame) -> DataFrame:
    """Memories with primaries updated and the other members removed."""
    gone = merged.select(F.explode("merged_from").alias("memory_id"))
    dims = ["importance_score", *[f"{n}_score" for n in V.SCORE_NAMES], "summary"]
    new = merged.select("memory_id", *[F.col(d).alias(f"_{d}") for d in dims])
    kept = memories.join(gone, "memory_id", "left_anti").join(new, "memory_id", "left")
    return kept.withColumns({d: F.coalesce(f"_{d}", d) for d in dims}).drop(*[f"_{d}" for d in dims])


# ---- concepts --------------------------------------------------------------------
def concept_words() -> Column:
    return T.word_set(F.concat(F.translate(F.coalesce("concept_name", F.lit("")), "_", " "), F.lit(" "),
                               F.coalesce("description", F.lit(""))), V.STOPWORDS)


def live_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.filter(~F.coalesce("retired", F.lit(False)))


def concept_clusters(concepts: DataFrame, threshold: float = V.MERGE_AT, min_size: int = 2) -> DataFrame:
    rows = live_concepts(concepts).withColumn("_w", concept_words())
    return leader_clusters(rows, ["user_id"], "concept_id", "_w", threshold, min_size=min_size)


def merge_concepts(concepts: DataFrame, members: DataFrame) -> DataFrame:
    """Concepts after merging groups: the most confident member absorbs the rest, which retire (A-22)."""
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("concept_id").alias("id"))
    rows = concepts.join(members.select("concept_id", "cluster_id"), "concept_id")
    per = rows.groupBy("cluster_id").agg(
        F.min_by("concept_id", order).alias("_primary"),
        F.sum(F.when(F.col("support_count") != 0, F.col("support_count")).otherwise(1)).alias("_support"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_memory_ids")))).alias("_ids"),
        F.least(F.lit(1.0), F.max(F.coalesce("confidence", F.lit(0.0))) + 0.05 * (F.count("*") - 1)).alias("_conf"))
    df = concepts.join(members.select("concept_id", "cluster_id"), "concept_id", "left").join(per, "cluster_id", "left")
    grouped, primary = F.col("_primary").isNotNull(), F.col("concept_id") == F.col("_primary")
    return df.withColumns({
        "support_count": F.when(grouped & primary, F.col("_support")).otherwise(F.col("support_count")),
        "supporting_memory_ids": F.when(grouped & primary, F.col("_ids")).otherwise(F.col("supporting_memory_ids")),
        "confidence": F.when(~grouped, F.col("confidence")).when(primary, F.col("_conf")).otherwise(0.0),
        "retired": F.coalesce(F.col("retired"), F.lit(False)) | (grouped & ~primary),
        "merged_into": F.when(grouped & ~primary, F.col("_primary")),
    }).drop("cluster_id", "_primary", "_support", "_ids", "_conf")


def generalized_concepts(concepts: DataFrame) -> DataFrame:
    """New broader concepts for groups of related ones whose label is not taken yet (A-22)."""
    members = concept_clusters(concepts, V.GENERALIZE_AT, V.GENERALIZE_MIN_GROUP)
    rows = concepts.join(members.select("concept_id", "cluster_id"), "concept_id")
    labels = top_word_label(rows, ["user_id", "cluster_id"], "concept_name", 3)
    per = rows.groupBy("user_id", "cluster_id").agg(
        F.least(F.lit(1.0), F.avg(F.when(F.col("confidence") != 0, F.col("confidence")).otherwise(0.5)) + 0.1).alias("confidence"),
        F.sum(F.when(F.col("support_count") != 0, F.col("support_count")).otherwise(1)).alias("support_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_memory_ids")))).alias("supporting_memory_ids"),
        F.array_sort(F.collect_list("concept_id")).alias("related_concept_ids"))
    made = per.join(labels, ["user_id", "cluster_id"], "left").withColumn(
        "concept_name", F.coalesce("label", F.concat(F.lit("Generalized Concept "), F.col("cluster_id").cast("string")))).drop("label")
    # two groups may arrive at one label; the earlier group keeps it
    first = top_per_group(made, ["user_id", "concept_name"], [F.col("cluster_id")], 1, "_r").drop("_r")
    return first.join(concepts.select("user_id", "concept_name"), ["user_id", "concept_name"], "left_anti")


def strengthen_concepts(concepts: DataFrame, as_of: Column) -> DataFrame:
    ok = ~F.coalesce("retired", F.lit(False)) & (F.col("support_count") >= 3) & (F.coalesce("confidence", F.lit(0.0)) < 0.95)
    return concepts.withColumns({
        "last_reinforced_at": F.when(ok, as_of).otherwise(F.col("last_reinforced_at")),
        "confidence": F.when(ok, F.least(F.lit(1.0), F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(0.5)) + 0.03)).otherwise(F.col("confidence"))})


def retire_concepts(concepts: DataFrame, as_of: Column) -> DataFrame:
    stale = (~F.coalesce("retired", F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) <= V.RETIRE_CONFIDENCE)
             & (F.coalesce("last_reinforced_at", "created_at") <= as_of - F.make_dt_interval(F.lit(V.RETIRE_DAYS))))
    return concepts.withColumns({"retired": F.coalesce("retired", F.lit(False)) | F.coalesce(stale, F.lit(False)),
                                 "confidence": F.when(stale, 0.0).otherwise(F.col("confidence"))})


def synthesized_concepts(concepts: DataFrame) -> DataFrame:
    """Per user a new concept from the strongest few, unless its label exists (A-23)."""
    rows = live_concepts(concepts).filter(F.col("confidence") >= V.SYNTHESIS_CONFIDENCE)
    top = top_per_group(rows, ["user_id"], [F.desc("confidence"), F.col("concept_id")], V.SYNTHESIS_MAX)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "concept_name", "concept_id")))
    per = top.groupBy("user_id").agg(
        ordered.alias("_o"), F.count("*").alias("_n"), F.least(F.lit(1.0), F.avg("confidence")).alias("confidence"),
        F.sum(F.when(F.col("support_count") != 0, F.col("support_count")).otherwise(1)).alias("support_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_memory_ids")))).alias("supporting_memory_ids"))
    made = per.filter((F.col("_n") >= V.SYNTHESIS_MIN) & (F.col("confidence") >= V.SYNTHESIS_CONFIDENCE)).select(
        "user_id", one_new_word_each(F.transform("_o", lambda s: s["concept_name"])).alias("concept_name"),
        F.concat(F.lit("Synthesized from: "), F.array_join(F.transform("_o", lambda s: s["concept_name"]), ", ")).alias("description"),
        "confidence", "support_count", "supporting_memory_ids", F.transform("_o", lambda s: s["concept_id"]).alias("related_concept_ids"))
    return made.join(concepts.select("user_id", "concept_name"), ["user_id", "concept_name"], "left_anti")


def refreshed_concept(concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Concepts with new evidence (concept_id, confidence, memory_ids): mean confidence, id union (A-36)."""
    e = evidence.select("concept_id", F.col("confidence").alias("_c"), F.col("memory_ids").alias("_new"))
    df = concepts.join(e, "concept_id", "left")
    fresh = F.col("_new").isNotNull() & (F.size(F.array_except(F.col("_new"), F.col("supporting_memory_ids"))) > 0)
    union = F.array_union("supporting_memory_ids", "_new")
    return df.withColumns({
        "confidence": F.when(fresh, F.least(F.lit(1.0), (F.col("confidence") + F.coalesce("_c", F.lit(0.85))) / 2)).otherwise(F.col("confidence")),
        "support_count": F.when(fresh, F.size(union)).otherwise(F.col("support_count")),
        "supporting_memory_ids": F.when(fresh, union).otherwise(F.col("supporting_memory_ids")),
        "refreshed": fresh}).drop("_c", "_new")


# ---- traits ------------------------------------------------------------------------
def trait_clusters(traits: DataFrame, threshold: float = V.TRAIT_DUPLICATE_AT) -> DataFrame:
    rows = traits.filter(~F.coalesce("retired", F.lit(False))).withColumn(
        "_w", T.word_set(F.translate("node_value", "_", " "), V.STOPWORDS))
    return leader_clusters(rows, ["user_id", "node_type"], "node_id", "_w", threshold)


def merge_traits(traits: DataFrame, members: DataFrame) -> DataFrame:
    """Traits after merging duplicates into the one with most confidence times importance (A-24)."""
    weight = -(F.coalesce("confidence", F.lit(0.0)) * F.coalesce("importance", F.lit(0.0)))
    order = F.struct(F.round(weight, 12).alias("w"), F.col("node_id").alias("id"))
    rows = traits.join(members.select("node_id", "cluster_id"), "node_id")
    per = rows.groupBy("cluster_id").agg(
        F.min_by("node_id", order).alias("_primary"),
        F.sum(F.when(F.col("evidence_count") != 0, F.col("evidence_count")).otherwise(1)).alias("_evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_memory_ids")))).alias("_ids"), F.count("*").alias("_n"))
    df = traits.join(members.select("node_id", "cluster_id"), "node_id", "left").join(per, "cluster_id", "left")
    grouped, primary = F.col("_primary").isNotNull(), F.col("node_id") == F.col("_primary")
    known = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(0.5))
    return df.withColumns({
        "evidence_count": F.when(grouped & primary, F.col("_evidence")).otherwise(F.col("evidence_count")),
        "supporting_memory_ids": F.when(grouped & primary, F.col("_ids")).otherwise(F.col("supporting_memory_ids")),
        "confidence": F.when(~grouped, F.col("confidence")).when(primary, F.least(F.lit(1.0), known + 0.05 * (F.col("_n") - 1))).otherwise(known * 0.3),
        "retired": F.coalesce(F.col("retired"), F.lit(False)) | (grouped & ~primary),
    }).drop("cluster_id", "_primary", "_evidence", "_ids", "_n")
