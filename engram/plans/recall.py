"""Retrieval with compression and predictive recall (P-01, P-02, P-03, P-15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions import text as T
from engram.operators import packing as K
from engram.operators import pairs as PR
from engram.operators import retrieval as RT
from engram.operators import utility as UT
from engram.session import cut
from engram.sources.store import retrieval_log


# ---- P-01, P-02 --------------------------------------------------------------
def compressed_context(ranked: DataFrame, queries: DataFrame, budget: int = V.RETRIEVAL_BUDGET) -> DataFrame:
    """Profile block and as many context lines as the budget holds, per query."""
    profiles = RT.profile_text(ranked)
    base = (queries.select("query_id", "user_id", "query").join(profiles, "query_id", "left")
            .withColumn("user_profile", F.coalesce("user_profile", F.lit("No prior context."))))
    lines = RT.context_lines(ranked).join(base.select("query_id", T.tokens(F.col("user_profile")).alias("profile_tokens")), "query_id")
    packed = K.fill_in_order(lines, "query_id", "memory_id", "rank", "tokens", budget, "profile_tokens")
    kept = packed.select("query_id", F.explode("kept_ids").alias("memory_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n")
    body = lines.join(kept, ["query_id", "memory_id"]).groupBy("query_id").agg(text.alias("_body"), F.count("*").alias("lines_kept"))
    heading = F.concat(F.lit("Query: "), "query", F.lit("\n\nRelevant Context:"))
    raw = ranked.groupBy("query_id").agg(
        (F.floor((F.sum(F.length("content") + 3) - 1) / 4)).cast("long").alias("raw_tokens"), F.count("*").alias("source_memory_count"))
    return (base.join(packed.select("query_id", "used_tokens"), "query_id", "left").join(body, "query_id", "left")
            .join(raw, "query_id", "left")
            .select("query_id", "user_id", "user_profile", F.concat_ws("\n", heading, "_body").alias("context_summary"),
                    F.coalesce("used_tokens", T.tokens(F.col("user_profile"))).alias("estimated_tokens"),
                    F.coalesce("raw_tokens", F.lit(0).cast("long")).alias("raw_tokens"),
                    F.coalesce("source_memory_count", F.lit(0).cast("long")).alias("source_memory_count"),
                    F.coalesce("lines_kept", F.lit(0).cast("long")).alias("lines_kept")))


def retrieve_and_compress(memories: DataFrame, vectors: DataFrame, queries: DataFrame, as_of: Column, k: int = 10,
                          budget: int = V.RETRIEVAL_BUDGET, min_importance: float = 0.0,
                          types: Sequence[str] | None = None) -> DataFrame:
    ranked = RT.with_text(RT.retrieve(memories, vectors, queries, as_of, k, min_importance, types), memories)
    return compressed_context(ranked, queries, budget)


def reconstruct(memories: DataFrame, vectors: DataFrame, queries: DataFrame, as_of: Column, k: int = 10,
                budget: int = V.RETRIEVAL_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(context, log) with the reconstruction defaults (P-02)."""
    ranked = RT.with_text(RT.retrieve(memories, vectors, queries, as_of, k, 0.2), memories)
    return (compressed_context(ranked, queries, budget), retrieval_log(RT.context_lines(ranked), queries, as_of))


# ---- P-03 --------------------------------------------------------------------
def rank_selected(rows: DataFrame, score: str = "utility_score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "memory_id")
    return rows.withColumn("retrieval_rank", F.row_number().over(order))


def section_items(rows: DataFrame, score: str = "utility_score") -> DataFrame:
    """Items per query and type in utility order (W-13). ``rows`` carries an ``item`` text column."""
    packed = F.array_sort(F.collect_list(F.struct((-F.round(score, 9)).alias("s"), "memory_id", "item")))
    return rows.groupBy("query_id", "memory_type").agg(F.transform(packed, lambda s: s["item"]).alias("items"))


def scored_candidates(memories: DataFrame, understood: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column,
                      weights: Mapping[str, float] = V.UTILITY_WEIGHTS, min_utility: float = V.MIN_UTILITY,
                      pool: DataFrame | None = None, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(useful rows per query without near copies, all scored rows), without texts, which many queries share.

    ``pool`` are the candidates, if they are known, and ``columns`` those of the rows that are wanted. ``cost`` and ``short_cost`` are the tokens of a row's content and of its summary, if it has one.
    """
    pool = UT.candidate_pool(memories) if pool is None else pool
    costs = {"cost": T.budget_tokens(F.coalesce("content", F.lit(""))), "short_cost": T.budget_tokens(F.coalesce("summary", "content"))}
    scored = UT.score_utility(pool.withColumns(costs), understood, traits, concepts, as_of, weights)
    # scoring is the costly step and three later stages read it, so it is written out once
    scored = cut(scored.select(*columns) if columns else scored.drop("content", "summary"))
    useful = scored.filter(F.round("utility_score", 12) >= min_utility)
    near = PR.word_pairs(pool.withColumn("_w", T.word_set(F.col("content"))), ["user_id"], "memory_id", "_w", V.DEDUP_AT)
    return K.drop_near_copies(useful, near, ["query_id"], "memory_id", "utility_score"), scored


def predictive_recall(memories: DataFrame, understood: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column,
                      budget: int = V.RECALL_BUDGET, weights: Mapping[str, float] = V.UTILITY_WEIGHTS,
                      min_utility: float = V.MIN_UTILITY) -> DataFrame:
    """The rows worth sending for each query, ranked (P-03)."""
    useful, _ = scored_candidates(memories, understood, traits, concepts, as_of, weights, min_utility)
    costed = cut(useful.drop("cost").withColumnRenamed("short_cost", "token_cost"))
    return RT.with_text(rank_selected(K.optimize_budget(costed, "query_id", "memory_id", budget)), memories)


# ---- P-15 --------------------------------------------------------------------
def assemble(selected: DataFrame, queries: DataFrame, token_limit: int | None = None) -> DataFrame:
    """Sectioned context text; raw events only when nothing else was chosen (P-15).

    ``queries`` carries (query_id, goal).
    """
    rows = section_items(selected.withColumn("item", F.concat(F.lit("- "), F.coalesce("summary", "content", F.lit("")))))
    none = F.array().cast("array<string>")

    def items(kind: str) -> Column:
        return F.coalesce(F.first(F.when(F.col("memory_type") == kind, F.col("items")), ignorenulls=True), none)

    per = rows.groupBy("query_id").agg(*[items(k).alias(k) for k in V.MEMORY_TYPES])
    df = queries.select("query_id", "goal").join(per, "query_id", "left").withColumns(
        {k: F.coalesce(k, none) for k in V.MEMORY_TYPES})
    concepts = F.concat("concept", "semantic")
    only_events = (F.size("identity") == 0) & (F.size("procedural") == 0) & (F.size(concepts) == 0)

    def section(heading: str, lines: Column, show: Column) -> Column:
        return F.when(show & (F.size(lines) > 0), F.concat(F.lit(heading + "\n"), F.array_join(lines, "\n"), F.lit("\n")))

    always = F.lit(True)
    text = F.rtrim(F.concat_ws("\n", F.concat(F.lit("User Profile\n\nCurrent Goal:\n"), T.humanize(F.col("goal")), F.lit("\n")),
                               section("Relevant Interests & Identity:", F.col("identity"), always),
                               section("Communication Style:", F.col("procedural"), always),
                               section("Relevant Concepts:", concepts, always),
                               section("Supporting Evidence:", F.col("episodic"), only_events)))
    text = F.regexp_replace(text, r"\s+$", "")
    if token_limit:
        text = F.when(T.budget_tokens(text) > token_limit, T.cut_at_newline(text, token_limit * 4)).otherwise(text)
    return df.select("query_id", "goal", text.alias("context_text")).withColumn("estimated_tokens", T.budget_tokens(F.col("context_text")))
