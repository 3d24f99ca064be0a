"""Reading, writing, upserting, logging and erasing rows of the memory store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.text import tokens


# ---- files -----------------------------------------------------------------
def read_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, partition: Sequence[str] = ()) -> None:
    """Write a new version of a table. The target must not be among the inputs of ``df``."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root}/{name}")


def user_bucket(n: int, user: str = "user_id") -> Column:
    """Directory key for tables written by user: a fixed number of folders however many users."""
    return F.pmod(F.hash(user), F.lit(n))


def write_pairs(memories: DataFrame, vectors: DataFrame, root: str) -> None:
    """Append memories and their vectors as two tables (SRC-04)."""
    append_table(memories, root, "memories")
    append_table(vectors.join(memories.select("memory_id"), "memory_id", "left_semi"), root, "memory_embeddings")


def attach_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Left join each memory to its first vector (SRC-10, J-01)."""
    first = vectors.groupBy("memory_id").agg(F.min_by("embedding", "vector_order").alias("embedding")) \
        if "vector_order" in vectors.columns else vectors.select("memory_id", "embedding")
    return memories.join(first, "memory_id", "left")


# ---- reads -----------------------------------------------------------------
def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group in order. Spark trims each group before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, n).filter(F.col(rank) <= k)


def memories_by_user(memories: DataFrame, memory_type: str | None = None, limit: int = 100) -> DataFrame:
    """The most important memories per user (SRC-01)."""
    rows = memories if memory_type is None else memories.filter(F.col("memory_type") == memory_type)
    return top_per_group(rows, ["user_id"], [F.desc("importance_score"), F.col("memory_id")], limit)


# ---- ingest ----------------------------------------------------------------
def ingest_summary(extracted: DataFrame, turns: DataFrame, floor: float = 0.3) -> DataFrame:
    """Per conversation: extracted and kept rows and the tokens saved by keeping only those (SRC-02)."""
    kept = F.col("importance_score") >= floor
    rows = extracted.groupBy("conv_id").agg(
        F.count("*").alias("n_extracted"), F.count_if(kept).alias("n_kept"),
        F.sum(F.when(kept, tokens(F.col("content"))).otherwise(0)).alias("_kept_tokens"))
    # turns are joined by a newline, so one character more per turn but the last
    whole = turns.groupBy("conv_id").agg((F.sum(F.length("text") + 1) - 1).alias("_chars"))
    saved = F.greatest(F.lit(0).cast("long"), F.floor(F.col("_chars") / 4).cast("long") - F.col("_kept_tokens"))
    return rows.join(whole, "conv_id").select("conv_id", "n_extracted", "n_kept", saved.alias("tokens_saved"))


# ---- upsert ----------------------------------------------------------------
def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Insert new keys, combine known ones (SRC-15).

    ``rules`` gives each value column as an expression over ``base.<col>`` and ``delta.<col>``;
    the other side is null for a new or an untouched key.
    """
    b, d = base.alias("base"), delta.alias("delta")
    on = [F.col(f"base.{k}").eqNullSafe(F.col(f"delta.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = b.join(d, condition, "full_outer")
    return joined.select(*[F.coalesce(f"base.{k}", f"delta.{k}").alias(k) for k in keys],
                         *[c.alias(n) for n, c in rules.items()])


def write_back(memories: DataFrame, selected: DataFrame, as_of: Column) -> DataFrame:
    """Carry the scores of selected rows onto the memories and count the access (SRC-16).

    A row selected by several queries counts each of them and keeps its best rank.
    """
    best = selected.groupBy("memory_id").agg(
        F.max_by("utility_score", -F.col("retrieval_rank")).alias("_utility"),
        F.max_by("selection_reason", -F.col("retrieval_rank")).alias("_reason"),
        F.min("retrieval_rank").alias("_rank"), F.count("*").alias("_n"))
    out = memories.join(best, "memory_id", "left")
    hit = F.col("_n").isNotNull()

    def keep(name: str) -> Column:
        return F.col(name) if name in memories.columns else F.lit(None)

    return out.withColumns({
        "utility_score": F.when(hit, F.col("_utility")).otherwise(keep("utility_score")),
        "selection_reason": F.when(hit, F.col("_reason")).otherwise(keep("selection_reason")),
        "retrieval_rank": F.when(hit, F.col("_rank")).otherwise(keep("retrieval_rank")),
        "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_accessed": F.when(hit, as_of).otherwise(F.col("last_accessed")),
    }).drop("_utility", "_reason", "_rank", "_n")


# ---- logs ------------------------------------------------------------------
def event_log(before_after: DataFrame, event_type: str, reason: Column, confidence: Column, as_of: Column) -> DataFrame:
    """Lifecycle event rows from rows that carry old and new state and strength (SRC-14)."""
    return before_after.select("memory_id", "user_id", F.lit(event_type).alias("event_type"), "old_state", "new_state",
                               "old_strength", "new_strength", reason.alias("reason"), confidence.alias("confidence"),
                               as_of.alias("timestamp"))


def retrieval_log(ranked: DataFrame, queries: DataFrame, as_of: Column) -> DataFrame:
    """One log row per query with the ids in rank order (SRC-11). Rows per query are the top k."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda s: s["memory_id"])
    per_query = ranked.groupBy("query_id").agg(ids.alias("retrieved_memory_ids"),
                                               F.sum("tokens").alias("context_token_count"))
    return (queries.select("query_id", "user_id", "query").join(per_query, "query_id", "left")
            .withColumn("retrieved_memory_ids", F.coalesce("retrieved_memory_ids", F.array().cast("array<long>")))
            .withColumn("context_token_count", F.coalesce("context_token_count", F.lit(0).cast("long")))
            .withColumn("created_at", as_of))


def recall_log(selected: DataFrame, queries: DataFrame, as_of: Column) -> DataFrame:
    """One run row per query: chosen ids, their explanations and totals (SRC-12)."""
    item = F.struct(F.col("retrieval_rank").alias("rank"), "memory_id", "utility_score", "selection_reason")
    runs = selected.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("explanations"), F.avg("utility_score").alias("average_utility_score"),
        F.sum("token_cost").alias("estimated_tokens"), F.count("*").alias("selected_count"))
    return (queries.join(runs, "query_id", "left")
            .withColumn("selected_memory_ids", F.transform("explanations", lambda e: e["memory_id"]))
            .withColumn("created_at", as_of))


# ---- erasure ---------------------------------------------------------------
def erase(tables: Mapping[str, DataFrame], ids: DataFrame, key: str = "user_id",
          children: Mapping[str, tuple[str, str]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the listed ids, and how many rows each loses (SRC-17).

    ``children`` maps a table without the key to (parent table, join column).
    """
    children = children or {}
    ids = ids.select(key).distinct()
    kept, counts = {}, []
    for name, df in tables.items():
        doomed = df.join(ids, key, "left_semi") if name not in children else df.join(
            tables[children[name][0]].join(ids, key, "left_semi").select(children[name][1]).distinct(),
            children[name][1], "left_semi")
        if name in children:
            parent, column = children[name]
            gone = tables[parent].join(ids, key, "left_semi").select(column).distinct()
            kept[name] = df.join(gone, column, "left_anti")
        else:
            kept[name] = df.join(ids, key, "left_anti")
        counts.append(doomed.agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("table_name"), "n_deleted"))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return kept, total


def reclaim_vectors(vectors: DataFrame, memories: DataFrame, states: Sequence[str] = ("archived", "forgotten")) -> DataFrame:
    """Vectors without those of inactive memories (SRC-18)."""
    inactive = memories.filter(F.col("cognitive_state").isin(*states)).select("memory_id")
    return vectors.join(inactive, "memory_id", "left_anti")
