"""Scheduled and incremental work as batch or stream (ST-01 … ST-09, P-16).

Functions take a DataFrame that may be static or streaming; those that start a query say so.
Late data: rows behind the watermark are dropped, ten minutes by default.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram import vocab as V
from engram.functions import lifecycle as L
from engram.functions import scoring as S
from engram.functions import text as T
from engram.operators import utility as UT
from engram.operators.analytics import rates
from engram.operators.eligibility import revivable
from engram.operators.understanding import understand
from engram.plans.compose import compose
from engram.session import cut

WATERMARK = "10 minutes"


# ---- ST-01, SRC-03 ------------------------------------------------------------------
def score_turns(turns: DataFrame, lexicon: S.Lexicon = S.DEFAULT, text: str = "text") -> DataFrame:
    """Heuristic scores on arriving turns; the state stays at its default (SRC-03)."""
    kind = F.col("memory_type") if "memory_type" in turns.columns else F.lit("episodic")
    made = S.heuristic_scores(F.col(text), F.col("memory_type"), lexicon)
    df = turns.withColumn("memory_type", kind).withColumns({f"{n}_score": made[n] for n in V.SCORE_NAMES})
    df = df.withColumn("importance_score", S.weighted_importance({n: F.col(f"{n}_score") for n in V.SCORE_NAMES}))
    return df.withColumns({"cognitive_state": F.lit("active"), "memory_strength": F.col("importance_score"),
                           "decay_rate": S.initial_decay_rate(F.col("importance_score"), F.col("memory_type"))})


def ingest_stream(turns: DataFrame, path: str, checkpoint: str, lexicon: S.Lexicon = S.DEFAULT) -> StreamingQuery:
    """Start a query that scores turns as they arrive and appends them to a table (ST-01)."""
    return (score_turns(turns, lexicon).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


# ---- ST-02, ST-03 -----------------------------------------------------------------------
def hourly_users(activity: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Users seen in each hour, with how often (ST-02)."""
    rows = activity.withWatermark("ts", watermark) if activity.isStreaming else activity
    return rows.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "user_id", "n")


def evolve_hourly(activity: DataFrame, checkpoint: str, evolve: Callable[[DataFrame, int], None], watermark: str = WATERMARK) -> StreamingQuery:
    """Start a query that hands each closed hour's users to ``evolve`` (ST-02)."""
    return (hourly_users(activity, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, epoch: evolve(batch.select("user_id").distinct(), epoch)).trigger(availableNow=True).start())


def users_to_sweep(memories: DataFrame) -> DataFrame:
    """Everyone with a row that is not forgotten (ST-03)."""
    return memories.filter(F.col("cognitive_state") != "forgotten").select("user_id").distinct()


# ---- ST-04 --------------------------------------------------------------------------------
def sessions(activity: DataFrame, gap: str = "15 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Activity sessions per user; a closed session marks the user idle from its end (ST-04). An event that comes at that end starts the next one."""
    rows = activity.withWatermark("ts", watermark) if activity.isStreaming else activity
    # session windows that touch are merged, so each ends a microsecond early
    return (rows.groupBy(F.session_window("ts", f"{gap} -1 microseconds"), "user_id").agg(F.count("*").alias("n"))
            .select("user_id", F.col("session_window.start").alias("started"), (F.col("session_window.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("idle_from"), "n"))


# ---- ST-06 --------------------------------------------------------------------------------
def service_rates(events: DataFrame, label: str = "event_type", window: str = "5 minutes", slide: str | None = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    return rates(events.withWatermark("ts", watermark) if events.isStreaming else events, label, window, slide)


# ---- ST-07 --------------------------------------------------------------------------------
def running_reinforcement(events: DataFrame, memories: DataFrame, watermark: str = WATERMARK, boost: float = 0.1) -> DataFrame:
    """Count, strength, decay rate and state of each reinforced memory (ST-07).

    Increments are constant and capped, so the state after n events follows from n: the
    stream keeps one counter per memory and needs no Python. A repeated event id counts once.
    """
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    counts = once.groupBy("memory_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_reinforced_at"))
    base = memories.select("memory_id", "memory_strength", "reinforcement_count", "decay_rate")
    df = counts.join(base, "memory_id")
    strength = F.least(F.lit(1.0), F.coalesce("memory_strength", F.lit(0.5)) + boost * F.col("n"))
    count = F.col("reinforcement_count") + F.col("n")
    return df.select("memory_id", "n", strength.alias("memory_strength"), count.alias("reinforcement_count"),
                     (F.col("decay_rate") * F.pow(F.lit(0.8), F.col("n"))).alias("decay_rate"), L.reinforced_state(strength, count).alias("cognitive_state"), "last_reinforced_at")


# ---- ST-08 --------------------------------------------------------------------------------
def revivals(understood: DataFrame, memories: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column, threshold: float = V.REVIVE_UTILITY) -> DataFrame:
    """Sleeping rows that an arriving query makes useful again, with their new state (ST-08).

    Rows with the same text and type score alike for a user, but each revives on its own; a row
    that several queries want revives once, for the best of them.
    """
    scored = UT.score_utility(memories.filter(revivable()), understood, traits, concepts, as_of)
    hit = scored.filter(F.round("utility_score", 12) >= threshold)
    best = hit.groupBy("memory_id").agg(F.max_by(F.struct("query_id", "utility_score", "selection_reason", "user_id", "cognitive_state", "memory_strength", "revival_count"),
                                                 F.struct("utility_score", "query_id")).alias("b"))
    state, strength = L.revive(F.col("b.memory_strength"))
    return best.select("memory_id", "b.user_id", "b.query_id", F.col("b.cognitive_state").alias("old_state"), state.alias("new_state"),
                       F.col("b.memory_strength").alias("old_strength"), strength.alias("new_strength"), (F.coalesce("b.revival_count", F.lit(0)) + 1).alias("revival_count"),
                       F.concat(F.lit("Revived: utility "), F.format_number("b.utility_score", 2), F.lit(" ("), "b.selection_reason", F.lit(")")).alias("reason"),
                       F.col("b.utility_score").alias("confidence"))


def revive_on_queries(queries: DataFrame, checkpoint: str, memories: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column,
                      sink: Callable[[DataFrame, int], None], threshold: float = V.REVIVE_UTILITY, **signals) -> StreamingQuery:
    """Start a query that joins each batch of arriving queries to the stored rows (ST-08)."""
    return (queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: sink(revivals(understand(batch, **signals), memories, traits, concepts, as_of, threshold), epoch)).start())


# ---- ST-09 --------------------------------------------------------------------------------
def monthly_counts(usage: DataFrame, cap: int = V.MONTHLY_CAP) -> DataFrame:
    """Uses per tenant and month of a table, and whether the cap is passed (ST-09). ``state.monthly_cap`` serves streams as well."""
    if usage.isStreaming:
        raise ValueError("use engram.streaming.state.monthly_cap on a stream")
    counts = usage.groupBy("tenant_id", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("uses"))
    return counts.withColumn("breached", F.col("uses") > cap)


def daily_attempts(attempts: DataFrame, key: str, limit: int = V.SIGNUPS_PER_DAY, watermark: str = WATERMARK) -> DataFrame:
    """Attempts per key in sliding days, hour by hour, at or over the limit (ST-09)."""
    rows = attempts.withWatermark("ts", watermark) if attempts.isStreaming else attempts
    counts = rows.groupBy(F.window("ts", "1 day", "1 hour"), key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= limit).select(F.col("window.start").alias("start"), key, "n")


# ---- P-16 ---------------------------------------------------------------------------------
def turn_id() -> Column:
    """A number of its own for each turn of each conversation, for conversations below 2^31 and turns below 2^32."""
    return F.shiftleft(F.col("conv_id").cast("long"), 32).bitwiseOR(F.col("turn").cast("long"))


def turn_memories(turns: DataFrame, lexicon: S.Lexicon = S.DEFAULT, memory_type: str = "episodic") -> DataFrame:
    """Arriving turns as memory rows. Ids are negative, below those of stored rows."""
    scored_rows = score_turns(turns.withColumn("memory_type", F.lit(memory_type)), lexicon)
    return scored_rows.withColumns({"memory_id": -turn_id() - 1, "content": F.col("text"), "created_at": F.col("ts"),
                                    "last_accessed": F.lit(None).cast("timestamp"), "summary": F.lit(None).cast("string"), "entropy_score": F.lit(None).cast("double"),
                                    "reinforcement_count": F.lit(0), "retrieval_count": F.lit(0), "access_count": F.lit(0), "revival_count": F.lit(0)})


def conversational_turns(turns: DataFrame, memories: DataFrame, traits: DataFrame, concepts: DataFrame, as_of: Column, lexicon: S.Lexicon = S.DEFAULT,
                         goals=V.GOAL_SIGNALS, intents=V.INTENT_SIGNALS, knowledge: Mapping[str, Sequence[str]] = V.GOAL_KNOWLEDGE,
                         flags: str = T.ANY_CASE, budget: int = 800) -> DataFrame:
    """Keep each turn, then compose the context that answers it, all turns of a micro-batch at once (P-16)."""
    kept = turn_memories(turns, lexicon)
    shared = [c for c in memories.columns if c in kept.columns]
    store = memories.select(*shared).unionByName(kept.select(*shared))
    asked = turns.select(turn_id().alias("query_id"), "user_id", F.col("text").alias("query"))
    found = understand(asked, goals, intents, knowledge, flags).select("query_id", "user_id", "query", "goal", "keywords", "required_knowledge")
    found = cut(found)  # read for scores, gaps, state and quality
    done = compose(store, found, traits, concepts, as_of, budget, flags=flags)
    return (found.select("query_id", "user_id", "goal").join(done.totals.select("query_id", "original_tokens", "compressed_tokens"), "query_id", "left")
            .join(done.evaluation.select("query_id", F.round("quality_score", 6).alias("quality_score")), "query_id", "left"))
