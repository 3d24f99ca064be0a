"""Reports over the store and its logs (A-01 … A-10, A-15, A-25 … A-29, A-33 … A-37, W-12, ST rates)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram import vocab as V
from engram.functions import quality as Q
from engram.functions import text as T
from engram.functions.relevance import whole_days
from engram.sources.store import top_per_group

SCORES = ["importance_score", *[f"{n}_score" for n in V.SCORE_NAMES], "memory_strength"]


def distribution(column: str, values: Sequence[str], prefix: str = "") -> list[Column]:
    """One count per known value; conditional counts need no pivot shuffle."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]


def cognitive_stats(memories: DataFrame) -> DataFrame:
    """Averages and state, type and importance distributions per user (A-01)."""
    level = Q.importance_level(F.col("importance_score"))
    return memories.withColumn("_level", level).groupBy("user_id").agg(
        F.count("*").alias("total_memories"), *[F.avg(c).alias(f"avg_{c}") for c in SCORES],
        *distribution("cognitive_state", V.STATES, "state_"), *distribution("memory_type", V.MEMORY_TYPES, "type_"),
        *distribution("_level", ["high", "medium", "low"], "importance_"))


def creation_timeline(memories: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    rows = memories.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("memories_created"), F.avg(F.coalesce("importance_score", F.lit(0.0))).alias("average_importance"),
        F.avg(F.coalesce("memory_strength", F.lit(0.0))).alias("average_strength"),
        *distribution("cognitive_state", V.STATES, "state_"), *distribution("memory_type", V.MEMORY_TYPES, "type_"))


def lifecycle_stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("user_id").agg(
        F.count("*").alias("total_memories"), *distribution("cognitive_state", V.STATES[:6]),
        F.sum("reinforcement_count").alias("total_reinforcements"), F.sum("retrieval_count").alias("total_retrievals"),
        F.avg("reinforcement_count").alias("avg_reinforcements"), F.avg("retrieval_count").alias("avg_retrievals"))


def importance_histogram(memories: DataFrame) -> DataFrame:
    """Five ranges per user; an unset importance counts as one half (A-04)."""
    known = F.when(F.col("importance_score") != 0, F.col("importance_score")).otherwise(0.5)
    return (memories.withColumn("_b", Q.importance_bucket(known)).groupBy("user_id")
            .agg(F.count("*").alias("total_memories"), *distribution("_b", ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"], "b_")))


def run_performance(runs: DataFrame, newest: int = 100) -> DataFrame:
    """Latency, size and utility over each user's newest runs (A-05, A-06)."""
    rows = top_per_group(runs, ["user_id"], [F.desc("started_at"), F.desc("run_id")], newest)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("run_count"), F.avg("total_latency_ms").alias("average_latency_ms"), F.min("total_latency_ms").alias("min_latency_ms"),
        F.max("total_latency_ms").alias("max_latency_ms"), F.avg("selected_count").alias("average_selected"),
        F.avg("estimated_tokens").alias("average_tokens"), F.avg("candidate_count").alias("average_candidates"),
        F.avg("average_utility").alias("average_utility"), F.avg("ranking_ms").alias("ranking_ms"), F.avg("utility_ms").alias("utility_ms"))


def goal_distribution(runs: DataFrame, newest: int = 100) -> DataFrame:
    rows = top_per_group(runs, ["user_id"], [F.desc("started_at"), F.desc("run_id")], newest)
    return rows.groupBy("user_id", "goal").agg(F.count("*").alias("n"))


def composition_performance(snapshots: DataFrame, metrics: DataFrame, newest: int = 100) -> DataFrame:
    """Averages over the newest snapshots and the metrics recorded for them (A-07, J-14)."""
    rows = top_per_group(snapshots, ["user_id"], [F.desc("started_at"), F.desc("run_id")], newest)
    base = rows.groupBy("user_id").agg(F.count("*").alias("snapshot_count"), F.avg("average_utility").alias("average_quality"),
                                       F.avg("estimated_tokens").alias("average_tokens"), F.avg("total_latency_ms").alias("average_latency_ms"))
    met = rows.select("user_id", "run_id").join(metrics, "run_id").groupBy("user_id").agg(
        F.avg("coverage").alias("average_coverage"), F.avg("redundancy").alias("average_redundancy"))
    return base.join(met, "user_id", "left")


def offline_statistics(runs: DataFrame) -> DataFrame:
    """Counts by status and averages over completed runs (A-08)."""
    done = F.col("status") == "completed"
    return runs.groupBy("user_id").agg(
        F.count("*").alias("total_runs"), *distribution("status", ["completed", "failed", "cancelled", "running"], "n_"),
        F.avg(F.when(done, F.col("total_latency_ms"))).alias("average_latency_ms"),
        F.avg(F.when(done, F.col("average_utility"))).alias("average_health_delta"),
        F.max(F.when(done, F.col("started_at"))).alias("last_completed"))


def consolidation_metrics(candidates: DataFrame, members: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """What a consolidation run achieved per user (A-09)."""
    base = candidates.groupBy("user_id").agg(F.count("*").alias("total_memories"), *distribution("memory_type", V.MEMORY_TYPES[:4], "n_"))
    clu = members.groupBy("user_id").agg(F.count_distinct("cluster_id").alias("cluster_count"))
    con = concepts.groupBy("user_id").agg(F.count("*").alias("concept_count"), F.avg("confidence").alias("avg_concept_confidence"))
    rel = edges.groupBy("user_id").agg(F.count("*").alias("total_relationships"))
    df = (base.join(clu, "user_id", "left").join(con, "user_id", "left").join(rel, "user_id", "left")
          .fillna(0, ["cluster_count", "concept_count", "total_relationships", "avg_concept_confidence"]))
    n, c = F.col("total_memories"), F.col("concept_count")
    return df.withColumns({
        "avg_cluster_size": F.when(F.col("cluster_count") > 0, n / F.col("cluster_count")).otherwise(0.0),
        "compression_ratio": F.when(c > 0, n / c).otherwise(0.0), "memory_reduction_percentage": (1 - c / n) * 100,
        "token_reduction": n * 150 - c * 200, "avg_concept_degree": 2 * F.col("total_relationships") / F.greatest(c, F.lit(1))})


def consolidation_status(memories: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts, ratio and the latest run per user (A-10)."""
    m = memories.groupBy("user_id").agg(F.count("*").alias("memory_count"))
    c = concepts.groupBy("user_id").agg(F.count("*").alias("concept_count"))
    last = runs.groupBy("user_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run"))
    df = m.join(c, "user_id", "left").fillna(0, ["concept_count"]).join(last, "user_id", "left")
    return df.withColumn("compression_ratio", F.when(F.col("concept_count") > 0, F.col("memory_count") / F.col("concept_count")).otherwise(0.0))


def scale_rollup(memories: DataFrame, counts: Mapping[str, DataFrame]) -> DataFrame:
    """Store sizes per user and for everyone, the latter with a null user (A-15)."""
    tokens = T.budget_tokens(F.col("content"))
    known = F.coalesce(F.when(F.col("memory_strength") != 0, F.col("memory_strength")), F.lit(0.5))
    parts = memories.groupBy("user_id").agg(F.count("*").alias("memory_count"), F.sum(tokens).alias("_raw"), F.sum(tokens * known).alias("_weighted"))
    for name, df in counts.items():
        parts = parts.unionByName(df.groupBy("user_id").agg(F.count("*").alias(name)), allowMissingColumns=True)
    names = ["memory_count", *counts]
    rolled = parts.rollup("user_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.sum("_raw").alias("_raw"), F.sum("_weighted").alias("_weighted"))
    return rolled.withColumn("compression_ratio", F.when(F.col("_raw") > 0, 1 - F.col("_weighted") / F.col("_raw")).otherwise(0.0)).drop("_raw", "_weighted")


def storage_compression(memories: DataFrame) -> DataFrame:
    """Share of tokens held by inactive rows (A-25)."""
    tokens, active = T.budget_tokens(F.col("content")), ~F.col("cognitive_state").isin(*V.INACTIVE_STATES)
    df = memories.groupBy("user_id").agg(F.count("*").alias("total_memories"), F.count_if(active).alias("active_memories"),
                                         F.coalesce(F.sum(F.when(active, tokens)), F.lit(0)).alias("active_tokens"), F.sum(tokens).alias("total_tokens"))
    return df.withColumn("storage_compression_ratio", F.greatest(F.lit(0.0), (F.col("total_tokens") - F.col("active_tokens")) / F.col("total_tokens")))


def strategy_comparison(raw: DataFrame, built: Mapping[str, DataFrame], keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Tokens per strategy against the raw history (A-26).

    ``raw`` holds (keys, raw_tokens); each strategy yields (keys, tokens).
    """
    keys, out = list(keys), None
    for name, df in built.items():
        rows = raw.join(df.select(*keys, "tokens"), keys, "left").select(*keys, F.lit(name).alias("strategy"), "raw_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"))
        out = rows if out is None else out.unionByName(rows)
    positive = F.col("raw_tokens") > 0
    return out.withColumns({
        "reduction_percent": F.when(positive, F.greatest(F.lit(0.0), (F.col("raw_tokens") - F.col("tokens")) / F.col("raw_tokens") * 100)).otherwise(0.0),
        "compression_ratio": F.when(positive, 1 - F.col("tokens") / F.col("raw_tokens")).otherwise(0.0)})


def strategy_averages(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("strategy").agg(F.count("*").alias("runs"), F.avg("tokens").alias("avg_tokens"),
                                              F.avg("reduction_percent").alias("avg_reduction_percent"), F.avg("compression_ratio").alias("avg_compression_ratio"))


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("user_id", "entity_type").agg(F.count("*").alias("n"))


def active_users(memories: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Distinct users whose rows were created or read in the window (A-28)."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return memories.filter((F.col("created_at") >= since) | (F.col("last_accessed") >= since)).select("user_id").distinct()


def monthly_usage(usage: DataFrame, tenants: DataFrame, cap: int = V.MONTHLY_CAP) -> DataFrame:
    """Uses per tenant and month; only tenants with a verified address are capped (A-29)."""
    counts = usage.groupBy("tenant_id", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("uses"))
    return counts.join(tenants.select("tenant_id", "verified"), "tenant_id").withColumns({
        "breached": F.col("verified") & (F.col("uses") > cap),
        "refused": F.when(F.col("verified"), F.greatest(F.lit(0).cast("long"), F.col("uses") - cap)).otherwise(0)})


def rolling_attempts(attempts: DataFrame, key: str, limit: int = V.SIGNUPS_PER_DAY, seconds: int = 86400) -> DataFrame:
    """Attempts per key in the preceding day, and whether that reaches the limit (W-12).

    Only the counts travel: attempts of one key in one second combine first.
    """
    per_second = attempts.groupBy(key, F.unix_timestamp("ts").alias("second")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("second").rangeBetween(-seconds, -1)
    return per_second.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("blocked", F.col("earlier") >= limit)


def environment(nodes: DataFrame, names: Mapping[str, tuple[str, Sequence[str]]] = V.ENVIRONMENT_NAMES) -> DataFrame:
    """Tools, services and repositories a user works with (A-33)."""
    low = F.lower("name")

    def listed(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("name"))))

    columns = [listed((F.col("entity_type") == kind) & low.isin(*values)).alias(label) for label, (kind, values) in names.items()]
    clouds = names["cloud_providers"][1]
    integrations = listed((F.col("entity_type") == "service") & ~low.isin(*clouds)).alias("integrations")
    return nodes.groupBy("user_id").agg(*columns, integrations, listed(F.col("entity_type") == "repository").alias("repositories"))


def context_alignment(contexts: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean identity and goal alignment over the rows behind a context (A-35). ``contexts``: (query_id, source_ids)."""
    rows = contexts.select("query_id", F.explode("source_ids").alias("memory_id")).join(
        scored.select("query_id", "memory_id", "identity_alignment", "goal_alignment"), ["query_id", "memory_id"])
    return rows.groupBy("query_id").agg(F.avg("identity_alignment").alias("identity_alignment"), F.avg("goal_alignment").alias("goal_alignment"))


def lifecycle_status(memories: DataFrame, as_of: Column) -> DataFrame:
    return memories.select("memory_id", "cognitive_state", "memory_strength", "decay_rate", "reinforcement_count", "retrieval_count",
                           whole_days(as_of, F.coalesce("last_accessed", "created_at")).alias("days_since_access"))


# ---- scheduling of offline runs --------------------------------------------------------
def growth_since_last_run(memories: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows created since each user's last completed run (J-15)."""
    last = runs.filter(F.col("status") == "completed").groupBy("user_id").agg(F.max("started_at").alias("_last"))
    since = F.coalesce("_last", F.to_timestamp(F.lit("2000-01-01")))
    return memories.join(last, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("created_at") >= since).alias("growth"))


def cooled_down(runs: DataFrame, as_of: Column, hours: float = 1.0) -> DataFrame:
    """Users whose latest run is over and old enough (ST-05)."""
    last = runs.groupBy("user_id").agg(F.max_by(F.struct("status", "started_at"), F.struct("started_at", "run_id")).alias("r"))
    waited = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("r.started_at").cast("timestamp"))
    return last.select("user_id", ((F.col("r.status") != "running") & (waited >= int(hours * 3600 * 1000000))).alias("ready"))


def eligible_users(memories: DataFrame, runs: DataFrame, as_of: Column, limit: int = 20, idle: DataFrame | None = None) -> DataFrame:
    """Users due for an offline run, most grown first (W-11)."""
    growth = growth_since_last_run(memories, runs).join(cooled_down(runs, as_of), "user_id", "left")
    ready = growth.filter(F.coalesce("ready", F.lit(True)))
    if idle is not None:
        ready = ready.join(idle.select("user_id"), "user_id", "left_semi")
    return ready.select("user_id", "growth").orderBy(F.desc("growth"), "user_id").limit(limit)


# ---- service rates -------------------------------------------------------------------------
def rates(events: DataFrame, label: str, window: str = "5 minutes", slide: str | None = "1 minute") -> DataFrame:
    """Events per second by label and window with error share and latency quantiles (ST-06).

    Works on a batch and on a stream with a watermark alike.
    """
    seconds = int(window.split()[0]) * {"minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "second": 1, "seconds": 1}[window.split()[1]]
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.groupBy(win, label).agg(
        F.count("*").alias("n"), (F.count("*") / seconds).alias("rate"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_ratio"),
        F.percentile_approx("value", [0.5, 0.95, 0.99], 10000).alias("quantiles")).select("window.start", "window.end", label, "n", "rate", "error_ratio", "quantiles")
