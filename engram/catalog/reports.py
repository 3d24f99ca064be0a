"""Report queries (A-*, W-*, SET-*, SC-57 … SC-70 and identity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import vocab as V
from engram.catalog.registry import query, r6
from engram.catalog.texts import case_sql, clamp_sql, hit_sql
from engram.catalog.views import as_of
from engram.functions import lifecycle as L
from engram.functions import quality as Q
from engram.functions import text as T
from engram.operators import analytics as A
from engram.operators import eligibility as E
from engram.operators import entropy as N
from engram.operators import identity as I
from engram.operators.memberships import recent_identity_flags

ACTIVE = "cognitive_state NOT IN ('archived', 'forgotten')"
TOK = "GREATEST(1, LENGTH(content) // 4)"


def counts_sql(column: str, values, prefix: str = "") -> str:
    return ", ".join(f"COUNT(*) FILTER (WHERE {column} = '{v}') AS \"{prefix}{v}\"" for v in values)


_AVGS = ", ".join(f"ROUND(AVG({c}), 6) AS avg_{c}" for c in A.SCORES)
_LEVEL = "CASE WHEN importance_score >= 0.70 THEN 'high' WHEN importance_score >= 0.40 THEN 'medium' ELSE 'low' END"


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query("a_01", f"""SELECT user_id, COUNT(*) AS total_memories, {_AVGS}, {counts_sql('cognitive_state', V.STATES, 'state_')}, {counts_sql('memory_type', V.MEMORY_TYPES, 'type_')},
    {counts_sql(_LEVEL, ['high', 'medium', 'low'], 'importance_')} FROM memories_v GROUP BY user_id""")
def a_01(t):
    return rounded(A.cognitive_stats(t.memories_v), *[f"avg_{c}" for c in A.SCORES])


@query("a_02", f"""SELECT user_id, COUNT(*) AS memories_created, ROUND(AVG(importance_score), 6) AS average_importance, ROUND(AVG(COALESCE(memory_strength, 0.0)), 6) AS average_strength,
    {counts_sql('cognitive_state', V.STATES, 'state_')}, {counts_sql('memory_type', V.MEMORY_TYPES, 'type_')} FROM memories_v WHERE created_s >= 1706745600 - 300 * 86400 GROUP BY user_id""")
def a_02(t):
    return rounded(A.creation_timeline(t.memories_v, as_of(), 300), "average_importance", "average_strength")


@query("a_03", f"""SELECT user_id, COUNT(*) AS total_memories, {counts_sql('cognitive_state', V.STATES[:6])}, CAST(SUM(reinforcement_count) AS BIGINT) AS total_reinforcements,
    CAST(SUM(retrieval_count) AS BIGINT) AS total_retrievals, ROUND(AVG(reinforcement_count), 6) AS avg_reinforcements, ROUND(AVG(retrieval_count), 6) AS avg_retrievals FROM memories_v GROUP BY user_id""")
def a_03(t):
    return rounded(A.lifecycle_stats(t.memories_v), "avg_reinforcements", "avg_retrievals")


_BUCKETS = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
_BUCKET = "CASE WHEN i < 0.2 THEN '0.0-0.2' WHEN i < 0.4 THEN '0.2-0.4' WHEN i < 0.6 THEN '0.4-0.6' WHEN i < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"


@query("a_04", f"""SELECT user_id, COUNT(*) AS total_memories, {counts_sql(_BUCKET, _BUCKETS, 'b_')}
    FROM (SELECT *, CASE WHEN importance_score <> 0 THEN importance_score ELSE 0.5 END AS i FROM memories_v) GROUP BY user_id""")
def a_04(t):
    return A.importance_histogram(t.memories_v)


@query("sc_69", f"SELECT memory_id, {_BUCKET.replace('i <', 'importance_score <')} AS bucket, {_LEVEL} AS level FROM memories_v")
def sc_69(t):
    return t.memories_v.select("memory_id", Q.importance_bucket(F.col("importance_score")).alias("bucket"), Q.importance_level(F.col("importance_score")).alias("level"))


NEWEST_RUNS = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY started_s DESC, run_id DESC) AS r FROM runs_v) WHERE r <= {n}"


@query("a_05", f"""SELECT user_id, COUNT(*) AS run_count, ROUND(AVG(total_latency_ms), 6) AS average_latency_ms, ROUND(MIN(total_latency_ms), 6) AS min_latency_ms, ROUND(MAX(total_latency_ms), 6) AS max_latency_ms,
    ROUND(AVG(selected_count), 6) AS average_selected, ROUND(AVG(estimated_tokens), 6) AS average_tokens FROM ({NEWEST_RUNS.format(n=10)}) GROUP BY user_id""")
def a_05(t):
    names = ["average_latency_ms", "min_latency_ms", "max_latency_ms", "average_selected", "average_tokens"]
    return rounded(A.run_performance(t.runs_v, 10), *names).select("user_id", "run_count", *names)


@query("a_06", f"""SELECT user_id, goal, COUNT(*) AS n FROM ({NEWEST_RUNS.format(n=100)}) GROUP BY user_id, goal""")
def a_06(t):
    return A.goal_distribution(t.runs_v)


@query("a_07", f"""SELECT r.user_id, COUNT(*) AS snapshot_count, ROUND(AVG(average_utility), 6) AS average_quality, ROUND(AVG(h.confidence_delta), 6) AS average_coverage
    FROM ({NEWEST_RUNS.format(n=20)}) r LEFT JOIN (SELECT event_id - 1 AS run_id, confidence_delta FROM history_v) h ON h.run_id = r.run_id GROUP BY r.user_id""")
def a_07(t):
    metrics = t.history_v.select((F.col("event_id") - 1).alias("run_id"), F.col("confidence_delta").alias("coverage"), F.lit(0.0).alias("redundancy"))
    df = A.composition_performance(t.runs_v, metrics, 20)
    return rounded(df, "average_quality", "average_coverage").select("user_id", "snapshot_count", "average_quality", "average_coverage")


@query("j_14", """SELECT COUNT(*) AS n, ROUND(AVG(h.confidence_delta), 6) AS coverage, ROUND(AVG(r.average_utility), 6) AS quality FROM runs_v r JOIN history_v h ON h.event_id = r.run_id + 1""")
def j_14(t):
    metrics = t.history_v.select((F.col("event_id") - 1).alias("run_id"), "confidence_delta")
    return t.runs_v.join(metrics, "run_id").agg(F.count("*").alias("n"), r6(F.avg("confidence_delta")).alias("coverage"), r6(F.avg("average_utility")).alias("quality"))


@query("a_08", f"""SELECT user_id, COUNT(*) AS total_runs, {counts_sql('status', ['completed', 'failed', 'cancelled', 'running'], 'n_')},
    ROUND(AVG(total_latency_ms) FILTER (WHERE status = 'completed'), 6) AS average_latency_ms, ROUND(AVG(average_utility) FILTER (WHERE status = 'completed'), 6) AS average_health_delta
    FROM runs_v GROUP BY user_id""")
def a_08(t):
    return rounded(A.offline_statistics(t.runs_v), "average_latency_ms", "average_health_delta").drop("last_completed")


@query("a_10", """
    SELECT m.user_id, memory_count, COALESCE(concept_count, 0) AS concept_count, ROUND(CASE WHEN concept_count > 0 THEN memory_count / concept_count ELSE 0.0 END, 6) AS compression_ratio, latest_run
    FROM (SELECT user_id, COUNT(*) AS memory_count FROM memories_v GROUP BY user_id) m LEFT JOIN (SELECT user_id, COUNT(*) AS concept_count FROM concepts_v GROUP BY user_id) c ON c.user_id = m.user_id
      LEFT JOIN (SELECT user_id, ARG_MAX(run_id, started_s * 10000000 + run_id % 10000000) AS latest_run FROM runs_v GROUP BY user_id) r ON r.user_id = m.user_id""")
def a_10(t):
    return rounded(A.consolidation_status(t.memories_v, t.concepts_v, t.runs_v), "compression_ratio")


_KNOWN = "CASE WHEN memory_strength <> 0 THEN memory_strength ELSE 0.5 END"


@query("a_14", f"""SELECT user_id, ROUND(COUNT(*) FILTER (WHERE created_s >= 1706745600 - 90 * 86400) / COUNT(*), 6) AS storage_growth_ratio,
    ROUND(COALESCE(SUM(CASE WHEN {ACTIVE} THEN {TOK} * {_KNOWN} END) / SUM(CASE WHEN {ACTIVE} THEN {TOK} END), 1.0), 6) AS token_efficiency FROM memories_v GROUP BY user_id""")
def a_14(t):
    return rounded(N.storage_growth(t.memories_v, as_of(), 90), "storage_growth_ratio", "token_efficiency")


@query("a_15", f"""
    WITH parts AS (SELECT user_id, 1 AS m, 0 AS c, 0 AS i, {TOK} AS raw, {TOK} * {_KNOWN} AS w FROM memories_v
      UNION ALL SELECT user_id, 0, 1, 0, NULL, NULL FROM concepts_v UNION ALL SELECT user_id, 0, 0, 1, NULL, NULL FROM traits_v)
    SELECT user_id, CAST(SUM(m) AS BIGINT) AS memory_count, CAST(SUM(c) AS BIGINT) AS concept_count, CAST(SUM(i) AS BIGINT) AS identity_nodes,
      ROUND(CASE WHEN SUM(raw) > 0 THEN 1 - SUM(w) / SUM(raw) ELSE 0.0 END, 6) AS compression_ratio FROM parts GROUP BY ROLLUP (user_id)""")
def a_15(t):
    return rounded(A.scale_rollup(t.memories_v, {"concept_count": t.concepts_v, "identity_nodes": t.traits_v}), "compression_ratio")


@query("a_16", """SELECT t.user_id, total_traits, total_reinforcements, avg_confidence, avg_evidence_per_trait, COALESCE(reinforced_events, 0) AS reinforced_events, COALESCE(decayed_events, 0) AS decayed_events
    FROM (SELECT user_id, COUNT(*) AS total_traits, CAST(SUM(reinforcement_count) AS BIGINT) AS total_reinforcements, ROUND(AVG(confidence), 6) AS avg_confidence, ROUND(AVG(evidence_count), 6) AS avg_evidence_per_trait FROM traits_v GROUP BY user_id) t
    LEFT JOIN (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'reinforced') AS reinforced_events, COUNT(*) FILTER (WHERE event_type = 'decayed') AS decayed_events FROM history_v GROUP BY user_id) h ON h.user_id = t.user_id""")
def a_16(t):
    return rounded(I.reinforcement_stats(t.traits_v, t.history_v), "avg_confidence", "avg_evidence_per_trait")


@query("a_17", """SELECT user_id, ROUND(AVG(confidence), 6) AS average_confidence, ROUND(LIST_SORT(LIST(confidence))[COUNT(*) // 2 + 1], 6) AS median_confidence, ROUND(MIN(confidence), 6) AS min_confidence,
    ROUND(MAX(confidence), 6) AS max_confidence, COUNT(*) AS total_traits, CAST(SUM(reinforcement_count) AS BIGINT) AS total_reinforcements FROM traits_v GROUP BY user_id""")
def a_17(t):
    df = rounded(I.confidence_summary(t.traits_v), "average_confidence", "median_confidence", "min_confidence", "max_confidence")
    return df.drop("avg_reinforcements_per_trait")


@query("a_18", """SELECT user_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE confidence_delta > 0.1) AS increased, COUNT(*) FILTER (WHERE confidence_delta < -0.1) AS decreased,
    COUNT(DISTINCT node_value) AS traits_changed, ROUND(AVG(CASE WHEN confidence_delta <> 0 THEN confidence_delta END), 6) AS avg_delta FROM history_v WHERE ts_s >= 1706745600 - 25 * 86400 GROUP BY user_id""")
def a_18(t):
    return rounded(I.evolution_metrics(t.history_v, as_of(), 25), "avg_delta")


@query("a_25", f"""SELECT user_id, COUNT(*) AS total_memories, COUNT(*) FILTER (WHERE {ACTIVE}) AS active_memories, CAST(COALESCE(SUM(CASE WHEN {ACTIVE} THEN {TOK} END), 0) AS BIGINT) AS active_tokens,
    CAST(SUM({TOK}) AS BIGINT) AS total_tokens, ROUND(GREATEST(0.0, (SUM({TOK}) - COALESCE(SUM(CASE WHEN {ACTIVE} THEN {TOK} END), 0)) / SUM({TOK})), 6) AS storage_compression_ratio FROM memories_v GROUP BY user_id""")
def a_25(t):
    return rounded(A.storage_compression(t.memories_v), "storage_compression_ratio")


_A26 = """
    WITH RECURSIVE turns AS (SELECT conv_id, LENGTH(text) // 4 AS cost, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns_v),
      fill AS (SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT conv_id FROM turns)
        UNION ALL SELECT t.conv_id, t.r, CASE WHEN f.used + t.cost <= 600 THEN f.used + t.cost ELSE f.used END FROM fill f JOIN turns t ON t.conv_id = f.conv_id AND t.r = f.r + 1),
      raw AS (SELECT conv_id, GREATEST(1, CAST(SUM(LENGTH(text) + 1) - 1 AS BIGINT) // 4) AS raw FROM turns_v GROUP BY conv_id),
      rows AS (SELECT conv_id, 'no_memory' AS strategy, raw, 0 AS tokens FROM raw UNION ALL SELECT conv_id, 'raw_history', raw, raw FROM raw
        UNION ALL SELECT r.conv_id, 'composed', raw, used FROM raw r JOIN (SELECT conv_id, MAX(used) AS used FROM fill GROUP BY conv_id) f ON f.conv_id = r.conv_id)
    SELECT strategy, COUNT(*) AS runs, ROUND(AVG(tokens), 6) AS avg_tokens, ROUND(AVG(GREATEST(0.0, (raw - tokens) / raw * 100)), 6) AS avg_reduction_percent, ROUND(AVG(1 - tokens / raw), 6) AS avg_compression_ratio
    FROM rows GROUP BY strategy"""


@query("a_26", _A26)
def a_26(t):
    from engram.hooks import STRATEGIES, compare_strategies
    df = A.strategy_averages(compare_strategies(t.turns_v, STRATEGIES))
    return rounded(df, "avg_tokens", "avg_reduction_percent", "avg_compression_ratio")


@query("a_27", "SELECT user_id, entity_type, COUNT(*) AS n FROM nodes_v GROUP BY user_id, entity_type")
def a_27(t):
    return A.node_type_counts(t.nodes_v)


@query("a_28", "SELECT DISTINCT user_id FROM memories_v WHERE created_s >= 1706745600 - 72 * 3600 OR accessed_s >= 1706745600 - 72 * 3600")
def a_28(t):
    return A.active_users(t.memories_v, as_of(), 72)


@query("a_29", """
    SELECT tenant_id, CAST(DATE_TRUNC('month', make_timestamp(CAST(ts_s AS BIGINT) * 1000000)) AS DATE) AS month, COUNT(*) AS uses, tenant_id % 3 <> 0 AND COUNT(*) > 12 AS breached,
      CASE WHEN tenant_id % 3 <> 0 THEN GREATEST(0, COUNT(*) - 12) ELSE 0 END AS refused
    FROM (SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS tenant_id, ts_s FROM activity_v WHERE event_type = 'purchase') GROUP BY 1, 2""")
def a_29(t):
    usage = t.activity_v.filter("event_type = 'purchase'").withColumn("tenant_id", F.floor(F.col("user_id") / 15))
    tenants = usage.select("tenant_id").distinct().withColumn("verified", F.col("tenant_id") % 3 != 0)
    return A.monthly_usage(usage, tenants, 12).select("tenant_id", "month", "uses", "breached", "refused")


@query("w_12", """
    SELECT tenant_id, ts_s AS second, n, CAST(COALESCE(SUM(n) OVER (PARTITION BY tenant_id ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier,
      COALESCE(SUM(n) OVER (PARTITION BY tenant_id ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) >= 5 AS blocked
    FROM (SELECT CAST(FLOOR(user_id / 15.0) AS BIGINT) AS tenant_id, ts_s, COUNT(*) AS n FROM activity_v WHERE event_type = 'signup' GROUP BY 1, 2)""")
def w_12(t):
    tries = t.activity_v.filter("event_type = 'signup'").withColumn("tenant_id", F.floor(F.col("user_id") / 15))
    return A.rolling_attempts(tries, "tenant_id").select("tenant_id", "second", "n", "earlier", "blocked")


@query("w_02", f"SELECT user_id, run_id FROM ({NEWEST_RUNS.format(n=20)})")
def w_02(t):
    return E.newest(t.runs_v, ["user_id"], "started_at", "run_id", 20).select("user_id", "run_id")


@query("w_05", "SELECT user_id, ARG_MAX(project_id, updated_s * 100000 + project_id % 100000) AS project_id FROM projects_v GROUP BY user_id")
def w_05(t):
    # of a user's projects updated together the largest last five digits win, then the smallest id
    order = F.struct("updated_at", F.col("project_id") % 100000, -F.col("project_id"))
    return t.projects_v.groupBy("user_id").agg(F.max_by("project_id", order).alias("project_id"))


@query("a_33", """
    SELECT user_id, COALESCE(STRING_AGG(name, ',' ORDER BY name) FILTER (WHERE entity_type = 'technology' AND name IN ('blue anvil', 'cold plate', 'red anvil')), '') AS databases,
      COALESCE(STRING_AGG(name, ',' ORDER BY name) FILTER (WHERE entity_type = 'service' AND name NOT IN ('blue gizmo')), '') AS integrations,
      COALESCE(STRING_AGG(name, ',' ORDER BY name) FILTER (WHERE entity_type = 'repository'), '') AS repositories FROM nodes_v GROUP BY user_id""")
def a_33(t):
    names = {"databases": ("technology", ["blue anvil", "cold plate", "red anvil"]), "cloud_providers": ("service", ["blue gizmo"])}
    df = A.environment(t.nodes_v, names)
    return df.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("databases", "integrations", "repositories")])


@query("a_34", """SELECT user_id, COUNT(*) AS node_count, COUNT(*) FILTER (WHERE confidence >= 0.7) AS high_confidence, ROUND(AVG(confidence), 6) AS mean_confidence FROM traits_v GROUP BY user_id""")
def a_34(t):
    return rounded(I.identity_status(t.traits_v), "mean_confidence").drop("last_update")


@query("a_37", """SELECT memory_id, cognitive_state, memory_strength, reinforcement_count, retrieval_count, CAST(FLOOR((1706745600 - COALESCE(accessed_s, created_s)) / 86400.0) AS BIGINT) AS days_since_access FROM memories_v""")
def a_37(t):
    return A.lifecycle_status(t.memories_v, as_of()).drop("decay_rate")


@query("j_15", """SELECT m.user_id, COUNT(*) FILTER (WHERE created_s >= COALESCE(last, 946684800)) AS growth FROM memories_v m
    LEFT JOIN (SELECT user_id, MAX(started_s) AS last FROM runs_v WHERE status = 'completed' GROUP BY user_id) r ON r.user_id = m.user_id GROUP BY m.user_id""")
def j_15(t):
    return A.growth_since_last_run(t.memories_v, t.runs_v)


_READY = "SELECT user_id, ARG_MAX(status, started_s * 10000000 + run_id % 10000000) <> 'running' AND 1706745600 - MAX(started_s) >= 3600 AS ready FROM runs_v GROUP BY user_id"


@query("st_05", _READY)
def st_05(t):
    return A.cooled_down(t.runs_v, as_of())


@query("w_11", f"""SELECT m.user_id, COUNT(*) FILTER (WHERE created_s >= COALESCE(last, 946684800)) AS growth FROM memories_v m
    LEFT JOIN (SELECT user_id, MAX(started_s) AS last FROM runs_v WHERE status = 'completed' GROUP BY user_id) r ON r.user_id = m.user_id LEFT JOIN ({_READY}) c ON c.user_id = m.user_id
    WHERE COALESCE(c.ready, TRUE) GROUP BY m.user_id ORDER BY growth DESC, m.user_id LIMIT 20""")
def w_11(t):
    return A.eligible_users(t.memories_v, t.runs_v, as_of())


# ---- set operations -----------------------------------------------------------------
@query("set_01", """
    SELECT user_id, type, label, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_s DESC, type, label, key) AS rank FROM (
      SELECT user_id, 'decision' AS type, decision AS label, ts_s, CAST(decision_id AS VARCHAR) AS key FROM decisions_v
      UNION ALL SELECT user_id, 'task_started', name, first_s, node_id FROM nodes_v WHERE entity_type = 'task')) WHERE rank <= 10""")
def set_01(t):
    from engram.plans.world import timeline_past
    return timeline_past(t.decisions_v, t.nodes_v, 10).select("user_id", "type", "label", "rank")


@query("set_02", """
    SELECT user_id, 'next_step' AS type, project_name AS project, next_step AS label FROM projects_v WHERE next_step IS NOT NULL
    UNION ALL SELECT user_id, 'roadmap_item', project_name, roadmap_item FROM projects_v""")
def set_02(t):
    from engram.plans.world import timeline_future
    return timeline_future(t.projects_v.withColumn("roadmap", F.array("roadmap_item"))).select("user_id", "type", "project", "label")


@query("set_03", "SELECT user_id, concept_name AS value, 'concept' AS origin FROM concepts_v UNION ALL SELECT user_id, node_value, 'trait' FROM traits_v")
def set_03(t):
    a = t.concepts_v.select("user_id", F.col("concept_name").alias("value"), F.lit("concept").alias("origin"))
    return a.unionByName(t.traits_v.select("user_id", F.col("node_value").alias("value"), F.lit("trait").alias("origin")))


_W = r"LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER({c}), '[\p{{L}}\p{{N}}_]+'))"


@query("set_04", rf"""SELECT memory_id, LEN(LIST_INTERSECT(a, b)) AS n_both, LEN(a) - LEN(LIST_INTERSECT(a, b)) AS n_only, LEN(a) + LEN(b) - LEN(LIST_INTERSECT(a, b)) AS n_union
    FROM (SELECT memory_id, {_W.format(c="COALESCE(content, '')")} AS a, {_W.format(c="COALESCE(summary, '')")} AS b FROM memories_v)""")
def set_04(t):
    """The words of every memory against those of its summary."""
    a, b = T.word_set(F.coalesce("content", F.lit(""))), T.word_set(F.coalesce("summary", F.lit("")))
    return t.memories_v.select("memory_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_only"), F.size(F.array_union(a, b)).alias("n_union"))


_P = "COALESCE({c}, '')"


@query("set_04_user_queries", rf"""SELECT memory_id, query_id, LEN(LIST_INTERSECT(a, b)) AS n_both, LEN(a) - LEN(LIST_INTERSECT(a, b)) AS n_only, LEN(a) + LEN(b) - LEN(LIST_INTERSECT(a, b)) AS n_union
    FROM (SELECT memory_id, query_id, {_W.format(c=_P.format(c='content'))} AS a, {_W.format(c=_P.format(c='query'))} AS b FROM memories_v m LEFT JOIN queries_v q ON q.user_id = m.user_id)""")
def set_04_user_queries(t):
    """Every memory against the queries of its user."""
    a, b = T.word_set(F.coalesce("content", F.lit(""))), T.word_set(F.coalesce("query", F.lit("")))
    both = t.memories_v.join(t.queries_v, "user_id", "left")
    return both.select("memory_id", "query_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_only"), F.size(F.array_union(a, b)).alias("n_union"))


@query("set_05", r"""SELECT conv_id, turn, STRING_AGG(w, ' ' ORDER BY i) AS words FROM (SELECT conv_id, turn, w, MIN(i) AS i FROM (
      SELECT conv_id, turn, UNNEST(ws) AS w, UNNEST(RANGE(1, LEN(ws) + 1)) AS i FROM (SELECT conv_id, turn, REGEXP_EXTRACT_ALL(LOWER(text), '[\p{L}\p{N}_]+') AS ws FROM turns_v)) GROUP BY conv_id, turn, w) GROUP BY conv_id, turn""")
def set_05(t):
    return t.turns_v.select("conv_id", "turn", F.array_join(F.array_distinct(T.word_list(F.col("text"))), " ").alias("words")).filter("words <> ''")


@query("j_16", "SELECT c.user_id, concept_name FROM concepts_v c WHERE NOT EXISTS (SELECT 1 FROM nodes_v n WHERE n.user_id = c.user_id AND n.name = c.concept_name)")
def j_16(t):
    known = t.nodes_v.select("user_id", F.col("name").alias("concept_name"))
    return t.concepts_v.join(known, ["user_id", "concept_name"], "left_anti").select("user_id", "concept_name")


@query("j_17", "SELECT memory_id, user_id FROM memories_v WHERE memory_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j_17(t):
    ids = t.labels.filter("quality = 1").select(F.col("doc_id").alias("memory_id"))
    return t.memories_v.join(ids, "memory_id", "left_semi").select("memory_id", "user_id")


# ---- scores ----------------------------------------------------------------------------
@query("sc_57", """
    SELECT memory_id, ROUND(importance_score * 0.35 + (1.0 - CASE WHEN memory_strength <> 0 THEN memory_strength ELSE 0.5 END) * 0.25
      + CASE WHEN EXISTS (SELECT 1 FROM (SELECT UNNEST(supporting_memory_ids) AS i FROM traits_v WHERE reinforced_s >= 1706745600 - 7 * 86400) s WHERE s.i = m.memory_id) THEN 0.3 ELSE 0.0 END
      + LEAST(1.0, reinforcement_count / 10.0) * 0.20, 6) AS priority FROM memories_v m""")
def sc_57(t):
    df = recent_identity_flags(t.memories_v, t.traits_v, as_of())
    value = L.replay_priority(F.col("importance_score"), F.lit(None).cast("double"), F.col("memory_strength"), F.col("reinforcement_count"), F.col("recent_identity"), F.lit(False))
    return df.select("memory_id", r6(value).alias("priority"))


def band_sql(v: str, lo: float, hi: float) -> str:
    width = max(hi - lo, 0.05)
    return f"(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {v} < {lo} THEN GREATEST(0.0, 1.0 - ({lo} - {v}) / {width}) ELSE GREATEST(0.0, 1.0 - ({v} - {hi}) / {width}) END)"


@query("sc_58", f"SELECT memory_id, ROUND({band_sql('importance_score', 0.05, 0.40)}, 6) AS band FROM memories_v")
def sc_58(t):
    return t.memories_v.select("memory_id", r6(Q.band_score(F.col("importance_score"), 0.05, 0.40)).alias("band"))


@query("sc_59", f"""SELECT memory_id, ROUND(GREATEST(0.0, LEAST(100.0, ((1 - importance_score) * 0.15 + {band_sql('reinforcement_score', 0.05, 0.40)} * 0.10 + {band_sql('emotional_salience_score', 0.0, 0.15)} * 0.10
    + COALESCE(memory_strength, 0.0) * 0.25 + (1 - entropy_score) * 0.25 + future_utility_score * 0.15) * 100)), 6) AS health FROM memories_v""")
def sc_59(t):
    value = Q.health_score(F.col("importance_score"), F.col("reinforcement_score"), F.col("emotional_salience_score"), F.coalesce("memory_strength", F.lit(0.0)), F.col("entropy_score"), F.col("future_utility_score"))
    return t.memories_v.select("memory_id", r6(value).alias("health"))


@query("sc_60", f"""SELECT node_id, ROUND({clamp_sql('0.7 * (confidence + 0.1) + 0.3 * confidence')}, 6) AS reinforced, ROUND({clamp_sql('0.7 * importance + 0.3 * (0.7 * 0.9 + 0.3 * confidence)')}, 6) AS averaged,
    ROUND(LEAST(1.0, confidence * {case_sql('node_type', V.TRAIT_TYPE_WEIGHT, 0.5)}), 6) AS importance FROM traits_v""")
def sc_60(t):
    c = F.col("confidence")
    return t.traits_v.select("node_id", r6(I.reinforced_confidence(c)).alias("reinforced"), r6(I.evidence_average(c, F.array(F.lit(0.9), F.col("importance")))).alias("averaged"),
                             r6(I.trait_importance(F.col("node_type"), c)).alias("importance"))


@query("sc_61", """SELECT node_id, ROUND(GREATEST(0.0, confidence - loss), 6) AS new_confidence, CASE WHEN GREATEST(0.0, confidence - loss) < 0.2 THEN 'declined' ELSE 'decayed' END AS event_type
    FROM (SELECT *, FLOOR((1706745600 - COALESCE(reinforced_s, created_s)) / 86400.0) * decay_rate AS loss FROM traits_v) WHERE loss > 0.01""")
def sc_61(t):
    _, history = I.decay_traits(t.traits_v, as_of())
    return history.select("node_id", r6("new_confidence").alias("new_confidence"), "event_type")


TRAIT_QUERY_WORDS = {"goal": ["that", "with"], "skill": ["is", "on"], "interest": ["about"]}
_BY_TYPE = " OR ".join(f"(node_type = '{k}' AND {hit_sql('LOWER(query)', ws)} > 0)" for k, ws in TRAIT_QUERY_WORDS.items())
RELEVANT_SQL = f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(relevance, 12) DESC, i) AS rank FROM (
      SELECT q.query_id, q.user_id, t.*, CASE WHEN contains(LOWER(query), node_value) THEN 0.7 WHEN {_BY_TYPE} THEN 0.3 ELSE 0.0 END * confidence AS relevance
      FROM queries_v q JOIN (SELECT user_id AS u, node_id, node_type, node_value, confidence, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY importance DESC, node_id) AS i FROM traits_v WHERE confidence >= 0.5) t ON t.u = q.user_id AND t.i <= 20)
    WHERE relevance > 0) WHERE rank <= 5"""


def relevant(t):
    return I.relevant_traits(t.queries_v, t.traits_v, words=TRAIT_QUERY_WORDS)


@query("sc_62", f"SELECT query_id, node_id, rank, ROUND(relevance, 6) AS relevance FROM ({RELEVANT_SQL})")
def sc_62(t):
    return relevant(t).select("query_id", "node_id", "rank", r6("relevance").alias("relevance"))


@query("sc_63", """
    SELECT q.query_id, concept_id, ROUND(confidence * PRODUCT(CASE WHEN contains(concept_name, v) THEN 1.2 WHEN contains(description, v) THEN 1.1 ELSE 1.0 END), 6) AS relevance
    FROM concepts_v c JOIN (SELECT query_id, user_id, UNNEST(['ring', 'cold', 'brand#1']) AS v FROM queries_v) q ON q.user_id = c.user_id GROUP BY q.query_id, concept_id, confidence""")
def sc_63(t):
    chosen = t.queries_v.select("query_id", "user_id", F.explode(F.array(F.lit("ring"), F.lit("cold"), F.lit("brand#1"))).alias("node_value"))
    return I.concepts_by_identity(t.concepts_v, chosen).select("query_id", "concept_id", r6("relevance_to_identity").alias("relevance"))


@query("sc_64", """SELECT user_id, ARG_MAX(node_value, confidence * 1000000000 - node_id) AS primary_style, ROUND(MAX(confidence), 6) AS style_confidence, COUNT(*) AS n_styles FROM traits_v WHERE node_type = 'communication' AND confidence >= 0.4 GROUP BY user_id""")
def sc_64(t):
    df = I.communication_style(t.traits_v)
    return df.select("user_id", "primary_style", r6("style_confidence").alias("style_confidence"), F.size("style_traits").cast("long").alias("n_styles"))


@query("sc_70", "SELECT user_id, ROUND(GREATEST(0.0, LEAST(1.0, AVG(future_utility_score) * 0.7 + AVG(importance_score) * 0.3)), 6) AS confidence FROM memories_v GROUP BY user_id")
def sc_70(t):
    return t.memories_v.groupBy("user_id").agg(r6(Q.merge_confidence(F.avg("future_utility_score"), F.avg("importance_score"))).alias("confidence"))


@query("j_13", """
    SELECT a.user_id, a.node_value AS trait1, b.node_value AS trait2, ROUND(LEAST(a.c, b.c), 6) AS conflict_level
    FROM (VALUES ('the', 'and'), ('for', 'with'), ('der', 'die')) p(x, y)
      JOIN (SELECT user_id, node_value, MAX(confidence) AS c FROM traits_v WHERE confidence >= 0.6 GROUP BY user_id, node_value) a ON a.node_value = p.x
      JOIN (SELECT user_id, node_value, MAX(confidence) AS c FROM traits_v WHERE confidence >= 0.6 GROUP BY user_id, node_value) b ON b.node_value = p.y AND b.user_id = a.user_id""")
def j_13(t):
    rows = I.value_conflicts(t.traits_v, [("the", "and"), ("for", "with"), ("der", "die")])
    return rows.select("user_id", "trait1", "trait2", r6("conflict_level").alias("conflict_level"))


_SHIFT = """SELECT *, COALESCE(reinforced_s >= 1706745600 - 60 * 86400, FALSE) OR created_s >= 1706745600 - 60 * 86400 AS recent FROM traits_v WHERE node_type IN ('interest', 'trait', 'skill')"""


@query("w_09", f"""
    WITH s AS MATERIALIZED ({_SHIFT}),
      old AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(importance * confidence, 12) DESC, node_id) AS r FROM s WHERE NOT recent),
      new AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(confidence * CASE WHEN evidence_count <> 0 THEN evidence_count ELSE 1 END, 12) DESC, node_id) AS r FROM s WHERE recent),
      n AS (SELECT user_id, COUNT(*) AS n_recent FROM s WHERE recent GROUP BY user_id)
    SELECT n.user_id, old.node_value AS old_identity, new.node_value AS new_identity, ROUND(new.confidence, 6) AS confidence, n_recent
    FROM n JOIN old ON old.user_id = n.user_id AND old.r = 1 JOIN new ON new.user_id = n.user_id AND new.r = 1 WHERE n_recent >= 3 AND new.confidence >= 0.6""")
def w_09(t):
    rows = I.identity_shifts(t.traits_v, as_of(), 60)
    return rows.select("user_id", "old_identity", "new_identity", r6("confidence").alias("confidence"), "n_recent")


@query("a_31", """SELECT user_id, node_type, STRING_AGG(node_value, ',' ORDER BY importance DESC, node_id) AS traits FROM traits_v WHERE confidence >= 0.5 GROUP BY user_id, node_type""")
def a_31(t):
    return I.profile(t.traits_v).select("user_id", "node_type", F.array_join(F.transform("items", lambda s: s["value"]), ",").alias("traits"))


@query("a_31_skills", """SELECT user_id, COUNT(*) AS total_skills, COUNT(*) FILTER (WHERE confidence >= 0.8) AS expert, COUNT(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.8) AS intermediate,
    COUNT(*) FILTER (WHERE confidence < 0.6) AS learning, CASE WHEN AVG(confidence) >= 0.8 THEN 'expert' WHEN AVG(confidence) >= 0.6 THEN 'advanced' WHEN AVG(confidence) >= 0.4 THEN 'intermediate' ELSE 'novice' END AS skill_level
    FROM traits_v WHERE node_type = 'skill' AND confidence >= 0.4 GROUP BY user_id""")
def a_31_skills(t):
    return I.skill_tiers(t.traits_v)


@query("a_32")
def a_32(t):
    return I.profile_text(t.traits_v)


_HIST = "SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_s DESC, event_id DESC) AS r FROM history_v"


@query("a_32_evolution", f"""
    SELECT user_id, COALESCE(STRING_AGG(node_value, ',' ORDER BY r) FILTER (WHERE ABS(confidence_delta) >= 0.15 AND event_type = 'emerged'), '') AS emerged,
      COALESCE(STRING_AGG(node_value, ',' ORDER BY r) FILTER (WHERE ABS(confidence_delta) >= 0.15 AND event_type IN ('declined', 'decayed')), '') AS declined, COUNT(*) AS total_changes
    FROM ({_HIST}) WHERE r <= 50 GROUP BY user_id""")
def a_32_evolution(t):
    df = I.evolution_narrative(t.history_v)
    return df.select("user_id", F.array_join("emerged", ",").alias("emerged"), F.array_join("declined", ",").alias("declined"), "total_changes")
