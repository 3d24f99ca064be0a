"""Decay, transitions, reinforcement, forgetting (SC-41 … SC-57) and filters (FLT-01 … FLT-19, SRC-01, SRC-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import vocab as V
from engram.catalog.registry import query, r6
from engram.catalog.relevance import ELIGIBLE_SQL, EXP_RECENCY_SQL
from engram.catalog.texts import BUCKETS, case_sql, clamp_sql
from engram.catalog.views import as_of, world_as_of
from engram.functions import lifecycle as L
from engram.functions import relevance as R
from engram.functions import text as T
from engram.operators import eligibility as E
from engram.operators.memberships import membership_flags
from engram.sources import store as ST

IDLE = "CAST(FLOOR((1706745600 - COALESCE(accessed_s, created_s)) / 86400.0) AS BIGINT)"
BASE_DECAY_SQL = (f"(CASE WHEN memory_type = 'episodic' AND importance_score < 0.25 THEN 0.12 ELSE "
                  f"{case_sql('memory_type', V.BASE_DECAY, 0.05)} END)")
FLAGS_SQL = """SELECT m.*, EXISTS (SELECT 1 FROM (SELECT UNNEST(supporting_memory_ids) AS i FROM concepts_v) c WHERE c.i = m.memory_id) AS in_concept,
    EXISTS (SELECT 1 FROM (SELECT UNNEST(supporting_memory_ids) AS i FROM traits_v) c WHERE c.i = m.memory_id) AS in_identity FROM memories_v m"""
EFFECTIVE_SQL = f"""GREATEST(0.0001, LEAST(1.0, {BASE_DECAY_SQL} * LEAST(2.0, 1.0 + GREATEST(0.0, (1706745600 - COALESCE(accessed_s, created_s)) / 86400.0) / 365.0)
    * (1.0 / (1.0 + LN(1 + retrieval_count))) * (1.0 - reinforcement_score * 0.6)
    * (CASE WHEN in_identity THEN 0.5 ELSE 1.0 END * CASE WHEN in_concept THEN 0.7 ELSE 1.0 END)
    * (1.0 - importance_score * 0.5) * (1.0 - emotional_salience_score * 0.3)))"""
STEP_SQL = """CASE WHEN cognitive_state IN ('active', 'reinforced') AND idle > 30 THEN 'dormant' WHEN cognitive_state = 'dormant' AND idle > 60 THEN 'decaying'
    WHEN cognitive_state = 'decaying' AND idle > 90 THEN 'archived' ELSE cognitive_state END"""
WITH_IDLE = f"SELECT *, {IDLE} AS idle FROM memories_v"


def idle_days(as_of_col=None):
    return R.whole_days(as_of() if as_of_col is None else as_of_col, F.coalesce("last_accessed", "created_at"))


def flagged(t):
    return membership_flags(t.memories_v, t.concepts_v, t.traits_v)


@query("j_02", f"SELECT memory_id, in_concept, in_identity FROM ({FLAGS_SQL})")
def j_02(t):
    return flagged(t).select("memory_id", "in_concept", "in_identity")


@query("sc_41", f"SELECT memory_id, {BASE_DECAY_SQL} AS base_rate FROM memories_v")
def sc_41(t):
    return t.memories_v.select("memory_id", L.base_decay(F.col("memory_type"), F.col("importance_score")).alias("base_rate"))


def decay_rate(df):
    from engram.plans.evolution import effective_rate
    return effective_rate(as_of())


@query("sc_42", f"SELECT memory_id, ROUND({EFFECTIVE_SQL}, 6) AS rate FROM ({FLAGS_SQL})")
def sc_42(t):
    return flagged(t).select("memory_id", r6(decay_rate(None)).alias("rate"))


@query("sc_43", f"SELECT memory_id, ROUND(GREATEST(0.0, COALESCE(memory_strength, 0.5) * (1.0 - {EFFECTIVE_SQL})), 6) AS memory_strength FROM ({FLAGS_SQL})")
def sc_43(t):
    from engram.plans.evolution import apply_decay
    return apply_decay(flagged(t), as_of()).select("memory_id", r6("memory_strength").alias("memory_strength"))


@query("sc_45", """
    SELECT memory_id, CASE WHEN cognitive_state IN ('dormant', 'decaying', 'archived') THEN CASE WHEN memory_strength >= 0.70 THEN 'active'
      WHEN memory_strength >= 0.50 THEN 'reinforced' ELSE 'dormant' END ELSE cognitive_state END AS new_state,
      ROUND(CASE WHEN cognitive_state IN ('dormant', 'decaying', 'archived') THEN CASE WHEN memory_strength IS NULL THEN 1.0 ELSE LEAST(1.0, memory_strength + 0.1) END ELSE memory_strength END, 6) AS new_strength
    FROM memories_v""")
def sc_45(t):
    state, strength = L.state_on_access(F.col("cognitive_state"), F.col("memory_strength"))
    return t.memories_v.select("memory_id", state.alias("new_state"), r6(strength).alias("new_strength"))


@query("sc_46", """
    SELECT memory_id, CASE WHEN reinforcement_count >= 5 AND memory_strength >= 0.70 THEN 'semantic_candidate'
      WHEN reinforcement_count >= 3 AND memory_strength >= 0.75 THEN 'active'
      WHEN reinforcement_count >= 2 AND memory_strength >= 0.65 THEN 'reinforced' ELSE cognitive_state END AS new_state FROM memories_v""")
def sc_46(t):
    state = L.state_on_reinforcement(F.col("cognitive_state"), F.col("memory_strength"), F.col("reinforcement_count"))
    return t.memories_v.select("memory_id", state.alias("new_state"))


@query("sc_47", f"""
    SELECT memory_id, {STEP_SQL} AS new_state, ROUND(CASE WHEN {STEP_SQL} <> cognitive_state THEN memory_strength
        * {case_sql('cognitive_state', {'active': 0.9, 'reinforced': 0.85, 'dormant': 0.8, 'decaying': 0.7}, 1.0)}
      ELSE GREATEST(0.0, COALESCE(memory_strength, -9.0) * (1.0 - decay_rate)) END, 6) AS new_strength
    FROM ({WITH_IDLE}) """)
def sc_47(t):
    state, strength = L.time_decay(F.col("cognitive_state"), F.col("memory_strength"), F.col("decay_rate"), idle_days())
    return t.memories_v.select("memory_id", state.alias("new_state"), r6(strength).alias("new_strength"))


@query("sc_48", "SELECT memory_id, ROUND(COALESCE(memory_strength, 0.5) * POW(1.0 - decay_rate, memory_id % 9), 10) AS new_strength FROM memories_v")
def sc_48(t):
    value = L.decayed_steps(F.coalesce("memory_strength", F.lit(0.5)), F.col("decay_rate"), F.col("memory_id") % 9)
    return t.memories_v.select("memory_id", F.round(value, 10).alias("new_strength"))


_TARGET = "CASE CAST(memory_id % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(V.STATES)) + " END"
_LEGAL = " OR ".join(f"(cognitive_state = '{s}' AND target IN ({', '.join(repr(x) for x in ts)}))" for s, ts in V.TRANSITIONS.items())


@query("sc_49", f"""
    SELECT memory_id, {_LEGAL} AS success, CASE WHEN {_LEGAL} THEN target ELSE cognitive_state END AS new_state,
      ROUND(CASE WHEN {_LEGAL} THEN {clamp_sql(f"COALESCE(memory_strength, 0.5) + {case_sql('target', V.TRANSITION_STRENGTH, 0.0)}")} ELSE COALESCE(memory_strength, 0.5) END, 6) AS new_strength
    FROM (SELECT *, {_TARGET} AS target FROM memories_v)""")
def sc_49(t):
    target = F.element_at(T.strings(V.STATES), (F.col("memory_id") % 7 + 1).cast("int"))
    ok, state, strength = L.transition(F.col("cognitive_state"), F.coalesce("memory_strength", F.lit(0.5)), F.col("target"))
    return t.memories_v.withColumn("target", target).select(
        "memory_id", ok.alias("success"), state.alias("new_state"), r6(strength).alias("new_strength"))


@query("sc_50", f"""
    SELECT memory_id, CASE WHEN step = 'archived' AND idle > 180 THEN 'forgotten' ELSE step END AS new_state,
      ROUND(CASE WHEN step = 'archived' AND idle > 180 THEN GREATEST(0.0, COALESCE(memory_strength, 0.0) * 0.5) ELSE memory_strength END, 6) AS new_strength
    FROM (SELECT *, {STEP_SQL} AS step FROM ({WITH_IDLE}))""")
def sc_50(t):
    state, strength = L.after_decay(F.col("cognitive_state"), F.col("memory_strength"), idle_days())
    return t.memories_v.select("memory_id", state.alias("new_state"), r6(strength).alias("new_strength"))


@query("sc_51", f"""
    SELECT memory_id, CASE WHEN cognitive_state = 'archived' AND s <= 0.10 AND idle >= 180 THEN 'Forgotten'
        WHEN cognitive_state IN ('archived', 'forgotten') THEN 'Remain'
        WHEN s <= 0.30 THEN CASE WHEN cognitive_state IN ('semantic_candidate', 'dormant', 'decaying') THEN 'Archived' ELSE 'Remain' END
        WHEN s <= 0.55 THEN 'Weaken' ELSE 'Remain' END AS decision,
      ROUND(CASE WHEN cognitive_state = 'archived' AND s <= 0.10 AND idle >= 180 THEN LEAST(1.0, (1.0 - s) + idle / 365.0 * 0.1)
        WHEN cognitive_state IN ('archived', 'forgotten') THEN 1.0 - ABS(s - 0.7)
        WHEN s <= 0.30 THEN LEAST(1.0, 1.0 - s) WHEN s <= 0.55 THEN 0.6 ELSE 1.0 - ABS(s - 0.7) END, 6) AS confidence
    FROM (SELECT *, COALESCE(memory_strength, 0.5) AS s FROM ({WITH_IDLE}))""")
def sc_51(t):
    decision, confidence = L.forgetting_decision(F.col("cognitive_state"), F.col("memory_strength"), idle_days())
    return t.memories_v.select("memory_id", decision.alias("decision"), r6(confidence).alias("confidence"))


@query("sc_52", """
    SELECT memory_id, ROUND(s, 6) AS memory_strength, n AS reinforcement_count, ROUND(GREATEST(0.0, decay_rate * 0.8), 6) AS decay_rate,
      CASE WHEN s >= 0.85 AND n >= 3 THEN 'active' WHEN s >= 0.70 AND n >= 2 THEN 'reinforced' WHEN n >= 5 AND s >= 0.60 THEN 'semantic_candidate'
        WHEN s < 0.30 THEN 'decaying' WHEN n >= 4 THEN 'semantic_candidate' ELSE 'reinforced' END AS cognitive_state
    FROM (SELECT memory_id, decay_rate, LEAST(1.0, COALESCE(memory_strength, 0.5) + 0.1) AS s, reinforcement_count + 1 AS n FROM memories_v)""")
def sc_52(t):
    new = L.reinforce(F.coalesce("memory_strength", F.lit(0.5)), F.col("reinforcement_count"), F.col("decay_rate"))
    return t.memories_v.select("memory_id", r6(new["memory_strength"]).alias("memory_strength"),
                               new["reinforcement_count"].alias("reinforcement_count"), r6(new["decay_rate"]).alias("decay_rate"),
                               new["cognitive_state"].alias("cognitive_state"))


@query("sc_53", """
    SELECT memory_id, 'decaying' AS cognitive_state, ROUND(memory_strength * 0.8, 6) AS memory_strength, ROUND(decay_rate * 1.2, 6) AS decay_rate
    FROM memories_v WHERE cognitive_state = 'dormant' AND (accessed_s < 1706745600 - 30 * 86400 OR accessed_s IS NULL)""")
def sc_53(t):
    from engram.plans.evolution import stale_decay
    rows = stale_decay(t.memories_v, as_of()).filter("changed")
    return rows.select("memory_id", "cognitive_state", r6("memory_strength").alias("memory_strength"), r6("decay_rate").alias("decay_rate"))


@query("sc_54", """
    SELECT memory_id, 'archived' AS cognitive_state, ROUND(CASE WHEN memory_strength IS NULL THEN 1.0 ELSE LEAST(1.0, memory_strength * 1.2) END, 6) AS memory_strength
    FROM memories_v WHERE cognitive_state = 'semantic_candidate'""")
def sc_54(t):
    from engram.plans.evolution import archive_candidates
    rows = archive_candidates(t.memories_v).filter("changed")
    return rows.select("memory_id", "cognitive_state", r6("memory_strength").alias("memory_strength"))


@query("sc_55", """
    SELECT memory_id, CASE WHEN s >= 0.70 THEN 'active' ELSE 'reinforced' END AS new_state, ROUND(s, 6) AS new_strength, revival_count + 1 AS revival_count
    FROM (SELECT *, LEAST(1.0, CASE WHEN memory_strength IS NULL OR memory_strength = 0 THEN 0.3 ELSE memory_strength END + 0.25) AS s FROM memories_v
      WHERE cognitive_state IN ('dormant', 'decaying', 'archived', 'forgotten'))""")
def sc_55(t):
    state, strength = L.revive(F.col("memory_strength"))
    return t.memories_v.filter(E.revivable()).select(
        "memory_id", state.alias("new_state"), r6(strength).alias("new_strength"), (F.col("revival_count") + 1).alias("revival_count"))


@query("sc_56", f"""SELECT memory_id, ROUND({EXP_RECENCY_SQL} * 0.40 + reinforcement_score * 0.35 + COALESCE(memory_strength, 0.5) * 0.25, 6) AS score
    FROM memories_v""")
def sc_56(t):
    recency = R.exponential_recency(as_of(), F.coalesce("last_accessed", "created_at"))
    return t.memories_v.select("memory_id", r6(L.resolution_score(recency, F.col("reinforcement_score"), F.col("memory_strength"))).alias("score"))


# ---- filters -----------------------------------------------------------------
@query("src_01", """SELECT user_id, memory_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY importance_score DESC, memory_id) AS rank
    FROM memories_v) WHERE rank <= 100""")
def src_01(t):
    return ST.memories_by_user(t.memories_v).select("user_id", "memory_id", "rank")


@query("src_18", """SELECT v.memory_id FROM vectors_v v WHERE NOT EXISTS (SELECT 1 FROM memories_v m WHERE m.memory_id = v.memory_id
    AND m.cognitive_state IN ('archived', 'forgotten'))""")
def src_18(t):
    return ST.reclaim_vectors(t.vectors_v, t.memories_v).select("memory_id")


@query("flt_01", f"SELECT memory_id FROM memories_v WHERE importance_score >= 0.2 AND {ELIGIBLE_SQL} AND memory_type IN ('identity', 'semantic', 'concept')")
def flt_01(t):
    return t.memories_v.filter(E.retrievable(0.2, ["identity", "semantic", "concept"])).select("memory_id")


FLT02_SQL = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_s DESC, memory_id) AS rank FROM memories_v
    WHERE memory_type IN ('episodic', 'semantic') AND cognitive_state IN ('active', 'reinforced', 'semantic_candidate') AND importance_score >= 0.6) WHERE rank <= 1000"""


@query("flt_02", f"SELECT user_id, memory_id, rank FROM ({FLT02_SQL})")
def flt_02(t):
    return E.consolidation_candidates(t.memories_v).select("user_id", "memory_id", "rank")


@query("flt_03", "SELECT memory_id FROM memories_v WHERE cognitive_state IN ('dormant', 'decaying', 'archived', 'forgotten')")
def flt_03(t):
    return t.memories_v.filter(E.revivable()).select("memory_id")


@query("flt_04", "SELECT memory_id, cognitive_state <> 'forgotten' AS kept, cognitive_state NOT IN ('archived', 'forgotten') AS active FROM memories_v")
def flt_04(t):
    return t.memories_v.select("memory_id", (F.col("cognitive_state") != "forgotten").alias("kept"), E.active().alias("active"))


@query("flt_06", """
    SELECT query_id, concept_id, rank FROM (SELECT q.query_id, c.concept_id, ROW_NUMBER() OVER (PARTITION BY q.query_id ORDER BY confidence DESC, concept_id) AS rank
      FROM concepts_v c JOIN (SELECT query_id, user_id, CASE WHEN query_id % 2 = 0 THEN 'RING' ELSE 'economy' END AS term FROM queries_v) q USING (user_id)
      WHERE contains(LOWER(concept_name), LOWER(term)) OR contains(LOWER(description), LOWER(term))) WHERE rank <= 10""")
def flt_06(t):
    term = F.when(F.col("query_id") % 2 == 0, "RING").otherwise("economy")
    return E.search_concepts(t.concepts_v, t.queries_v.withColumn("term", term)).select("query_id", "concept_id", "rank")


@query("flt_07", """SELECT user_id, concept_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY confidence DESC, concept_id) AS rank
    FROM concepts_v WHERE confidence >= 0.5) WHERE rank <= 20""")
def flt_07(t):
    return E.list_concepts(t.concepts_v, 0.5, 20).select("user_id", "concept_id", "rank")


@query("flt_08", """SELECT user_id, memory_id, event_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, memory_id ORDER BY ts_s DESC, event_id DESC) AS rank
    FROM activity_v WHERE event_type = 'view') WHERE rank <= 3""")
def flt_08(t):
    return E.event_trail(t.activity_v, "view", 3).select("user_id", "memory_id", "event_id", "rank")


@query("flt_09", """SELECT user_id, event_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_s DESC, event_id DESC) AS rank
    FROM history_v WHERE ts_s >= 1706745600 - 20 * 86400) WHERE rank <= 100""")
def flt_09(t):
    return E.recent_history(t.history_v, as_of(), 20).select("user_id", "event_id", "rank")


@query("flt_10", """SELECT concept_id FROM concepts_v WHERE confidence >= 0.7 AND support_count >= 2 AND LENGTH(concept_name) >= 3 AND LENGTH(description) >= 15""")
def flt_10(t):
    return t.concepts_v.filter(E.sound_concept(min_text=15)).select("concept_id")


@query("flt_11", "SELECT node_id FROM traits_v WHERE confidence >= 0.6 AND evidence_count <= 3")
def flt_11(t):
    return t.traits_v.filter(E.emerging_trait()).select("node_id")


@query("flt_12", """SELECT node_id, ROUND(days * decay_rate, 6) AS decay_amount FROM (SELECT *, FLOOR((1706745600 - reinforced_s) / 86400.0) AS days FROM traits_v)
    WHERE reinforced_s < 1706745600 - 30 * 86400 AND confidence > 0.3 AND days * decay_rate >= 0.1""")
def flt_12(t):
    return E.fading_traits(t.traits_v, as_of()).select("node_id", r6("decay_amount").alias("decay_amount"))


_PATTERN = T.stance_pattern(BUCKETS)
_VERBS = {v: b for b, vs in BUCKETS.items() for v in vs}


@query("flt_13", f"""SELECT memory_id, verb, {case_sql('verb', _VERBS, 'stance')} AS verb_bucket FROM (SELECT memory_id, REGEXP_EXTRACT(LOWER(content), '{_PATTERN}', 1) AS verb
    FROM memories_v) WHERE verb <> ''""")
def flt_13(t):
    rows = E.stance_memories(t.memories_v, BUCKETS)
    return rows.select("memory_id", T.stance_verb(F.col("content"), BUCKETS).alias("verb"), "verb_bucket")


@query("flt_14", "SELECT concept_id FROM concepts_v WHERE NOT retired")
def flt_14(t):
    return t.concepts_v.filter(E.not_retired()).select("concept_id")


@query("flt_15", "SELECT DISTINCT user_id FROM traits_v WHERE confidence >= 0.7 AND reinforced_s < 1706745600 - 7 * 86400")
def flt_15(t):
    return E.users_to_reinforce(t.traits_v, as_of())


@query("flt_16", """SELECT memory_id FROM memories_v WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
    (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA'))))""")
def flt_16(t):
    regions = t.region.filter(F.col("r_name").isin("ASIA", "EUROPE", "AFRICA"))
    tenants = t.nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_nationkey").alias("tenant_id"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("tenant_id"))
    return E.owned_rows(t.memories_v, users, tenants).select("memory_id")


@query("flt_17", "SELECT memory_id, memory_type IN ('semantic', 'concept', 'episodic') AS mergeable, memory_type IN ('identity', 'semantic', 'procedural') AS eligible FROM memories_v")
def flt_17(t):
    return t.memories_v.select("memory_id", F.col("memory_type").isin(*V.DUPLICATE_TYPES).alias("mergeable"),
                               F.col("memory_type").isin(*V.STANCE_TYPES).alias("eligible"))


@query("flt_18", """SELECT user_id, decision_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_s DESC, decision_id DESC) AS rank FROM decisions_v) WHERE rank <= 5""")
def flt_18(t):
    return E.newest(t.decisions_v, ["user_id"], "ts", "decision_id", 5).select("user_id", "decision_id", "rank")


@query("flt_19", """SELECT user_id, run_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY started_s DESC, run_id DESC) AS rank FROM runs_v) WHERE rank <= 10""")
def flt_19(t):
    return E.newest(t.runs_v, ["user_id"], "started_at", "run_id", 10).select("user_id", "run_id", "rank")


@query("w_08", """
    SELECT user_id, name, entity_type, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, entity_type ORDER BY
        CASE WHEN entity_type = 'task' THEN last_s ELSE 0 END DESC, confidence DESC, node_id) AS rank FROM nodes_v
      WHERE entity_type IN ('task', 'technology') AND last_s >= 883612800 - 365 * 86400)
    WHERE rank <= CASE WHEN entity_type = 'task' THEN 10 ELSE 15 END""")
def w_08(t):
    from engram.plans.world import recently_active
    return recently_active(t.nodes_v, world_as_of(), 365).select("user_id", "name", "entity_type", "rank")


# ---- logs and write-back -------------------------------------------------------
@query("src_14", f"""
    SELECT memory_id, 'decay' AS event_type, cognitive_state AS old_state, CASE WHEN step = 'archived' AND idle > 180 THEN 'forgotten' ELSE step END AS new_state
    FROM (SELECT *, {STEP_SQL} AS step FROM ({WITH_IDLE}))""")
def src_14(t):
    from engram.plans.evolution import idle_transitions
    _, events = idle_transitions(t.memories_v, as_of())
    return events.select("memory_id", "event_type", "old_state", "new_state")


@query("src_11", None)
def src_11(t):
    from engram.catalog.relevance import ranked
    from engram.operators import retrieval as RT
    log = ST.retrieval_log(RT.context_lines(RT.with_text(ranked(t), t.memories_v)), t.queries_v, as_of())
    return log.select("query_id", "user_id", F.array_join("retrieved_memory_ids", ",").alias("ids"), "context_token_count")


@query("src_15", """
    WITH n AS MATERIALIZED (SELECT user_id, name, confidence, entity_type FROM nodes_v)
    SELECT COALESCE(b.user_id, d.user_id) AS user_id, COALESCE(b.name, d.name) AS name,
      ROUND(CASE WHEN b.name IS NULL THEN d.confidence WHEN d.name IS NULL THEN b.confidence ELSE LEAST(1.0, b.confidence + 0.05) END, 6) AS confidence
    FROM (SELECT user_id, name, confidence FROM n WHERE entity_type IN ('task', 'project')) b
      FULL OUTER JOIN (SELECT user_id, name, confidence FROM n WHERE entity_type IN ('task', 'service')) d ON b.user_id = d.user_id AND b.name = d.name""")
def src_15(t):
    base = t.nodes_v.filter(F.col("entity_type").isin("task", "project")).select("user_id", "name", "confidence")
    delta = t.nodes_v.filter(F.col("entity_type").isin("task", "service")).select("user_id", "name", "confidence")
    new = F.when(F.col("base.name").isNull(), F.col("delta.confidence")).when(F.col("delta.name").isNull(), F.col("base.confidence")) \
        .otherwise(F.least(F.lit(1.0), F.col("base.confidence") + 0.05))
    return ST.upsert(base, delta, ["user_id", "name"], {"confidence": r6(new)})


@query("src_17", """
    SELECT 'memories' AS table_name, (SELECT COUNT(*) FROM memories_v WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS n_deleted
    UNION ALL SELECT 'vectors', (SELECT COUNT(*) FROM embeddings WHERE vec_id IN (SELECT memory_id FROM memories_v WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)))
    UNION ALL SELECT 'concepts', (SELECT COUNT(*) FROM concepts_v WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
    UNION ALL SELECT 'projects', (SELECT COUNT(*) FROM projects_v WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def src_17(t):
    ids = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    tables = {"memories": t.memories_v, "vectors": t.embeddings.withColumnRenamed("vec_id", "memory_id"),
              "concepts": t.concepts_v, "projects": t.projects_v}
    return ST.erase(tables, ids, children={"vectors": ("memories", "memory_id")})[1]
