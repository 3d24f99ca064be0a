"""Composite jobs over the whole tables (P-01 … P-16, SRC-03 … SRC-16, SC-65 … SC-68, C-10, W-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import hooks as H
from engram import vocab as V
from engram.catalog.extraction import DECISIONS, LOW_SIMILARITY, PATTERNS, PROJECT, RULES, VERBS, VOCABULARY, _REASON, texts
from engram.catalog.registry import query, r6
from engram.catalog.relevance import CASE, GAPS, GOALS, KNOWLEDGE, RANKED_SQL, understood, useful
from engram.catalog.reports import TRAIT_QUERY_WORDS
from engram.catalog.texts import BUCKETS, LEX, WITH_IMPORTANCE
from engram.catalog.views import as_of, world_as_of
from engram.functions import quality as Q
from engram.functions import text as T
from engram.plans import compose as CO
from engram.plans import consolidation as CS
from engram.plans import evolution as EV
from engram.plans import offline as OF
from engram.plans import persona as PE
from engram.plans import recall as RC
from engram.plans import world as W
from engram.sources import store as ST


@query("p_01")
def p_01(t):
    df = RC.retrieve_and_compress(t.memories_v, t.vectors_v, t.query_vectors, as_of(), budget=600)
    return df.select("query_id", "estimated_tokens", "raw_tokens", "source_memory_count", "lines_kept", F.length("context_summary").alias("n_chars"), F.sha2("context_summary", 256).alias("context_sha256"))


@query("p_02")
def p_02(t):
    context, log = RC.reconstruct(t.memories_v, t.vectors_v, t.query_vectors, as_of())
    return context.join(log.select("query_id", "context_token_count"), "query_id").select("query_id", "estimated_tokens", "source_memory_count", "context_token_count")


def recalled(t):
    return RC.predictive_recall(t.memories_v, understood(t), t.traits_v, t.concepts_v, as_of())


@query("p_03")
def p_03(t):
    return recalled(t).select("query_id", "memory_id", "retrieval_rank", "token_cost", r6("utility_score").alias("utility_score"), "selection_reason")


@query("src_12")
def src_12(t):
    log = ST.recall_log(recalled(t), understood(t).select("query_id", "user_id", "query", "goal", "goal_confidence"), as_of())
    return log.select("query_id", "user_id", "goal", F.array_join("selected_memory_ids", ",").alias("ids"), "estimated_tokens", "selected_count", r6("average_utility_score").alias("average_utility_score"))


@query("src_16")
def src_16(t):
    out = ST.write_back(t.memories_v, recalled(t), as_of())
    return out.select("memory_id", "access_count", "retrieval_rank", r6("utility_score").alias("utility_score"))


def composed(t):
    return CO.compose(t.memories_v, understood(t), t.traits_v, t.concepts_v, as_of(), buckets=BUCKETS, expectations=GAPS, flags=CASE)


@query("p_04")
def p_04(t):
    c = composed(t)
    return c.totals.join(c.evaluation.select("query_id", "coverage", "redundancy", "quality_score"), "query_id").select(
        "query_id", "original_tokens", "compressed_tokens", "duplicate_count", "merged_count", *[r6(x).alias(x) for x in ("compression_ratio", "coverage", "redundancy", "quality_score")])


@query("c_10")
def c_10(t):
    rows = useful(t).withColumn("cost", T.budget_tokens(F.coalesce("content", F.lit(""))))
    bare = lambda df: df.drop("content", "summary")
    entries, _ = CO.compress(bare(rows), bare(CO.without_near_copies(rows)), CO.candidate_pool(t.memories_v), V.COMPOSE_BUDGET)
    return entries.select("query_id", "id", "token_cost", "n_sources", "shortened")


@query("src_13")
def src_13(t):
    snap, _ = composed(t).snapshots(as_of())
    return snap.select("query_id", "user_id", "primary_goal", F.length("final_context").alias("n_chars"), F.sha2("final_context", 256).alias("context_sha256"), r6("context_quality").alias("context_quality"))


_KEPT = f"SELECT query_id, STRING_AGG(LOWER(m.content), ' ' ORDER BY rank) AS body, COUNT(*) AS n FROM ({RANKED_SQL}) r JOIN memories_v m ON m.memory_id = r.memory_id GROUP BY query_id"
_TOPICS = KNOWLEDGE["locate"]
_COVER = " + ".join(f"CAST(contains(body, '{c.replace('_', ' ')}') OR {' OR '.join(f'contains(body, {w!r})' for w in c.split('_'))} AS INT)" for c in _TOPICS)


@query("sc_65", f"SELECT query_id, ROUND(({_COVER}) / {len(_TOPICS)}, 6) AS coverage FROM ({_KEPT})")
def sc_65(t):
    from engram.catalog.relevance import ranked
    from engram.operators.retrieval import with_text
    body = with_text(ranked(t), t.memories_v).groupBy("query_id").agg(F.array_join(F.collect_list(F.lower("content")), " ").alias("body"))
    return body.select("query_id", r6(Q.coverage(T.strings(_TOPICS), F.col("body"))).alias("coverage"))


@query("sc_66", """SELECT memory_id, ROUND(GREATEST(0.0, LEAST(1.0, c * 0.25 + (1 - r) * 0.15 + i * 0.20 + g * 0.20 + GREATEST(0.0, LEAST(1.0, c * 0.6 + (1 - r) * 0.4 - LEAST(0.5, m * 0.1) - LEAST(0.5, k * 0.1))) * 0.10
      + GREATEST(0.0, 1 - k * 0.15) * 0.10)), 6) AS quality
    FROM (SELECT memory_id, importance_score AS c, entropy_score AS r, identity_impact_score AS i, future_utility_score AS g, retrieval_count AS m, reinforcement_count AS k FROM memories_v)""")
def sc_66(t):
    c, r, i, g, m, k = (F.col(x) for x in ("importance_score", "entropy_score", "identity_impact_score", "future_utility_score", "retrieval_count", "reinforcement_count"))
    return t.memories_v.select("memory_id", r6(Q.context_quality(c, r, i, g, Q.reasoning_quality(c, r, k, m), k)).alias("quality"))


@query("sc_68")
def sc_68(t):
    entries = recalled(t).withColumn("id", F.col("memory_id"))
    return CO.user_state(understood(t), t.traits_v, entries).select("query_id", "primary_goal", "narrative")


@query("p_05")
def p_05(t):
    e = EV.evolve(t.memories_v, t.concepts_v, t.traits_v, as_of(), BUCKETS)
    return e.memories.select("memory_id", "cognitive_state", r6("memory_strength").alias("memory_strength"), r6("entropy_score").alias("entropy_score"))


@query("p_05_events")
def p_05_events(t):
    e = EV.evolve(t.memories_v, t.concepts_v, t.traits_v, as_of(), BUCKETS)
    return e.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("p_06")
def p_06(t):
    c = CS.consolidate(t.memories_v, t.vectors_v, 0.2, LOW_SIMILARITY / 2.5, 0.0)
    return c.metrics.select("user_id", "total_memories", "cluster_count", "concept_count", "total_relationships", r6("compression_ratio").alias("compression_ratio"))


def passed(t):
    return OF.offline_pass(t.memories_v, t.vectors_v, t.concepts_v, t.traits_v, t.edges_v, as_of(), BUCKETS, LEX, PATTERNS, GOALS, KNOWLEDGE, CASE)


@query("p_07")
def p_07(t):
    return passed(t).session.drop("finished_at").withColumn("storage_compression_ratio", r6("storage_compression_ratio"))


@query("w_10")
def w_10(t):
    rows = OF.select_for_replay(t.memories_v, t.traits_v, as_of(), 20, BUCKETS)
    return rows.select("user_id", "memory_id", "replay_rank", r6("replay_priority").alias("replay_priority"))


@query("p_09")
def p_09(t):
    rows = OF.forward_utility(t.memories_v, t.traits_v, t.concepts_v, as_of(), GOALS, KNOWLEDGE, CASE)
    return rows.select("memory_id", r6("future_utility").alias("future_utility"), "action")


def world(t):
    return W.world_model(texts(t), VOCABULARY, RULES, VERBS, DECISIONS, _REASON, PROJECT, "", "")


@query("p_08")
def p_08(t):
    return world(t).counts()


@query("p_10")
def p_10(t):
    df = W.active_context(t.projects_v, t.nodes_v, t.edges_v, world_as_of(), 365)
    return df.select("user_id", "project_id", "current_phase", F.array_join("blockers", ";").alias("blockers"), F.array_join("tasks", ";").alias("tasks"), F.array_join("technology", ";").alias("technology"))


@query("p_11", """
    SELECT project_id, COALESCE(next_step, roadmap_item) AS likely_next_task, CASE WHEN user_id % 2 = 0 THEN 'cache rules' ELSE '' END AS missing,
      ROUND(0.7 + CASE WHEN user_id % 2 = 0 THEN 0.15 ELSE 0.0 END, 6) AS confidence FROM projects_v""")
def p_11(t):
    rows = t.projects_v.withColumns({"roadmap": F.array("roadmap_item"), "tech_stack": F.when(F.col("user_id") % 2 == 0, F.array(F.lit("Redis"))).otherwise(F.array(F.lit("Vim"))),
                                     "open_questions": F.array().cast("array<string>")})
    df = W.predict_projects(rows, t.decisions_v, expectations=[(["redis"], ["cache rules", "redis"])])
    return df.select("project_id", "likely_next_task", F.array_join("missing_knowledge", ",").alias("missing"), r6("confidence").alias("confidence"))


@query("p_12", """SELECT user_id, 'present' AS part, COUNT(*) AS n FROM projects_v WHERE status = 'active' GROUP BY user_id
    UNION ALL SELECT user_id, 'past', LEAST(50, COUNT(*)) FROM (SELECT user_id FROM decisions_v UNION ALL SELECT user_id FROM nodes_v WHERE entity_type = 'task') GROUP BY user_id
    UNION ALL SELECT user_id, 'future', COUNT(*) FROM (SELECT user_id FROM projects_v WHERE next_step IS NOT NULL UNION ALL SELECT user_id FROM projects_v) GROUP BY user_id""")
def p_12(t):
    parts = {"present": W.timeline_present(t.projects_v), "past": W.timeline_past(t.decisions_v, t.nodes_v),
             "future": W.timeline_future(t.projects_v.withColumn("roadmap", F.array("roadmap_item")))}
    out = None
    for name, df in parts.items():
        rows = df.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(name).alias("part"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("p_13")
def p_13(t):
    df = PE.personalized_context(t.queries_v, t.traits_v, t.concepts_v, TRAIT_QUERY_WORDS)
    return df.select("query_id", F.array_join("trait_values", ",").alias("traits"), F.array_join("concepts", ",").alias("concepts"), "primary_style", "routing_hint", r6("confidence_level").alias("confidence_level"))


@query("p_13_guidance")
def p_13_guidance(t):
    df = PE.response_guidance(t.traits_v)
    return df.select("user_id", F.array_join("goals", ",").alias("goals"), F.array_join("key_interests", ",").alias("interests"), "skill_level", "summary")


@query("p_14")
def p_14(t):
    _, events = EV.idle_transitions(t.memories_v, as_of())
    df = PE.explain_memories(t.memories_v, events)
    return df.select("memory_id", "cognitive_state", "rank", "event_type", "old_state", "new_state", "reason", r6("confidence").alias("confidence"))


def _latest_sql(table: str, columns: str, moment: str, key: str) -> str:
    return f"SELECT user_id, {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY {moment} DESC, {key} DESC) AS n FROM {table}) WHERE n = 1"


@query("p_14_retrieval", _latest_sql("runs_v", "run_id, goal, selected_count, candidate_count, ROUND(average_utility, 6) AS average_utility", "started_s", "run_id"))
def p_14_retrieval(t):
    return PE.explain_latest(t.runs_v, "started_s", "run_id").select("user_id", "run_id", "goal", "selected_count", "candidate_count", r6("average_utility").alias("average_utility"))


@query("p_14_identity", _latest_sql("(SELECT * FROM history_v WHERE event_type <> 'reinforced')", "node_id, event_type, node_value, ROUND(confidence_delta, 6) AS confidence_delta", "ts_s", "event_id"))
def p_14_identity(t):
    shifts = t.history_v.filter("event_type <> 'reinforced'")
    return PE.explain_latest(shifts, "ts_s", "event_id").select("user_id", "node_id", "event_type", "node_value", r6("confidence_delta").alias("confidence_delta"))


@query("p_14_offline", _latest_sql("(SELECT * FROM runs_v WHERE status = 'completed')", "run_id, status, ROUND(total_latency_ms, 6) AS total_latency_ms", "started_s", "run_id"))
def p_14_offline(t):
    return PE.explain_latest(t.runs_v.filter("status = 'completed'"), "started_s", "run_id").select("user_id", "run_id", "status", r6("total_latency_ms").alias("total_latency_ms"))


@query("p_14_decisions", """SELECT user_id, decision_id, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts_s DESC, decision_id DESC) AS INTEGER) AS rank FROM decisions_v) WHERE rank <= 10""")
def p_14_decisions(t):
    return PE.explain_decisions(t.decisions_v).select("user_id", "decision_id", "rank")


@query("p_15")
def p_15(t):
    df = RC.assemble(recalled(t), understood(t), 800)
    return df.select("query_id", "goal", "estimated_tokens", F.length("context_text").alias("n_chars"), F.sha2("context_text", 256).alias("context_sha256"))


# ---- ingest ------------------------------------------------------------------------
@query("src_03", f"""SELECT memory_id, 'active' AS cognitive_state, ROUND(importance, 6) AS importance_score, ROUND(future_utility, 6) AS future_utility_score FROM ({WITH_IMPORTANCE})""")
def src_03(t):
    from engram.streaming.jobs import score_turns
    turns = t.memories_v.select("memory_id", "user_id", "memory_type", F.col("content").alias("text"))
    df = score_turns(turns, LEX)
    return df.select("memory_id", "cognitive_state", r6("importance_score").alias("importance_score"), r6("future_utility_score").alias("future_utility_score"))


@query("udf_01", r"""SELECT conv_id, turn, contains(text, '?') AND LEN(LIST_FILTER(STRING_SPLIT_REGEX(text, '\s+'), x -> x <> '')) > 4 AS is_question, LENGTH(text) AS n_chars,
    CASE WHEN LENGTH(text) = 0 THEN 'empty' END AS size_error FROM turns_v""")
def udf_01(t):
    def size(pdf):
        if (pdf["text"].str.len() == 0).any():
            raise ValueError("empty")
        return pdf.assign(n_chars=pdf["text"].str.len())

    hooks = H.Enrichers()
    hooks.register("message", "question", H.question_flag)
    hooks.register("message", "size", H.isolated("size", size, "n_chars long"))
    return hooks.run("message", t.turns_v).select("conv_id", "turn", "is_question", "n_chars", "size_error")


@query("udf_02")
def udf_02(t):
    def letters(texts):
        return texts.map(lambda s: [float(s.count(c)) for c in "aeiou"])

    v = H.attach_provided_vectors(t.turns_v, letters, "text")
    return v.select("conv_id", "turn", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("udf_03", """SELECT conv_id, 'no_memory' AS strategy, 0 AS tokens FROM (SELECT DISTINCT conv_id FROM turns_v)
    UNION ALL SELECT conv_id, 'longest_turn', MAX(LENGTH(text)) // 4 FROM turns_v GROUP BY conv_id""")
def udf_03(t):
    def longest_turn(turns):
        return turns.groupBy("conv_id").agg(F.floor(F.max(F.length("text")) / 4).cast("long").alias("tokens"))

    return H.compare_strategies(t.turns_v, {"no_memory": H.no_memory, "longest_turn": longest_turn}).select("conv_id", "strategy", "tokens")


@query("p_16")
def p_16(t):
    """A turn without the model call: score and keep it, update the world, compose for it."""
    from engram.streaming.jobs import conversational_turns
    turns = t.turns_v.filter("role = 'user'")
    return conversational_turns(turns, t.memories_v, t.traits_v, t.concepts_v, as_of(), lexicon=LEX, goals=GOALS, knowledge=KNOWLEDGE, flags=CASE)
