"""Retrieval, query understanding, utility and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import vocab as V
from engram.catalog.registry import query, r6
from engram.catalog.texts import KEYWORDS_SQL, case_sql, clamp_sql
from engram.catalog.views import as_of
from engram.functions import relevance as R
from engram.functions import text as T
from engram.operators import packing as K
from engram.operators import pairs as PR
from engram.operators import retrieval as RT
from engram.operators import understanding as U
from engram.operators import utility as UT


def edge(words: str) -> str:
    """A word-bounded alternation that reads alike in both regex dialects."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


CASE = "(?i)"
GOALS = {"narrate": [(edge("the"), 0.5), (edge("that"), 0.4)], "compare": [(edge("and"), 0.3), (edge("with"), 0.6)],
         "locate": [(edge("for"), 0.8)], "wonder": [(edge("it"), 0.2), (edge("is|are"), 0.3)]}
INTENTS = {"state": [(edge("is"), 1.0), (edge("are"), 0.7)], "list": [(edge("and"), 1.0), (edge("of"), 0.4)],
           "point": [(edge("the"), 0.5), (edge("this"), 0.6)]}
KNOWLEDGE = {"narrate": ["the_story", "er_links"], "compare": ["and_also", "zzz"], "locate": ["in_place", "on", "qqq"],
             V.DEFAULT_GOAL: ["la_base"]}
GAPS = [(edge("the"), ["thin", "zzz", "that with"]), (edge("and"), ["zzz", "qq", "hand"]), (edge("of"), ["thin", "offer xxxx"])]


def understood(t):
    return U.understand(t.queries_v, GOALS, INTENTS, KNOWLEDGE, CASE)


# ---- similarity and retrieval ----------------------------------------------
ELIGIBLE_SQL = """cognitive_state NOT IN ('archived', 'forgotten') AND (memory_strength IS NULL OR memory_strength >= 0.15)
  AND (entropy_score IS NULL OR entropy_score <= 0.85)"""
RECENCY_SQL = "GREATEST(0.0, 1 - FLOOR((1706745600 - created_s) / 86400.0) / 365.0)"
RETRIEVAL_SQL = f"""
    SELECT q.query_id, m.*, COALESCE(LIST_COSINE_SIMILARITY(CAST(v.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[])), 0.0) AS similarity,
      COALESCE(LIST_COSINE_SIMILARITY(CAST(v.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[])), 0.0) * 0.40
      + CASE WHEN importance_score > 0 THEN importance_score ELSE 0.5 END * 0.30 + {RECENCY_SQL} * 0.15
      + LEAST(1.0, reinforcement_count * 0.1 * COALESCE(memory_strength, 0.0)) * 0.15 AS retrieval_score
    FROM memories_v m JOIN queries_v q ON m.user_id = q.user_id LEFT JOIN vectors_v v ON m.memory_id = v.memory_id
      LEFT JOIN vectors_v qv ON qv.memory_id = q.query_id
    WHERE importance_score >= 0.0 AND {ELIGIBLE_SQL}"""
RANKED_SQL = f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(retrieval_score, 12) DESC, memory_id) AS rank
    FROM ({RETRIEVAL_SQL})) WHERE rank <= 10"""


@query("sc_30", f"SELECT query_id, memory_id, ROUND(similarity, 6) AS similarity FROM ({RETRIEVAL_SQL})")
def sc_30(t):
    s = RT.score_candidates(t.memories_v, t.vectors_v, t.query_vectors, as_of())
    return s.select("query_id", "memory_id", r6("similarity").alias("similarity"))


@query("sc_31", f"SELECT memory_id, ROUND({RECENCY_SQL}, 6) AS recency FROM memories_v")
def sc_31(t):
    return t.memories_v.select("memory_id", r6(R.linear_recency(as_of(), F.col("created_at"))).alias("recency"))


EXP_RECENCY_SQL = "COALESCE(EXP(-GREATEST(0, 1706745600 - COALESCE(accessed_s, created_s)) / 86400.0 / 90.0), 0.5)"


@query("sc_32", f"SELECT memory_id, ROUND({EXP_RECENCY_SQL}, 6) AS recency FROM memories_v")
def sc_32(t):
    anchor = F.coalesce("last_accessed", "created_at")
    return t.memories_v.select("memory_id", r6(R.exponential_recency(as_of(), anchor)).alias("recency"))


@query("sc_33", f"SELECT query_id, memory_id, ROUND(retrieval_score, 6) AS retrieval_score FROM ({RETRIEVAL_SQL})")
def sc_33(t):
    s = RT.score_candidates(t.memories_v, t.vectors_v, t.query_vectors, as_of())
    return s.select("query_id", "memory_id", r6("retrieval_score").alias("retrieval_score"))


def ranked(t, k: int = 10):
    return RT.retrieve(t.memories_v, t.vectors_v, t.query_vectors, as_of(), k)


@query("w_01", f"SELECT query_id, memory_id, memory_type, rank, ROUND(retrieval_score, 6) AS retrieval_score FROM ({RANKED_SQL})")
def w_01(t):
    return ranked(t).select("query_id", "memory_id", "memory_type", "rank", r6("retrieval_score").alias("retrieval_score"))


@query("j_01", """SELECT m.memory_id, COALESCE(LEN(v.embedding), 0) AS n_dims FROM memories_v m
    LEFT JOIN vectors_v v ON m.memory_id = v.memory_id""")
def j_01(t):
    from engram.sources.store import attach_vectors
    return attach_vectors(t.memories_v, t.vectors_v).select(
        "memory_id", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("n_dims"))


@query("w_06", f"""
    SELECT query_id, memory_type, memory_id, type_rank FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, memory_type ORDER BY rank) AS type_rank FROM ({RANKED_SQL})) WHERE type_rank <= 3""")
def w_06(t):
    from engram.sources.store import top_per_group
    top = top_per_group(ranked(t), ["query_id", "memory_type"], [F.col("rank")], 3, "type_rank")
    return top.select("query_id", "memory_type", "memory_id", "type_rank")


_C09 = f"""
    WITH RECURSIVE lines AS (SELECT query_id, rank, memory_id, LENGTH('- [' || memory_type || '] ' || COALESCE(summary, content)) // 4 AS cost
        FROM ({RANKED_SQL})),
      fill AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS memory_id, FALSE AS taken
        FROM (SELECT DISTINCT query_id FROM lines)
        UNION ALL SELECT l.query_id, l.rank, CASE WHEN f.used + l.cost <= 600 THEN f.used + l.cost ELSE f.used END, l.memory_id,
          f.used + l.cost <= 600 FROM fill f JOIN lines l ON l.query_id = f.query_id AND l.rank = f.rank + 1)
    SELECT query_id, memory_id FROM fill WHERE taken"""


@query("c_09", _C09)
def c_09(t):
    lines = RT.context_lines(RT.with_text(ranked(t), t.memories_v))
    packed = K.fill_in_order(lines, "query_id", "memory_id", "rank", "tokens", 600)
    return packed.select("query_id", F.explode("kept_ids").alias("memory_id"))


# ---- goals, intents, knowledge ---------------------------------------------
def _score_sql(signals) -> dict[str, str]:
    return {g: "(" + " + ".join(f"CASE WHEN regexp_matches(query, '(?i){p}') THEN {w} ELSE 0.0 END" for p, w in ps) + ")"
            for g, ps in signals.items()}


_G = _score_sql(GOALS)
_GOAL_ROWS = " UNION ALL ".join(f"SELECT query_id, {i} AS i, '{g}' AS goal, {e} AS score FROM queries_v" for i, (g, e) in enumerate(_G.items()))
GOAL_SQL = f"""
    SELECT q.query_id, q.user_id, q.query, COALESCE(g.goal, 'general_assistance') AS goal,
      CASE WHEN g.goal IS NOT NULL THEN GREATEST(0.3, LEAST(1.0, g.score / g.total) * LEAST(1.0, g.score))
        WHEN TRIM(q.query) = '' THEN 0.0 ELSE 0.35 END AS confidence
    FROM queries_v q LEFT JOIN (
      SELECT *, SUM(score) OVER (PARTITION BY query_id) AS total, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS r
      FROM ({_GOAL_ROWS}) WHERE score > 0) g ON g.query_id = q.query_id AND g.r = 1"""


@query("sc_17", f"SELECT query_id, goal, ROUND_EVEN(confidence, 3) AS confidence FROM ({GOAL_SQL})")
def sc_17(t):
    found = U.detect_goals(t.queries_v, GOALS, flags=CASE)
    return found.select("query_id", "goal", F.round("goal_confidence", 3).alias("confidence"))


_I = _score_sql(INTENTS)
_INTENT_ROWS = " UNION ALL ".join(f"SELECT query_id, {i} AS i, '{g}' AS intent, {e} / ({e} + 1.0) AS p FROM queries_v" for i, (g, e) in enumerate(_I.items()))


@query("sc_18", f"""
    SELECT query_id, intent, ROUND(p, 3) AS probability, r AS rank FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(p, 3) DESC, i) AS r FROM ({_INTENT_ROWS}))
    WHERE r = 1 OR (r <= 3 AND p > 0.05)""")
def sc_18(t):
    found = U.classify_intents(t.queries_v, INTENTS, flags=CASE)
    rows = found.select("query_id", F.posexplode("intents").alias("pos", "i"))
    return rows.select("query_id", "i.intent", F.round("i.probability", 3).alias("probability"), (F.col("pos") + 1).alias("rank"))


_REQUIRED = case_sql("goal", {g: ",".join(v) for g, v in KNOWLEDGE.items()}, ",".join(KNOWLEDGE[V.DEFAULT_GOAL]))


@query("sc_19", f"SELECT query_id, {_REQUIRED} AS required FROM ({GOAL_SQL})")
def sc_19(t):
    return understood(t).select("query_id", F.array_join("required_knowledge", ",").alias("required"))


_GAP_ROWS = " UNION ALL ".join(
    f"SELECT query_id, user_id, '{topic}' AS topic, {i * 10 + j} AS pos FROM queries_v WHERE regexp_matches(query, '(?i){p}')"
    for i, (p, topics) in enumerate(GAPS) for j, topic in enumerate(topics))


@query("sc_67", f"""
    WITH topics AS (SELECT query_id, user_id, topic, MIN(pos) AS pos FROM ({_GAP_ROWS}) GROUP BY query_id, user_id, topic),
      found AS (SELECT t.query_id, t.topic, t.pos, COALESCE(BOOL_OR(contains(LOWER(content), topic)), FALSE) AS phrase,
          COALESCE(BOOL_OR(contains(LOWER(content), STRING_SPLIT(topic, ' ')[1])), FALSE) AS w1,
          COALESCE(BOOL_OR(contains(LOWER(content), STRING_SPLIT(topic, ' ')[2])), FALSE) AS w2
        FROM topics t LEFT JOIN memories_v m ON m.user_id = t.user_id GROUP BY t.query_id, t.topic, t.pos),
      judged AS (SELECT query_id, topic, pos, phrase OR CASE WHEN contains(topic, ' ') THEN w1 AND w2 WHEN LENGTH(topic) > 3 THEN w1 ELSE FALSE END AS covered FROM found),
      missing AS (SELECT query_id, UPPER(SUBSTR(topic, 1, 1)) || SUBSTR(topic, 2) AS topic, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM judged WHERE NOT covered)
    SELECT q.query_id, COALESCE(STRING_AGG(REPLACE(REPLACE(topic, ' w', ' W'), ' x', ' X'), ',' ORDER BY r), '') AS missing
    FROM queries_v q LEFT JOIN missing m ON m.query_id = q.query_id AND r <= 5 GROUP BY q.query_id""")
def sc_67(t):
    rows = t.queries_v.select("query_id", "user_id").join(t.memories_v.select("user_id", F.col("content").alias("text")), "user_id")
    gaps = U.knowledge_gaps(t.queries_v, rows, GAPS, flags=CASE)
    return gaps.select("query_id", F.array_join("missing_topics", ",").alias("missing"))


# ---- utility ----------------------------------------------------------------
POOL_SQL = f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY importance_score DESC, memory_id) AS pool_rank
    FROM memories_v WHERE {ELIGIBLE_SQL}) WHERE pool_rank <= 200"""
_KW = f"SELECT query_id, LIST(w) AS kws FROM ({KEYWORDS_SQL}) GROUP BY query_id"
_TRAITS = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY importance DESC, node_id) AS r FROM traits_v WHERE confidence >= 0.3) WHERE r <= 30"""
_CONCEPTS = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY confidence DESC, concept_id) AS r FROM concepts_v) WHERE r <= 50"""
_IDENTITY = f"""SELECT p.memory_id, COUNT(t.node_id) AS n, SUM(CASE WHEN contains(LOWER(p.content), t.node_value) THEN t.confidence ELSE 0.0 END) / NULLIF(SUM(t.confidence), 0) AS share
    FROM ({POOL_SQL}) p LEFT JOIN ({_TRAITS}) t ON t.user_id = p.user_id GROUP BY p.memory_id"""
_CONCEPT = f"""SELECT p.memory_id, COUNT(c.concept_id) AS n, SUM(CASE WHEN contains(LOWER(p.content), c.concept_name)
      OR LEN(LIST_FILTER(STRING_SPLIT(c.concept_name, ' '), w -> LENGTH(w) > 3 AND contains(LOWER(p.content), w))) > 0 THEN c.confidence ELSE 0.0 END) / NULLIF(SUM(c.confidence), 0) AS share
    FROM ({POOL_SQL}) p LEFT JOIN ({_CONCEPTS}) c ON c.user_id = p.user_id GROUP BY p.memory_id"""
_GOAL_ALIGN = clamp_sql("""COALESCE(LEN(LIST_FILTER(k.kws, w -> contains(LOWER(p.content), w))) / LEN(k.kws), 0.0) * 0.6
    + LEN(LIST_FILTER(STRING_SPLIT(g.required, ','), c -> contains(LOWER(p.content), REPLACE(c, '_', ' ')) OR LEN(LIST_FILTER(STRING_SPLIT(c, '_'), w -> contains(LOWER(p.content), w))) > 0))
      / LEN(STRING_SPLIT(g.required, ',')) * 0.4 + CASE WHEN p.memory_type = 'procedural' THEN 0.15 ELSE 0.0 END""")
_ID_ALIGN = f"CASE WHEN i.n = 0 THEN CASE WHEN p.memory_type = 'identity' THEN 0.5 ELSE 0.3 END ELSE {clamp_sql('COALESCE(i.share, 0.0) + CASE WHEN p.memory_type = ' + repr('identity') + ' THEN 0.2 ELSE 0.0 END')} END"
_CON_ALIGN = f"CASE WHEN c.n = 0 THEN CASE WHEN p.memory_type = 'concept' THEN 0.4 ELSE 0.2 END ELSE {clamp_sql('COALESCE(c.share, 0.0) + CASE WHEN p.memory_type = ' + repr('concept') + ' THEN 0.15 ELSE 0.0 END')} END"
_STABLE = clamp_sql("(COALESCE(p.memory_strength, 0.5) + (1.0 - LEAST(1.0, p.decay_rate * 5))) / 2")
_BLEND = clamp_sql("(COALESCE(p.reinforcement_score, 0.5) + COALESCE(p.memory_strength, 0.5)) / 2")
_MULT = f"(0.85 + 0.15 * {case_sql('p.memory_type', V.TYPE_PRIORITY, 0.6)})"
DIMS_SQL = f"""
    SELECT g.query_id, p.*, {_GOAL_ALIGN} AS goal_alignment, {_ID_ALIGN} AS identity_alignment, {_CON_ALIGN} AS concept_relevance,
      CASE WHEN p.importance_score <> 0 THEN p.importance_score ELSE 0.5 END AS importance, {_BLEND} AS reinforcement, {_STABLE} AS confidence,
      {EXP_RECENCY_SQL} AS recency, {_MULT} AS mult
    FROM ({POOL_SQL}) p JOIN (SELECT *, {_REQUIRED} AS required FROM ({GOAL_SQL})) g ON g.user_id = p.user_id
      LEFT JOIN ({_KW}) k ON k.query_id = g.query_id JOIN ({_IDENTITY}) i ON i.memory_id = p.memory_id JOIN ({_CONCEPT}) c ON c.memory_id = p.memory_id"""
UTILITY_SQL = f"SELECT *, {clamp_sql('(' + ' + '.join(f'{n} * {w}' for n, w in V.UTILITY_WEIGHTS.items()) + ') * mult')} AS utility FROM ({DIMS_SQL})"


def useful(t, weights=V.UTILITY_WEIGHTS):
    return UT.score_utility(UT.candidate_pool(t.memories_v), understood(t), t.traits_v, t.concepts_v, as_of(), weights)


def _dim_query(key: str, name: str, sql: str) -> None:
    @query(key, f"SELECT query_id, memory_id, ROUND({sql}, 6) AS {name} FROM ({UTILITY_SQL})")
    def run(t):
        return useful(t).select("query_id", "memory_id", r6(name).alias(name))


_dim_query("sc_34", "goal_alignment", "goal_alignment")
_dim_query("sc_35", "identity_alignment", "identity_alignment")
_dim_query("sc_36", "concept_relevance", "concept_relevance")


@query("sc_37", f"SELECT memory_id, ROUND({_BLEND.replace('p.', '')}, 6) AS reinforcement, ROUND({_STABLE.replace('p.', '')}, 6) AS confidence FROM memories_v")
def sc_37(t):
    return t.memories_v.select(
        "memory_id", r6(R.reinforcement_blend(F.col("reinforcement_score"), F.col("memory_strength"))).alias("reinforcement"),
        r6(R.stability(F.col("memory_strength"), F.col("decay_rate"))).alias("confidence"))


@query("sc_38", f"SELECT memory_id, ROUND({_MULT.replace('p.', '')}, 6) AS multiplier FROM memories_v")
def sc_38(t):
    return t.memories_v.select("memory_id", r6(R.type_multiplier(F.col("memory_type"))).alias("multiplier"))


@query("sc_39", f"SELECT query_id, memory_id, ROUND(utility, 6) AS utility_score FROM ({UTILITY_SQL})")
def sc_39(t):
    return useful(t).select("query_id", "memory_id", r6("utility_score").alias("utility_score"))


@query("sc_40")
def sc_40(t):
    return useful(t).select("query_id", "memory_id", "selection_reason")


@query("j_09", f"SELECT q.query_id, p.memory_id FROM ({POOL_SQL}) p JOIN queries_v q ON q.user_id = p.user_id")
def j_09(t):
    return UT.candidate_pool(t.memories_v).join(t.queries_v, "user_id").select("query_id", "memory_id")


@query("flt_05", f"SELECT query_id, memory_id FROM ({UTILITY_SQL}) WHERE ROUND(utility, 9) >= 0.35")
def flt_05(t):
    return useful(t).filter(F.round("utility_score", 9) >= 0.35).select("query_id", "memory_id")


@query("w_03", f"SELECT user_id, memory_id, pool_rank FROM ({POOL_SQL})")
def w_03(t):
    return UT.candidate_pool(t.memories_v).select("user_id", "memory_id", "pool_rank")


@query("w_04", f"""SELECT query_id, memory_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(utility, 9) DESC, memory_id) AS retrieval_rank
    FROM ({UTILITY_SQL})""")
def w_04(t):
    from engram.plans.recall import rank_selected
    return rank_selected(useful(t)).select("query_id", "memory_id", "retrieval_rank")


@query("w_07", f"""SELECT user_id, STRING_AGG(node_value, ',' ORDER BY r) AS traits FROM ({_TRAITS}) GROUP BY user_id""")
def w_07(t):
    return UT.user_traits(t.traits_v).select("user_id", F.array_join(F.transform("traits", lambda x: x["value"]), ",").alias("traits"))


@query("w_13", f"""SELECT query_id, memory_type, STRING_AGG(CAST(memory_id AS VARCHAR), ',' ORDER BY ROUND(utility, 9) DESC, memory_id) AS ids
    FROM ({UTILITY_SQL}) GROUP BY query_id, memory_type""")
def w_13(t):
    from engram.plans.recall import section_items
    rows = section_items(useful(t).withColumn("item", F.col("memory_id").cast("string")))
    return rows.select("query_id", "memory_type", F.array_join("items", ",").alias("ids"))


@query("udf_04", f"""SELECT query_id, memory_id, ROUND({clamp_sql('(goal_alignment * 0.6 + importance * 0.4) * mult')}, 6) AS utility_score FROM ({UTILITY_SQL})""")
def udf_04(t):
    weights = {**dict.fromkeys(V.UTILITY_WEIGHTS, 0.0), "goal_alignment": 0.6, "importance": 0.4}
    return useful(t, weights).select("query_id", "memory_id", r6("utility_score").alias("utility_score"))


# ---- packing ----------------------------------------------------------------
def costed(t):
    return useful(t).withColumn("token_cost", T.budget_tokens(F.coalesce("summary", "content")))


def near_copies(t):
    pool = UT.candidate_pool(t.memories_v).withColumn("_w", T.word_set(F.col("content")))
    return PR.word_pairs(pool, ["user_id"], "memory_id", "_w", V.DEDUP_AT, "jaccard")


@query("c_03")
def c_03(t):
    return K.drop_near_copies(useful(t), near_copies(t), ["query_id"], "memory_id", "utility_score").select("query_id", "memory_id")


@query("c_07")
def c_07(t):
    return K.optimize_budget(costed(t), "query_id", "memory_id", 1000).select(
        "query_id", "memory_id", "token_cost", r6("utility_score").alias("utility_score"))


_C08 = f"""
    WITH RECURSIVE costed AS (SELECT query_id, memory_id, cost, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(-utility / cost, 15), memory_id) AS r
        FROM (SELECT *, GREATEST(1, LENGTH(COALESCE(summary, content)) // 4) AS cost FROM ({UTILITY_SQL}))),
      fill AS (SELECT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS memory_id, FALSE AS taken
        FROM (SELECT DISTINCT query_id FROM costed)
        UNION ALL SELECT l.query_id, l.r, CASE WHEN f.used + l.cost <= 1000 THEN f.used + l.cost ELSE f.used END, l.memory_id,
          f.used + l.cost <= 1000 FROM fill f JOIN costed l ON l.query_id = f.query_id AND l.r = f.r + 1)
    SELECT query_id, memory_id FROM fill WHERE taken"""


@query("c_08", _C08)
def c_08(t):
    return K.fill_by_ratio(costed(t), "query_id", "memory_id", "utility_score", "token_cost", 1000).select("query_id", "memory_id")
