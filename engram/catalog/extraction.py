"""Extraction, pair and cluster queries (EX-*, J-03 … J-08, C-*, A-09 … A-13, A-19 … A-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import vocab as V
from engram.catalog.lifecycles import FLT02_SQL
from engram.catalog.registry import query, r6
from engram.catalog.texts import BUCKETS, GROUPS, _STOP
from engram.catalog.views import as_of
from engram.functions import text as T
from engram.operators import analytics as A
from engram.operators import clusters as C
from engram.operators import eligibility as E
from engram.operators import entropy as N
from engram.operators import extract as X
from engram.operators import pairs as PR
from engram.operators.density import density_clusters

VOCABULARY = {"technology": {"ring": "Ring", "hand": "Hand", "ringer": "Ring"}, "service": {"eaux": "Eaux"}}
RULES = [("project", r"([A-Z][a-z]{3,30}) the[ .,]", 0.75), ("task", r"[ .](?:is|of) ([a-z]{3,20})[.,]", 0.5)]
VERBS = [("uses", [r"[ .]and[ .]"]), ("stores", [r"[ .]of[ .]", r"[ .]for[ .]"])]


def texts(t):
    return t.memories_v.select("user_id", F.col("memory_id").alias("text_id"), F.col("created_at").alias("ts"), F.col("content").alias("text"))


TEXTS = "SELECT user_id, memory_id AS text_id, created_s AS ts, content AS text FROM memories_v"
_VOC = " UNION ALL ".join(f"SELECT user_id, text_id, ts, '{k}' AS entity_type, '{n}' AS name, 0.8 AS confidence, {i} AS pos FROM ({TEXTS}) WHERE contains(LOWER(text), '{w}')"
                          for i, (k, w, n) in enumerate((k, w, n) for k, ws in VOCABULARY.items() for w, n in ws.items()))
_KNOWN = f"SELECT user_id, text_id, ts, entity_type, LOWER(name) AS key, MIN(name) AS name, MIN(confidence) AS confidence FROM ({_VOC}) GROUP BY ALL"
_BY_RULE = " UNION ALL ".join(f"""SELECT user_id, text_id, ts, '{k}' AS entity_type, REGEXP_REPLACE(TRIM(m), '[.,;:]+$', '') AS name, {c} AS confidence, {(1 << 40) * (i + 1)} + j AS pos
    FROM (SELECT user_id, text_id, ts, UNNEST(ms) AS m, UNNEST(RANGE(1, LEN(ms) + 1)) AS j FROM (SELECT *, REGEXP_EXTRACT_ALL(text, '{p}', 1) AS ms FROM ({TEXTS})))""" for i, (k, p, c) in enumerate(RULES))
MENTIONS = f"""SELECT * FROM ({_KNOWN}) UNION ALL SELECT user_id, text_id, ts, entity_type, key, name, confidence FROM (
    SELECT user_id, text_id, ts, entity_type, LOWER(name) AS key, ARG_MIN(name, pos) AS name, ARG_MIN(confidence, pos) AS confidence FROM ({_BY_RULE}) WHERE LENGTH(name) >= 2 GROUP BY user_id, text_id, ts, entity_type, LOWER(name)) r
    WHERE NOT EXISTS (SELECT 1 FROM ({_KNOWN}) k WHERE k.text_id = r.text_id AND k.key = r.key)"""


def mentions(t):
    return X.entities(texts(t), VOCABULARY, RULES, flags="")


@query("ex_01", f"SELECT text_id, entity_type, name FROM ({_KNOWN})")
def ex_01(t):
    return X.vocabulary_entities(texts(t), VOCABULARY).select("text_id", "entity_type", "name")


@query("ex_02", f"SELECT text_id, entity_type, name, ROUND(confidence, 6) AS confidence FROM ({MENTIONS})")
def ex_02(t):
    return mentions(t).select("text_id", "entity_type", "name", r6("confidence").alias("confidence"))


@query("ex_03", f"""SELECT user_id, entity_type, key, ARG_MIN(name, ts * 1000000 + text_id) AS name, ROUND(LEAST(1.0, ARG_MIN(confidence, ts * 1000000 + text_id) + 0.05 * (COUNT(*) - 1)), 6) AS confidence,
    COUNT(*) AS mention_count FROM ({MENTIONS}) GROUP BY user_id, entity_type, key""")
def ex_03(t):
    df = X.entity_rollup(mentions(t))
    return df.select("user_id", "entity_type", "key", "name", r6("confidence").alias("confidence"), "mention_count")


_AT = f"SELECT m.*, LOWER(x.text) AS low, STRPOS(LOWER(x.text), m.key) AS pos FROM ({MENTIONS}) m JOIN ({TEXTS}) x ON x.text_id = m.text_id"
_BETWEEN = "SUBSTR(a.low, a.pos, b.pos - a.pos)"
_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches({_BETWEEN}, {p!r})' for p in ps)} THEN '{k}'" for k, ps in VERBS) + \
    f" WHEN NOT contains({_BETWEEN}, '.') AND NOT contains({_BETWEEN}, CHR(10)) THEN 'related_to' END"
RELATIONS = f"""SELECT * FROM (SELECT a.user_id, a.text_id, a.ts, a.entity_type AS src_type, a.key AS src, b.entity_type AS dst_type, b.key AS dst, {_TYPE} AS type
    FROM spots a JOIN spots b ON b.text_id = a.text_id AND a.pos < b.pos WHERE a.pos > 0) WHERE type IS NOT NULL"""


def found_relations(t):
    return X.relations(texts(t), mentions(t), VERBS, flags="")


@query("ex_04", f"WITH spots AS MATERIALIZED ({_AT}) SELECT text_id, src_type, src, dst_type, dst, type FROM ({RELATIONS})")
def ex_04(t):
    return found_relations(t).select("text_id", "src_type", "src", "dst_type", "dst", "type")


@query("ex_05", f"""WITH spots AS MATERIALIZED ({_AT}) SELECT user_id, src, dst, src_type, dst_type, type, COUNT(*) AS evidence_count,
    ROUND(LEAST(1.0, CASE WHEN type = 'related_to' THEN 0.4 ELSE 0.7 END + 0.05 * (COUNT(*) - 1)), 6) AS strength FROM ({RELATIONS}) GROUP BY user_id, src, dst, src_type, dst_type, type""")
def ex_05(t):
    df = X.relation_rollup(found_relations(t))
    return df.select("user_id", "src", "dst", "src_type", "dst_type", "type", "evidence_count", r6("strength").alias("strength"))


PROJECT = {"phase": r" (?:the|to) ([a-z]{3,20})[.,]", "next_step": r" (?:and|with) ([a-z]{3,20})[.,]",
           "status": [("paused", ["[ .]by[ .]"]), ("completed", ["[ .]was[ .]"])]}


@query("ex_06", f"""
    WITH said AS MATERIALIZED (SELECT text_id, NULLIF(TRIM(REGEXP_EXTRACT(text, '{PROJECT['phase']}', 1)), '') AS phase, NULLIF(TRIM(REGEXP_EXTRACT(text, '{PROJECT['next_step']}', 1)), '') AS step,
        CASE WHEN regexp_matches(LOWER(text), '[ .]by[ .]') THEN 'paused' WHEN regexp_matches(LOWER(text), '[ .]was[ .]') THEN 'completed' END AS status FROM ({TEXTS})),
      p AS MATERIALIZED (SELECT m.*, s.phase, s.step, s.status, m.ts * 1000000 + m.text_id AS o FROM ({MENTIONS}) m JOIN said s ON s.text_id = m.text_id WHERE m.entity_type = 'project')
    SELECT user_id, key, ARG_MAX(phase, o) FILTER (WHERE phase IS NOT NULL) AS current_phase, ARG_MAX(step, o) FILTER (WHERE step IS NOT NULL) AS next_step,
      COALESCE(ARG_MAX(status, o) FILTER (WHERE status IS NOT NULL), 'active') AS status FROM p GROUP BY user_id, key""")
def ex_06(t):
    return X.projects(texts(t), mentions(t), **PROJECT).select("user_id", "key", "current_phase", "next_step", "status")


DECISIONS = [("decided", r" (?:is|to) ([a-z]{4,20}) "), ("chosen", r" (?:and|or) ([a-z]{4,20})[.,]")]
_REASON = r"(?i) (?:for|by) ([a-z]{3,20})[.,]"
_DEC = " UNION ALL ".join(f"""SELECT user_id, text_id, text, '{s}' AS status, REGEXP_REPLACE(TRIM(m), '[.,;:]+$', '') AS decision, {(1 << 40) * i} + j AS pos
    FROM (SELECT user_id, text_id, text, UNNEST(ms) AS m, UNNEST(RANGE(1, LEN(ms) + 1)) AS j FROM (SELECT *, REGEXP_EXTRACT_ALL(text, '(?i){p}', 1) AS ms FROM ({TEXTS})))""" for i, (s, p) in enumerate(DECISIONS))


@query("ex_07", f"""SELECT user_id, text_id, NULLIF(TRIM(REGEXP_EXTRACT(text, '{_REASON}', 1)), '') AS reason, ARG_MIN(decision, pos) AS decision, ARG_MIN(status, pos) AS status
    FROM ({_DEC}) WHERE decision <> '' GROUP BY user_id, text_id, text, LOWER(decision)""")
def ex_07(t):
    return X.decisions(texts(t), DECISIONS, _REASON).select("user_id", "text_id", "reason", "decision", "status")


PATTERNS = [("the", ["ring", "hand", "zzz"], 2), ("builder", ["thin", "eaux", "sher", "qqq"], 3), ("reader", ["xyzzy", "hand"], 1)]
_KW = {w: f"BOOL_OR(contains(x, '{w}'))" for _, ws, _ in PATTERNS for w in ws}
_PAT = " UNION ALL ".join(
    f"SELECT user_id, '{trait}' AS node_value, n, LEAST(1.0, n / {len(ws)} + 0.2) AS confidence FROM (SELECT user_id, {' + '.join(f'CAST({_KW[w]} AS INT)' for w in ws)} AS n FROM rows GROUP BY user_id) WHERE n >= {need}"
    for trait, ws, need in PATTERNS)
_EX08 = f"""WITH rows AS MATERIALIZED (SELECT user_id, LOWER(content) AS x FROM memories_v WHERE cognitive_state NOT IN ('archived', 'forgotten')
      UNION ALL SELECT user_id, LOWER(concept_name || ' ' || description) FROM concepts_v),
    found AS (SELECT * FROM ({_PAT}) p WHERE confidence >= 0.55 AND NOT EXISTS (SELECT 1 FROM traits_v t WHERE t.user_id = p.user_id AND t.node_value = p.node_value))"""


def discovered(t):
    return X.discover_patterns(t.memories_v, t.concepts_v, t.traits_v, PATTERNS)


@query("ex_08", _EX08 + " SELECT user_id, node_value, n AS n_matched, ROUND(confidence, 6) AS confidence FROM found")
def ex_08(t):
    return discovered(t).select("user_id", "node_value", F.size("matched_keywords").alias("n_matched"), r6("confidence").alias("confidence"))


@query("j_18")
def j_18(t):
    return X.supporting_concepts(discovered(t), t.concepts_v)


# The driver vectors are nearly orthogonal, so their queries ask for a lower similarity.
LOW_SIMILARITY = 0.25


# ---- pairs -----------------------------------------------------------------------
_PAIRS = """SELECT a.user_id, a.memory_id AS id_a, b.memory_id AS id_b, LIST_COSINE_SIMILARITY(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
    FROM vectors_v a JOIN vectors_v b ON b.user_id = a.user_id AND a.memory_id < b.memory_id"""


@query("j_03", f"SELECT user_id, id_a, id_b, ROUND(score, 6) AS score FROM ({_PAIRS}) WHERE score >= 0.25")
def j_03(t):
    return PR.vector_pairs(t.vectors_v, ["user_id"], "memory_id", LOW_SIMILARITY).select("user_id", "id_a", "id_b", r6("score").alias("score"))


@query("j_04", f"SELECT user_id, id_a AS src, id_b AS dst, 'related_to' AS type, ROUND(score, 6) AS strength FROM ({_PAIRS}) WHERE score > 0.25")
def j_04(t):
    from engram.plans.consolidation import concept_edges
    vectors = t.vectors_v.withColumnRenamed("memory_id", "concept_id")
    return concept_edges(vectors, LOW_SIMILARITY).select("user_id", "src", "dst", "type", r6("strength").alias("strength"))


_SETS = rf"SELECT user_id, memory_id, memory_type, content, LIST_FILTER(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(content), '[\p{{L}}\p{{N}}_]+')), w -> NOT LIST_CONTAINS({_STOP}, w)) AS ws FROM memories_v"
_WORD_PAIRS = """SELECT a.user_id, a.memory_id AS id_a, b.memory_id AS id_b, LEN(a.ws) AS n_a, LEN(b.ws) AS n_b, LEN(LIST_INTERSECT(a.ws, b.ws)) AS shared
    FROM sets a JOIN sets b ON b.user_id = a.user_id AND a.memory_id < b.memory_id WHERE LEN(a.ws) > 0 AND LEN(b.ws) > 0"""


def content_sets(t):
    return t.memories_v.withColumn("_w", T.word_set(F.col("content"), V.STOPWORDS))


@query("j_05", f"""WITH sets AS MATERIALIZED ({_SETS}) SELECT user_id, id_a, id_b, shared, ROUND(shared / LEAST(n_a, n_b), 6) AS score FROM ({_WORD_PAIRS}) WHERE shared / LEAST(n_a, n_b) >= 0.4""")
def j_05(t):
    rows = PR.word_pairs(content_sets(t), ["user_id"], "memory_id", "_w", V.DUPLICATE_AT, "overlap")
    return rows.select("user_id", "id_a", "id_b", "shared", r6("score").alias("score"))


@query("j_05_jaccard", f"""WITH sets AS MATERIALIZED ({_SETS}) SELECT user_id, id_a, id_b, shared, ROUND(shared / (n_a + n_b - shared), 6) AS score FROM ({_WORD_PAIRS}) WHERE shared / (n_a + n_b - shared) >= 0.5""")
def j_05_jaccard(t):
    rows = PR.word_pairs(content_sets(t), ["user_id"], "memory_id", "_w", 0.5, "jaccard")
    return rows.select("user_id", "id_a", "id_b", "shared", r6("score").alias("score"))


_STANCE = T.stance_pattern(BUCKETS)
_CONFLICT = f"""SELECT * FROM ({_WORD_PAIRS.replace('FROM sets a JOIN sets b', 'FROM stances a JOIN stances b')}) WHERE shared >= 2 AND n_a > shared AND n_b > shared AND shared / LEAST(n_a, n_b) >= 0.5"""
_STANCES = f"""sets AS MATERIALIZED ({_SETS}), stances AS MATERIALIZED (SELECT * FROM sets WHERE memory_type IN ('identity', 'semantic', 'procedural') AND regexp_matches(LOWER(content), '{_STANCE}'))"""


@query("j_06", f"WITH {_STANCES} SELECT user_id, id_a, id_b, shared FROM ({_CONFLICT})")
def j_06(t):
    return PR.contradictory_pairs(t.memories_v, BUCKETS).select("user_id", "id_a", "id_b", "shared")


@query("j_07")
def j_07(t):
    from engram.plans.evolution import conflict_losers
    return conflict_losers(t.memories_v, as_of(), BUCKETS).select("loser", "winner", r6("gap").alias("gap"))


_FLAGS = {g: f"({' OR '.join(f'contains(LOWER({{c}}), {w!r})' for w in ws)})" for g, ws in GROUPS.items()}
_J08 = " + ".join(f"CAST({e.format(c='m.content')} AND n.g{i} AS INT)" for i, e in enumerate(_FLAGS.values()))


@query("j_08", f"""SELECT user_id, memory_id, n_groups, ROUND(n_groups * 0.05, 6) AS strength_gain FROM (SELECT m.user_id, m.memory_id, {_J08} AS n_groups FROM memories_v m JOIN
    (SELECT user_id, {', '.join(f"BOOL_OR({e.format(c='text')}) AS g{i}" for i, e in enumerate(_FLAGS.values()))} FROM turns_v WHERE role = 'user' GROUP BY user_id) n ON n.user_id = m.user_id) WHERE n_groups > 0""")
def j_08(t):
    rows = PR.shared_group_matches(t.turns_v.filter("role = 'user'"), t.memories_v, GROUPS)
    return rows.select("user_id", "memory_id", "n_groups", r6("strength_gain").alias("strength_gain"))


@query("a_30", f"""SELECT user_id, {', '.join(f"BOOL_OR({e.format(c='content')}) AS has_{g}" for g, e in _FLAGS.items())} FROM memories_v GROUP BY user_id""")
def a_30(t):
    low = F.lower("content")
    return t.memories_v.groupBy("user_id").agg(*[F.max(T.contains_any(low, ws)).alias(f"has_{g}") for g, ws in GROUPS.items()])


# ---- clusters ----------------------------------------------------------------------
@query("c_01")
def c_01(t):
    return density_clusters(t.vectors_v, ["user_id"], "memory_id", LOW_SIMILARITY).select("user_id", "memory_id", "cluster_id")


def planted(t):
    """Members under their planted label: groups of a known size for the roll-ups."""
    return t.vectors_v.select("user_id", "memory_id", (F.col("user_id") * 100 + F.col("label")).alias("cluster_id"))


_PLANTED = "SELECT user_id, memory_id, embedding, user_id * 100 + label AS cluster_id FROM vectors_v"


@query("a_20", f"""
    WITH p AS MATERIALIZED ({_PLANTED}), n AS (SELECT user_id, cluster_id, COUNT(*) AS n FROM p GROUP BY ALL),
      s AS (SELECT a.user_id, a.cluster_id, AVG(LIST_COSINE_SIMILARITY(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM p a JOIN p b ON b.cluster_id = a.cluster_id AND b.user_id = a.user_id AND a.memory_id < b.memory_id GROUP BY ALL)
    SELECT n.user_id, n.cluster_id, n AS member_count, ROUND(GREATEST(0.0, COALESCE(s, 0.0)), 6) AS avg_similarity FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.cluster_id = n.cluster_id""")
def a_20(t):
    return C.cluster_metrics(planted(t), t.vectors_v).select("user_id", "cluster_id", "member_count", r6("avg_similarity").alias("avg_similarity"))


def leader_sql(rows: str, threshold: float, apart: bool, keys: str, name: str) -> str:
    """Rows one after the other with the groups so far as state. ``rows``: keys, id, ws; words are compared by their hashes."""
    clash = f"""AND NOT list_bool_or(list_transform(groups[i].ms, m -> LEN(LIST_INTERSECT(m, r.ws)) >= 2 AND LEN(LIST_INTERSECT(m, r.ws)) < LEN(m) AND LEN(LIST_INTERSECT(m, r.ws)) < LEN(r.ws)
          AND LEN(LIST_INTERSECT(m, r.ws)) / LEAST(LEN(m), LEN(r.ws)) >= 0.5))""" if apart else ""
    same = " AND ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    members = "list_append(g.ms, ws)" if apart else "g.ms"
    return f"""
    WITH RECURSIVE rows AS MATERIALIZED (SELECT {keys}, id, list_distinct(list_transform(ws, w -> hash(w))) AS ws, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS pos FROM ({rows})),
    st AS (SELECT {keys}, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS home, CAST([] AS STRUCT(leader BIGINT, ws UBIGINT[], ms UBIGINT[][])[]) AS groups FROM rows GROUP BY ALL
      UNION ALL
      SELECT {keys}, pos, id, COALESCE(groups[hit].leader, id), CASE WHEN hit IS NULL THEN list_append(groups, {{'leader': id, 'ws': ws, 'ms': [ws]}})
        ELSE list_transform(groups, lambda g, i: CASE WHEN i = hit THEN {{'leader': g.leader, 'ws': list_distinct(list_concat(g.ws, ws)), 'ms': {members}}} ELSE g END) END
      FROM (SELECT {cols}, r.pos, CAST(r.id AS BIGINT) AS id, r.ws, groups,
              list_filter(range(1, len(groups) + 1), i -> LEN(r.ws) > 0 AND LEN(groups[i].ws) > 0 AND LEN(LIST_INTERSECT(groups[i].ws, r.ws)) / LEAST(LEN(groups[i].ws), LEN(r.ws)) >= {threshold} {clash})[1] AS hit
            FROM st s JOIN rows r ON {same} AND r.pos = s.pos + 1)),
    placed AS MATERIALIZED (SELECT {keys}, id AS {name}, home AS cluster_id FROM st WHERE pos > 0)
    SELECT {keys}, {name}, cluster_id FROM placed WHERE (cluster_id, {keys}) IN (SELECT (cluster_id, {keys}) FROM placed GROUP BY ALL HAVING COUNT(*) >= 2)"""


@query("c_02", f"""
    WITH RECURSIVE p AS MATERIALIZED ({_PLANTED}),
    dims AS (SELECT user_id, cluster_id, UNNEST(RANGE(1, 65)) AS i, UNNEST(CAST(embedding AS DOUBLE[])) AS x FROM p),
    cent AS MATERIALIZED (SELECT user_id, cluster_id, LIST(m ORDER BY i) AS c FROM (SELECT user_id, cluster_id, i, AVG(x) AS m FROM dims GROUP BY ALL) GROUP BY ALL),
    near AS MATERIALIZED (SELECT b.user_id, b.cluster_id, row_number() OVER (PARTITION BY b.user_id ORDER BY b.cluster_id) AS pos,
        (SELECT LIST(a.cluster_id) FROM cent a WHERE a.user_id = b.user_id AND a.cluster_id < b.cluster_id AND LIST_COSINE_SIMILARITY(a.c, b.c) >= 0.5) AS ns FROM cent b),
    st AS (SELECT user_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS cluster_id, CAST(NULL AS BIGINT) AS into_id, CAST([] AS BIGINT[]) AS led FROM near GROUP BY ALL
      UNION ALL SELECT user_id, pos, cluster_id, COALESCE(hit, cluster_id), CASE WHEN hit IS NULL THEN list_append(led, cluster_id) ELSE led END
        FROM (SELECT s.user_id, n.pos, n.cluster_id, led, list_filter(led, l -> list_contains(COALESCE(n.ns, []), l))[1] AS hit FROM st s JOIN near n ON n.user_id = s.user_id AND n.pos = s.pos + 1))
    SELECT p.user_id, memory_id, into_id AS cluster_id FROM p JOIN st ON st.user_id = p.user_id AND st.cluster_id = p.cluster_id""")
def c_02(t):
    metrics = C.cluster_metrics(planted(t), t.vectors_v)
    return C.merge_similar_clusters(metrics, planted(t), threshold=0.5)[0].select("user_id", "memory_id", "cluster_id")


_WORDS = rf"LIST_FILTER(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER({{c}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+')), w -> NOT LIST_CONTAINS({_STOP}, w))"


@query("c_04", leader_sql(f"SELECT user_id, memory_id AS id, {_WORDS.format(c='content')} AS ws FROM memories_v WHERE memory_type IN ({', '.join(repr(x) for x in V.DUPLICATE_TYPES)})", 0.4, True, "user_id", "memory_id"))
def c_04(t):
    return C.duplicate_clusters(t.memories_v).select("user_id", "memory_id", "cluster_id")


@query("c_05")
def c_05(t):
    from engram.plans.compose import merge_for_context
    from engram.plans.recall import rank_selected
    from engram.catalog.relevance import useful
    merged = merge_for_context(rank_selected(useful(t).drop("content", "summary")), t.memories_v)
    return merged.select("query_id", F.col("id").alias("memory_id"), "n_sources", "merged")


_CONCEPT_TEXT = "REPLACE(COALESCE(concept_name, ''), '_', ' ') || ' ' || COALESCE(description, '')"


@query("c_06", leader_sql(f"SELECT user_id, concept_id AS id, {_WORDS.format(c=_CONCEPT_TEXT)} AS ws FROM concepts_v WHERE NOT COALESCE(retired, false)", 0.4, False, "user_id", "concept_id"))
def c_06(t):
    return C.concept_clusters(t.concepts_v).select("user_id", "concept_id", "cluster_id")


_TRAIT_TEXT = "REPLACE(node_value, '_', ' ')"


@query("c_06_traits", leader_sql(f"SELECT user_id, node_type, node_id AS id, {_WORDS.format(c=_TRAIT_TEXT)} AS ws FROM traits_v WHERE NOT COALESCE(retired, false)", 0.5, False, "user_id, node_type", "node_id"))
def c_06_traits(t):
    return C.trait_clusters(t.traits_v).select("user_id", "node_type", "node_id", "cluster_id")


def groups(t):
    return planted(t).select("memory_id", F.col("cluster_id").alias("component"))


@query("a_19", f"""
    SELECT p.cluster_id AS component, ARG_MIN(m.memory_id, -importance_score * 1000000000 + m.memory_id) AS memory_id, ROUND(MAX(importance_score), 6) AS importance_score,
      ROUND(AVG(future_utility_score), 6) AS future_utility_score, ROUND(AVG(reinforcement_score), 6) AS reinforcement_score, COUNT(*) AS n_merged FROM memories_v m JOIN ({_PLANTED}) p ON p.memory_id = m.memory_id GROUP BY p.cluster_id""")
def a_19(t):
    df = C.merge_groups(t.memories_v, groups(t))
    return df.select("component", "memory_id", r6("importance_score").alias("importance_score"), r6("future_utility_score").alias("future_utility_score"),
                     r6("reinforcement_score").alias("reinforcement_score"), "n_merged")


@query("a_21")
def a_21(t):
    _, made, _, _ = C.merge_duplicates(t.memories_v, C.duplicate_clusters(t.memories_v), as_of(), t.concepts_v)
    return made.select("user_id", "concept_name", r6("confidence").alias("confidence"), "support_count")


@query("a_22", """SELECT concept_id, ROUND(CASE WHEN NOT retired AND support_count >= 3 AND confidence < 0.95 THEN LEAST(1.0, CASE WHEN confidence <> 0 THEN confidence ELSE 0.5 END + 0.03) ELSE confidence END, 6) AS confidence FROM concepts_v""")
def a_22(t):
    return C.strengthen_concepts(t.concepts_v, as_of()).select("concept_id", r6("confidence").alias("confidence"))


@query("a_22_retire", """SELECT concept_id, retired OR (confidence <= 0.15 AND COALESCE(reinforced_s, created_s) <= 1706745600 - 90 * 86400) AS retired FROM concepts_v""")
def a_22_retire(t):
    return C.retire_concepts(t.concepts_v, as_of()).select("concept_id", "retired")


@query("a_22_merge")
def a_22_merge(t):
    return C.merge_concepts(t.concepts_v, C.concept_clusters(t.concepts_v)).select("concept_id", r6("confidence").alias("confidence"), "support_count", "retired")


@query("a_22_generalize")
def a_22_generalize(t):
    return C.generalized_concepts(t.concepts_v).select("user_id", "concept_name", r6("confidence").alias("confidence"), "support_count")


_TOP6 = """SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY confidence DESC, concept_id) AS r FROM concepts_v WHERE NOT retired AND confidence >= 0.5"""


@query("a_23", f"""SELECT user_id, 'Synthesized from: ' || STRING_AGG(concept_name, ', ' ORDER BY r) AS description, ROUND(LEAST(1.0, AVG(confidence)), 6) AS confidence,
    CAST(SUM(CASE WHEN support_count <> 0 THEN support_count ELSE 1 END) AS BIGINT) AS support_count FROM ({_TOP6}) WHERE r <= 6 GROUP BY user_id HAVING COUNT(*) >= 3""")
def a_23(t):
    return C.synthesized_concepts(t.concepts_v).select("user_id", "description", r6("confidence").alias("confidence"), "support_count")


@query("a_24")
def a_24(t):
    return C.merge_traits(t.traits_v, C.trait_clusters(t.traits_v)).select("node_id", r6("confidence").alias("confidence"), "evidence_count", "retired")


@query("a_36", """SELECT concept_id, ROUND(CASE WHEN concept_id % 3 = 0 THEN confidence ELSE LEAST(1.0, (confidence + 0.9) / 2) END, 6) AS confidence, CASE WHEN concept_id % 3 = 0 THEN support_count ELSE 3 END AS support_count FROM concepts_v""")
def a_36(t):
    c = F.col("concept_id")
    evidence = t.concepts_v.select(c, F.lit(0.9).alias("confidence"), F.array(F.when(c % 3 == 0, c).otherwise(c + 1)).alias("memory_ids"))
    return C.refreshed_concept(t.concepts_v, evidence).select("concept_id", r6("confidence").alias("confidence"), "support_count")


@query("a_35", """SELECT q.query_id, ROUND(AVG(importance_score), 6) AS identity_alignment, ROUND(AVG(entropy_score), 6) AS goal_alignment FROM queries_v q JOIN memories_v m ON m.user_id = q.user_id
    AND m.memory_type IN ('identity', 'concept') GROUP BY q.query_id""")
def a_35(t):
    both = t.queries_v.select("query_id", "user_id").join(t.memories_v, "user_id")
    scored = both.select("query_id", "memory_id", F.col("importance_score").alias("identity_alignment"), F.col("entropy_score").alias("goal_alignment"))
    contexts = both.filter(F.col("memory_type").isin("identity", "concept")).select("query_id", F.array("memory_id").alias("source_ids"))
    df = A.context_alignment(contexts, scored)
    return df.select("query_id", r6("identity_alignment").alias("identity_alignment"), r6("goal_alignment").alias("goal_alignment"))


@query("a_09", f"""
    SELECT m.user_id, total_memories, n_episodic, n_semantic, COALESCE(concept_count, 0) AS concept_count, ROUND(CASE WHEN concept_count > 0 THEN total_memories / concept_count ELSE 0.0 END, 6) AS compression_ratio,
      total_memories * 150 - COALESCE(concept_count, 0) * 200 AS token_reduction
    FROM (SELECT user_id, COUNT(*) AS total_memories, COUNT(*) FILTER (WHERE memory_type = 'episodic') AS n_episodic, COUNT(*) FILTER (WHERE memory_type = 'semantic') AS n_semantic FROM ({FLT02_SQL}) GROUP BY user_id) m
    LEFT JOIN (SELECT user_id, COUNT(*) AS concept_count FROM concepts_v WHERE confidence >= 0.7 GROUP BY user_id) c ON c.user_id = m.user_id""")
def a_09(t):
    df = A.consolidation_metrics(E.consolidation_candidates(t.memories_v), planted(t), t.concepts_v.filter("confidence >= 0.7"), t.edges_v)
    return df.select("user_id", "total_memories", "n_episodic", "n_semantic", "concept_count", r6("compression_ratio").alias("compression_ratio"), "token_reduction")


_LIVE = "cognitive_state <> 'forgotten'"
_LIVE_DUPLICATES = leader_sql(f"SELECT user_id, memory_id AS id, {_WORDS.format(c='content')} AS ws FROM memories_v WHERE {_LIVE} AND memory_type IN ({', '.join(repr(x) for x in V.DUPLICATE_TYPES)})", 0.4, True, "user_id", "memory_id")
_LIVE_CONFLICTS = f"WITH {_STANCES.replace('FROM memories_v)', f'FROM memories_v WHERE {_LIVE})')} SELECT user_id, id_a, id_b FROM ({_CONFLICT})"
_ENTROPY = f"""dup AS MATERIALIZED ({_LIVE_DUPLICATES}), con AS MATERIALIZED ({_LIVE_CONFLICTS}),
    e AS MATERIALIZED (SELECT m.user_id, total_memories, COALESCE(duplicate_clusters, 0) AS duplicate_clusters, COALESCE(conflict_count, 0) AS conflict_count, COALESCE(d.n, 0) / total_memories AS redundancy,
        LEAST(1.0, COALESCE(conflict_count, 0) / GREATEST(1.0, total_memories / 4)) AS conflicts, COALESCE(fragmentation, 0.0) AS fragmentation, low / total_memories AS obsolete
      FROM (SELECT user_id, COUNT(*) AS total_memories, COUNT(*) FILTER (WHERE cognitive_state = 'decaying' OR COALESCE(memory_strength < 0.2, false)) AS low FROM memories_v WHERE {_LIVE} GROUP BY user_id) m
        LEFT JOIN (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT cluster_id) AS duplicate_clusters FROM dup GROUP BY user_id) d ON d.user_id = m.user_id
        LEFT JOIN (SELECT user_id, COUNT(*) AS conflict_count FROM con GROUP BY user_id) c ON c.user_id = m.user_id
        LEFT JOIN (SELECT user_id, AVG(CAST(COALESCE(NULLIF(support_count, 0), 1) <= 1 AS DOUBLE)) AS fragmentation FROM concepts_v GROUP BY user_id) f ON f.user_id = m.user_id),
    s AS (SELECT *, GREATEST(0.0, LEAST(1.0, 0.30 * redundancy + 0.25 * conflicts + 0.20 * fragmentation + 0.25 * obsolete)) AS entropy_score FROM e)"""


@query("a_11", f"""WITH {_ENTROPY} SELECT user_id, total_memories, duplicate_clusters, conflict_count, ROUND(redundancy, 6) AS redundancy, ROUND(conflicts, 6) AS conflicts,
    ROUND(fragmentation, 6) AS fragmentation, ROUND(obsolete, 6) AS obsolete, ROUND(entropy_score, 6) AS entropy_score FROM s""")
def a_11(t):
    live = t.memories_v.filter("cognitive_state <> 'forgotten'")
    df = N.store_entropy(live, t.concepts_v, BUCKETS)
    return df.select("user_id", "total_memories", "duplicate_clusters", "conflict_count", *[r6(c).alias(c) for c in ("redundancy", "conflicts", "fragmentation", "obsolete", "entropy_score")])


@query("a_12", f"""WITH {_ENTROPY}, flagged AS (SELECT memory_id FROM dup UNION SELECT id_a FROM con UNION SELECT id_b FROM con)
    SELECT m.memory_id, ROUND(CASE WHEN f.memory_id IS NOT NULL THEN s.entropy_score ELSE LEAST(COALESCE(m.entropy_score, 0.0), 0.05) END, 6) AS entropy_score
    FROM memories_v m LEFT JOIN flagged f ON f.memory_id = m.memory_id LEFT JOIN s ON s.user_id = m.user_id""")
def a_12(t):
    return N.per_memory_entropy(t.memories_v, t.concepts_v, BUCKETS).select("memory_id", r6("entropy_score").alias("entropy_score"))


@query("a_13")
def a_13(t):
    density = N.density(t.nodes_v, t.edges_v)
    df = N.health_report(t.memories_v, t.concepts_v, density, density, as_of(), BUCKETS)
    return df.select("user_id", "total_memories", "active_memories", *[r6(c).alias(c) for c in ("duplicate_ratio", "average_strength", "entropy_score", "graph_complexity", "cognitive_health_score")])
