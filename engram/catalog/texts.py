"""Text scoring and shaping (SC-01 … SC-23) and response parsing (SRC-05 … SRC-09, SRC-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import vocab as V
from engram.catalog.registry import query, r6
from engram.functions import scoring as S
from engram.functions import text as T
from engram.sources import parse as P

# Word lists that occur in the driver corpus.
LEX = S.Lexicon(high=["the", "and", "with", "for"], low=["of", "in"], identity=["is", "it", "la"],
                pronouns=[" a ", "on", "on"], emotional=["that", "was", "ein"], persistence=["be", "are", "der"],
                emphatic=["this", "und"])
MARKS = [["the", "der"], ["with"], ["that", "und"], ["are"]]
GROUPS = {"articles": ["the ", "der ", "le "], "links": ["and", "und", " et "], "places": [" in ", " on ", " at "],
          "rare": ["zzz"]}
BUCKETS = {"naming": ["is", "are", "be"], "past": ["was", "the was"], "linking": ["and the", "with"]}


def hit_sql(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


def case_sql(key: str, table: dict, default: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END)"


def clamp_sql(e: str) -> str:
    return f"GREATEST(0.0, LEAST(1.0, {e}))"


def count_sql(col: str, piece: str) -> str:
    return f"CAST((LENGTH({col}) - LENGTH(REPLACE({col}, '{piece}', ''))) / {len(piece)} AS INT)"


LOW = "LOWER(content)"
BASE = case_sql("memory_type", V.TYPE_BASE, 0.5)
WORDS = r"LEN(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(content), '\s+'), x -> x <> ''))"
SQL_SCORES = {
    "future_utility": clamp_sql(
        f"{BASE} + LEAST(0.3, {hit_sql(LOW, LEX.high)} * 0.05) - LEAST(0.2, {hit_sql(LOW, LEX.low)} * 0.03)"
        f" + CASE WHEN LENGTH(content) > 200 THEN 0.1 WHEN LENGTH(content) < 20 THEN -0.1 ELSE 0.0 END"),
    "identity_impact": clamp_sql(
        f"{BASE} + LEAST(0.35, {hit_sql(LOW, LEX.identity)} * 0.07) + LEAST(0.15, "
        f"({' + '.join(count_sql(LOW, p) for p in LEX.pronouns)}) * 0.03)"),
    "emotional_salience": clamp_sql(
        f"{BASE} + LEAST(0.4, {hit_sql(LOW, LEX.emotional)} * 0.08) + LEAST(0.2, {count_sql(LOW, '!')} * 0.05)"),
    "reinforcement": clamp_sql(
        f"{BASE} + CASE WHEN {WORDS} > 100 THEN 0.15 WHEN {WORDS} < 15 THEN -0.10 ELSE 0.0 END"
        f" + LEAST(0.15, {hit_sql(LOW, LEX.emphatic)} * 0.05)"),
    "temporal_persistence": clamp_sql(
        f"{BASE} + LEAST(0.3, {hit_sql(LOW, LEX.persistence)} * 0.06)"
        f" + CASE WHEN LENGTH(content) > 100 AND {WORDS} > 20 THEN 0.1 ELSE 0.0 END"),
}
SCORED = "SELECT memory_id, user_id, memory_type, content, " + ", ".join(
    f"{e} AS {n}" for n, e in SQL_SCORES.items()) + " FROM memories_v"
IMPORTANCE = clamp_sql(" + ".join(f"{n} * {w}" for n, w in V.IMPORTANCE_WEIGHTS.items()))
WITH_IMPORTANCE = f"SELECT *, {IMPORTANCE} AS importance FROM ({SCORED})"


def scored(t):
    """Memories with their heuristic dimensions, importance computed from the finished columns."""
    made = S.heuristic_scores(F.col("content"), F.col("memory_type"), LEX)
    wide = t.memories_v.withColumns({n: made[n] for n in V.SCORE_NAMES})
    return wide.withColumn("importance", S.weighted_importance({n: F.col(n) for n in V.SCORE_NAMES}))


@query("sc_01", f"SELECT memory_id, {hit_sql(LOW, LEX.high)} AS n_high, {hit_sql(LOW, LEX.low)} AS n_low FROM memories_v")
def sc_01(t):
    low = F.lower("content")
    return t.memories_v.select("memory_id", T.hits(low, LEX.high).alias("n_high"), T.hits(low, LEX.low).alias("n_low"))


def _score_query(key: str, name: str, fn) -> None:
    @query(key, f"SELECT memory_id, ROUND({SQL_SCORES[name]}, 6) AS {name} FROM memories_v")
    def run(t):
        base = S.type_base(F.col("memory_type"))
        return t.memories_v.select("memory_id", r6(fn(F.col("content"), base, LEX)).alias(name))


_score_query("sc_02", "future_utility", S.future_utility)
_score_query("sc_03", "identity_impact", S.identity_impact)
_score_query("sc_04", "emotional_salience", S.emotional_salience)
_score_query("sc_05", "reinforcement", S.reinforcement)
_score_query("sc_06", "temporal_persistence", S.temporal_persistence)


@query("sc_07", f"SELECT memory_id, ROUND(importance, 6) AS importance FROM ({WITH_IMPORTANCE})")
def sc_07(t):
    return scored(t).select("memory_id", r6("importance").alias("importance"))


@query("sc_08", f"""
    SELECT m.memory_id, ROUND(m.future_utility_score * 0.7 + s.future_utility * 0.3, 6) AS future_utility,
      ROUND({clamp_sql(" + ".join(f"(m.{n}_score * 0.7 + s.{n} * 0.3) * {w}" for n, w in V.IMPORTANCE_WEIGHTS.items()))}, 6) AS importance
    FROM memories_v m JOIN ({SCORED}) s ON m.memory_id = s.memory_id""")
def sc_08(t):
    df = scored(t)
    mixed = S.blend({n: F.col(f"{n}_score") for n in V.SCORE_NAMES}, {n: F.col(n) for n in V.SCORE_NAMES})
    return df.select("memory_id", r6(mixed["future_utility"]).alias("future_utility"),
                     r6(mixed["importance"]).alias("importance"))


@query("sc_09", """
    SELECT memory_id, CASE WHEN importance_score >= 0.80 THEN 'active' WHEN importance_score >= 0.60 THEN 'reinforced'
      WHEN importance_score >= 0.40 THEN 'semantic_candidate' WHEN importance_score >= 0.20 THEN 'dormant'
      ELSE 'decaying' END AS initial_state FROM memories_v""")
def sc_09(t):
    return t.memories_v.select("memory_id", S.initial_state(F.col("importance_score")).alias("initial_state"))


@query("sc_10", f"""
    SELECT memory_id, ROUND({case_sql('memory_type', V.TYPE_DECAY, 0.05)} * (1 - importance_score * 0.5), 6) AS decay_rate
    FROM memories_v""")
def sc_10(t):
    rate = S.initial_decay_rate(F.col("importance_score"), F.col("memory_type"))
    return t.memories_v.select("memory_id", r6(rate).alias("decay_rate"))


_BOTH = "(LOWER(content) || ' ' || LOWER(COALESCE(summary, '')))"
_SIGNS = " + ".join(f"CAST(({' OR '.join(f'contains(content, {w!r})' for w in g)}) AS INT)" for g in MARKS)
INGEST_SQL = clamp_sql(f"""{BASE} * 0.4
  + (CASE WHEN {hit_sql(_BOTH, LEX.high)} = 0 AND {hit_sql(_BOTH, LEX.low)} = 0 THEN 0.5
     ELSE {clamp_sql(f"0.3 + ({hit_sql(_BOTH, LEX.high)} * 0.15 - {hit_sql(_BOTH, LEX.low)} * 0.1)")} END) * 0.3
  + (0.5 + (CAST({WORDS} > 10 AS INT) + {_SIGNS}) * 0.1) * 0.2
  + (CASE WHEN LENGTH(content) < 10 THEN 0.2 WHEN LENGTH(content) < 50 THEN 0.6 WHEN LENGTH(content) < 500 THEN 0.9
     ELSE 0.7 END) * 0.1""")


@query("sc_11", f"SELECT memory_id, ROUND({INGEST_SQL}, 6) AS importance FROM memories_v")
def sc_11(t):
    score = S.ingest_importance(F.col("content"), F.col("summary"), F.col("memory_type"), LEX.high, LEX.low, MARKS)
    return t.memories_v.select("memory_id", r6(score).alias("importance"))


@query("sc_12", """
    SELECT conv_id, turn, LENGTH(text) // 4 AS tokens, GREATEST(1, LENGTH(text) // 4) AS budget_tokens FROM turns_v""")
def sc_12(t):
    return t.turns_v.select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens"),
                            T.budget_tokens(F.col("text")).alias("budget_tokens"))


_STOP = "[" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "]"
KEYWORDS_SQL = r"""
    SELECT query_id, user_id, w, MIN(i) AS i FROM (
      SELECT query_id, user_id, UNNEST(ws) AS w, UNNEST(RANGE(1, LEN(ws) + 1)) AS i FROM (
        SELECT query_id, user_id, REGEXP_EXTRACT_ALL(LOWER(query), '[a-zA-Z][a-zA-Z0-9\-]{2,}') AS ws FROM queries_v))
    WHERE NOT LIST_CONTAINS(""" + _STOP + ", w) GROUP BY query_id, user_id, w"


@query("sc_13", f"SELECT query_id, STRING_AGG(w, ' ' ORDER BY i) AS keywords FROM ({KEYWORDS_SQL}) GROUP BY query_id")
def sc_13(t):
    return (t.queries_v.select("query_id", F.array_join(T.keywords(F.col("query")), " ").alias("keywords"))
            .filter("keywords <> ''"))


WORDS_SQL = r"LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(content), '[\p{L}\p{N}_]+'))"


@query("sc_14", f"""
    SELECT memory_id, LEN({WORDS_SQL}) AS n_distinct,
      LEN(LIST_FILTER({WORDS_SQL}, w -> NOT LIST_CONTAINS({_STOP}, w))) AS n_content FROM memories_v""")
def sc_14(t):
    return t.memories_v.select("memory_id", F.size(T.word_set(F.col("content"))).alias("n_distinct"),
                               F.size(T.word_set(F.col("content"), V.STOPWORDS)).alias("n_content"))


@query("sc_15", f"""
    SELECT user_id, UPPER(SUBSTR(w, 1, 1)) || SUBSTR(w, 2) || ' Interest' AS label, n FROM (
      SELECT user_id, w, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, w) AS r FROM (
        SELECT user_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(content), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM memories_v)
      WHERE NOT LIST_CONTAINS({_STOP}, w) GROUP BY user_id, w) WHERE r = 1""")
def sc_15(t):
    from engram.operators.labels import top_words
    top = top_words(t.memories_v, ["user_id"], "content", 1)
    return top.select("user_id", F.concat(T.capitalize(F.col("word")), F.lit(" Interest")).alias("label"), "n")


@query("sc_16", f"""
    SELECT user_id, STRING_AGG(UPPER(SUBSTR(w, 1, 1)) || SUBSTR(w, 2), ' ' ORDER BY r) AS label FROM (
      SELECT user_id, w, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, w) AS r FROM (
        SELECT user_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(concept_name), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM concepts_v)
      WHERE NOT LIST_CONTAINS({_STOP}, w) GROUP BY user_id, w) WHERE r <= 3 GROUP BY user_id""")
def sc_16(t):
    from engram.operators.labels import top_word_label
    return top_word_label(t.concepts_v, ["user_id"], "concept_name", 3)


@query("sc_20", f"""
    SELECT memory_id, {" || ".join(f"CASE WHEN {' OR '.join(f'contains({LOW}, {w!r})' for w in ws)} THEN '{g};' ELSE '' END" for g, ws in GROUPS.items())} AS groups
    FROM memories_v""")
def sc_20(t):
    found = T.concept_groups(F.col("content"), GROUPS)
    return t.memories_v.select("memory_id", F.array_join(F.transform(found, lambda g: F.concat(g, F.lit(";"))), "").alias("groups"))


@query("sc_21", r"""
    SELECT conv_id, turn, contains(text, '?') AND LEN(LIST_FILTER(STRING_SPLIT_REGEX(text, '\s+'), x -> x <> '')) > 4 AS is_question
    FROM turns_v""")
def sc_21(t):
    return t.turns_v.select("conv_id", "turn", T.is_question(F.col("text")).alias("is_question"))


@query("sc_22", r"""
    SELECT memory_id, CASE WHEN LENGTH(content) > 200 THEN SUBSTR(content, 1, 197) || '...' ELSE content END AS truncated,
      CASE WHEN LENGTH(content) > 200 THEN
        CASE WHEN contains(SUBSTR(content, 1, 200), ' ') THEN
          CASE WHEN REGEXP_EXTRACT(SUBSTR(content, 1, 200), '(?s)^(.*) [^ ]*$', 1) <> ''
            THEN REGEXP_EXTRACT(SUBSTR(content, 1, 200), '(?s)^(.*) [^ ]*$', 1) || '...' ELSE SUBSTR(content, 1, 200) END
        ELSE SUBSTR(content, 1, 200) || '...' END ELSE content END AS cut,
      UPPER(SUBSTR(short, 1, 1)) || SUBSTR(short, 2) AS short
    FROM (SELECT *, ARRAY_TO_STRING(LIST_SLICE(LIST_FILTER(STRING_SPLIT_REGEX(content, '\s+'), x -> x <> ''), 1, 6), ' ') AS short
          FROM memories_v)""")
def sc_22(t):
    c = F.col("content")
    return t.memories_v.select("memory_id", T.truncate(c, 200).alias("truncated"), T.cut_at_space(c, 200).alias("cut"),
                               T.shorten(c).alias("short"))


@query("sc_23")
def sc_23(t):
    return t.memories_v.select("memory_id", T.stable_uuid(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("user_uuid"))


# ---- responses: JSON texts that Spark derives from the tables ---------------
def _memory_responses(t):
    """One response per conversation turn: a JSON array with one good and one broken item."""
    good = F.struct(F.element_at(T.strings(V.MEMORY_TYPES), (F.col("turn") % 5 + 1).cast("int")).alias("memory_type"),
                    F.col("text").alias("content"), F.substring("text", 1, 40).alias("summary"),
                    F.when(F.col("turn") % 3 != 0, (F.length("text") % 100) / 100).alias("importance_score"))
    broken = F.struct(F.lit("unknown").alias("memory_type"), F.col("role").alias("content"),
                      F.lit(None).cast("string").alias("summary"), F.lit(0.9).alias("importance_score"))
    return t.turns_v.withColumn("response", F.to_json(F.array(good, broken)))


_EXTRACTED_SQL = f"""
    SELECT conv_id, turn, user_id, text, {'CASE CAST(turn % 5 AS INT) ' + ' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(V.MEMORY_TYPES)) + ' END'} AS memory_type,
      CASE WHEN turn % 3 <> 0 THEN (LENGTH(text) % 100) / 100.0 ELSE 0.5 END AS importance_score
    FROM turns_v WHERE LENGTH(text) > 0"""


@query("src_05", f"SELECT conv_id, turn, memory_type, LENGTH(text) AS n_chars, ROUND(importance_score, 6) AS importance_score FROM ({_EXTRACTED_SQL})")
def src_05(t):
    rows = P.extracted_memories(_memory_responses(t), keys=["conv_id", "turn"])
    return rows.select("conv_id", "turn", "memory_type", F.length("content").alias("n_chars"),
                       r6("importance_score").alias("importance_score"))


@query("src_02", f"""
    SELECT conv_id, COUNT(*) AS n_extracted, CAST(SUM(CAST(importance_score >= 0.3 AS INT)) AS BIGINT) AS n_kept,
      GREATEST(0, MAX(conv_len) // 4 - CAST(SUM(CASE WHEN importance_score >= 0.3 THEN LENGTH(text) // 4 ELSE 0 END) AS BIGINT)) AS tokens_saved
    FROM ({_EXTRACTED_SQL}) JOIN (SELECT conv_id, CAST(SUM(LENGTH(text) + 1) - 1 AS BIGINT) AS conv_len FROM turns_v GROUP BY conv_id) USING (conv_id)
    GROUP BY conv_id""")
def src_02(t):
    from engram.sources.store import ingest_summary
    rows = P.extracted_memories(_memory_responses(t), keys=["conv_id", "turn"])
    return ingest_summary(rows, t.turns_v)


TRAIT_VALUES = {"goal": ["andante", "theory"], "skill": ["derive", "wither"]}
NORMAL_SQL = "CASE node_value WHEN 'and' THEN 'andante' WHEN 'the' THEN 'theory' WHEN 'der' THEN 'derive' WHEN 'with' THEN 'wither' ELSE node_value END"


@query("src_06", f"SELECT node_id, node_type, {NORMAL_SQL} AS node_value, ROUND(confidence, 6) AS confidence FROM traits_v")
def src_06(t):
    plural = {v: k for k, v in V.TRAIT_CATEGORIES.items()}
    body = F.to_json(F.create_map(T.lookup(F.col("node_type"), plural, ""), F.array(F.struct(
        F.upper("node_value").alias("value"), F.col("confidence").alias("confidence"), F.lit("seen").alias("reasoning")))))
    made = P.extracted_traits(t.traits_v.select("node_id", body.alias("response")), keys=["node_id"], values=TRAIT_VALUES)
    return made.select("node_id", "node_type", "node_value", r6("confidence").alias("confidence"))


@query("sc_44", f"SELECT node_id, {NORMAL_SQL} AS node_value FROM traits_v")
def sc_44(t):
    return t.traits_v.select("node_id", P.normal_trait(F.col("node_value"), TRAIT_VALUES).alias("node_value"))


@query("src_07", "SELECT concept_id, concept_name AS name, description, ROUND(confidence, 6) AS confidence FROM concepts_v")
def src_07(t):
    body = F.to_json(F.struct(F.col("concept_name").alias("name"), "description", "confidence"))
    wrapped = F.when(F.col("concept_id") % 2 == 0, body).otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    c = t.concepts_v.select("concept_id", P.parsed_concept(wrapped).alias("c"))
    return c.select("concept_id", "c.name", "c.description", r6("c.confidence").alias("confidence"))


_DEFAULT_FU = case_sql("memory_type", {k: d.get("future_utility", 0.5) for k, d in V.TYPE_DEFAULT_SCORES.items()}, 0.5)
_DEFAULT_BASE = case_sql("memory_type", {k: d["base"] for k, d in V.TYPE_DEFAULT_SCORES.items()}, 0.5)


@query("src_08", f"""
    SELECT memory_id, ROUND(CASE WHEN memory_id % 7 = 0 THEN {_DEFAULT_FU} ELSE LEAST(1.0, future_utility_score * 1.5) END, 6) AS future_utility,
      ROUND(CASE WHEN memory_id % 7 = 0 THEN {_DEFAULT_BASE} ELSE {clamp_sql("LEAST(1.0, future_utility_score * 1.5) * 0.3 + identity_impact_score * 0.25 + emotional_salience_score * 0.15 + reinforcement_score * 0.15 + temporal_persistence_score * 0.15")} END, 6) AS importance
    FROM memories_v""")
def src_08(t):
    body = F.to_json(F.struct((F.col("future_utility_score") * 1.5).alias("future_utility"),
                              *[F.col(f"{n}_score").alias(n) for n in V.SCORE_NAMES[1:]]))
    response = F.when(F.col("memory_id") % 7 == 0, F.concat(F.lit("no scores: "), body)).otherwise(body)
    scores = P.parsed_scores(F.col("response"), F.col("memory_type"))
    return (t.memories_v.withColumn("response", response)
            .select("memory_id", r6(scores["future_utility"]).alias("future_utility"), r6(scores["importance"]).alias("importance")))


@query("src_09", """
    SELECT memory_id, LEN(embedding) AS n_dims, ROUND(LIST_SUM(LIST_TRANSFORM(embedding, x -> CAST(CAST(x AS VARCHAR) AS DOUBLE))), 6) AS total
    FROM vectors_v""")
def src_09(t):
    text = P.vector_text(F.col("embedding"))
    odd = F.when(F.col("memory_id") % 2 == 0, text).otherwise(F.regexp_replace(text, r"[\[\]]", ""))
    v = t.vectors_v.select("memory_id", P.vector(odd).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return v.select("memory_id", F.size("v").alias("n_dims"), r6(total).alias("total"))


@query("src_19", """
    SELECT user_id, batch, COUNT(*) AS n_rows, STRING_AGG(line, CHR(10) ORDER BY memory_id) AS request_text FROM (
      SELECT user_id, memory_id, '- ' || COALESCE(summary, SUBSTR(content, 1, 200)) AS line,
        (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY memory_id) - 1) // 10 AS batch FROM memories_v)
    GROUP BY user_id, batch""")
def src_19(t):
    return P.extraction_batches(t.memories_v)
