"""What a query is after: goals, intents, required knowledge, gaps (SC-17 … SC-19, SC-67).

Signal tables are small parameters, so they become column expressions and need no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.text import ANY_CASE, keywords, lookup, strings

Signals = Mapping[str, Sequence[tuple[str, float]]]


def _scored(text: Column, signals: Signals, flags: str) -> list[Column]:
    """One struct per label: sort key, score and the patterns that matched."""
    out = []
    for i, (label, patterns) in enumerate(signals.items()):
        score, matched = F.lit(0.0), []
        for pattern, weight in patterns:
            hit = text.rlike(flags + pattern)
            score = score + F.when(hit, weight).otherwise(0.0)
            matched.append(F.when(hit, F.lit(pattern)))
        out.append(F.struct((-score).alias("k"), F.lit(i).alias("i"), F.lit(label).alias("label"),
                            score.alias("score"), F.array_compact(F.array(*matched)).alias("matched")))
    return out


def detect_goals(queries: DataFrame, signals: Signals = V.GOAL_SIGNALS, text: str = "query",
                 flags: str = ANY_CASE) -> DataFrame:
    """Add the likeliest goal, its confidence, up to three alternatives and the matched signals (SC-17)."""
    q = F.coalesce(F.col(text), F.lit(""))
    ranked = F.array_sort(F.filter(F.array(*_scored(q, signals, flags)), lambda s: s["score"] > 0))
    df = queries.withColumn("_r", ranked)
    total = F.aggregate("_r", F.lit(0.0), lambda a, s: a + s["score"])
    some, top = F.size("_r") > 0, F.get("_r", F.lit(0))
    share = F.least(F.lit(1.0), top["score"] / total) * F.least(F.lit(1.0), top["score"])
    return df.select(
        *queries.columns,
        F.when(some, top["label"]).otherwise(V.DEFAULT_GOAL).alias("goal"),
        F.when(some, F.bround(F.greatest(share, F.lit(0.3)), 3)).when(F.trim(q) == "", 0.0).otherwise(0.35).alias("goal_confidence"),
        F.transform(F.slice("_r", 2, 3), lambda s: F.struct(s["label"].alias("goal"), F.bround(s["score"], 3).alias("score"))).alias("alternative_goals"),
        F.when(some, top["matched"]).otherwise(F.array().cast("array<string>")).alias("matched_signals"))


def classify_intents(queries: DataFrame, signals: Signals = V.INTENT_SIGNALS, top_k: int = 3, text: str = "query",
                     flags: str = ANY_CASE) -> DataFrame:
    """Add independent intent probabilities, best first, and the primary intent (SC-18)."""
    q = F.coalesce(F.col(text), F.lit(""))
    scored = F.transform(F.array(*_scored(q, signals, flags)), lambda s: F.struct(
        (-F.bround(s["score"] / (s["score"] + 1.0), 3)).alias("k"), s["i"].alias("i"), s["label"].alias("intent"),
        F.bround(s["score"] / (s["score"] + 1.0), 3).alias("probability")))
    df = queries.withColumn("_r", F.array_sort(scored))
    strong = F.filter("_r", lambda s: s["probability"] > 0.05)
    kept = F.when(F.size(strong) > 0, F.slice(strong, 1, max(top_k, 1))).otherwise(F.slice("_r", 1, 1))
    named = F.transform(kept, lambda s: F.struct(s["intent"].alias("intent"), s["probability"].alias("probability")))
    blank = F.array(F.struct(F.lit("explain").alias("intent"), F.lit(0.0).alias("probability")))
    out = df.withColumn("intents", F.when(F.trim(q) == "", blank).otherwise(named)).drop("_r")
    return out.withColumn("primary_intent", F.get("intents", F.lit(0))["intent"])


def required_knowledge(goal: Column, table: Mapping[str, Sequence[str]] = V.GOAL_KNOWLEDGE) -> Column:
    default = strings(table[V.DEFAULT_GOAL])
    out = None
    for name, topics in table.items():
        out = F.when(goal == name, strings(topics)) if out is None else out.when(goal == name, strings(topics))
    return default if out is None else out.otherwise(default)


def reasoning_strategy(goal: Column, table: Mapping[str, str] = V.GOAL_STRATEGY) -> Column:
    return lookup(goal, table, table[V.DEFAULT_GOAL])


def understand(queries: DataFrame, goals: Signals = V.GOAL_SIGNALS, intents: Signals = V.INTENT_SIGNALS,
               knowledge: Mapping[str, Sequence[str]] = V.GOAL_KNOWLEDGE, flags: str = ANY_CASE) -> DataFrame:
    """Goal, intents, keywords and required knowledge of each query."""
    df = classify_intents(detect_goals(queries, goals, flags=flags), intents, flags=flags)
    return (df.withColumn("keywords", keywords(F.coalesce("query", F.lit(""))))
            .withColumn("required_knowledge", required_knowledge(F.col("goal"), knowledge)))


def triggered_topics(text: Column, expectations: Sequence[tuple[str, Sequence[str]]] = V.TOPIC_EXPECTATIONS,
                     flags: str = ANY_CASE) -> Column:
    """Distinct topics in trigger order."""
    parts = [F.when(text.rlike(flags + p), strings(topics)).otherwise(strings([])) for p, topics in expectations]
    return F.array_distinct(F.concat(*parts))


def _covers(text: Column, topic: Column) -> tuple[Column, Column]:
    """(phrase found, significant words found) of a topic in one row's text."""
    words = F.filter(F.split(topic, " "), lambda w: F.length(w) > 3)
    return F.contains(text, topic), F.filter(words, lambda w: F.contains(text, w))


def knowledge_gaps(queries: DataFrame, rows: DataFrame, expectations=V.TOPIC_EXPECTATIONS,
                   limit: int = V.MAX_MISSING_TOPICS, flags: str = ANY_CASE, key: str = "query_id", texts: DataFrame | None = None) -> DataFrame:
    """Topics a query implies that the rows kept for it leave out (SC-67).

    ``rows`` holds (key, text), or (key, memory_id) with the ``texts`` (memory_id, text) beside it, which then meet the topics once a row.
    Each row is tested on its own and the findings are combined per topic, so no user's whole text is ever concatenated.
    """
    topics = queries.select(key, F.posexplode(triggered_topics(F.col("query"), expectations, flags)).alias("pos", "topic"))
    phrase, found = _covers(F.lower("text"), F.col("topic"))
    if texts is None:
        held = topics.join(rows.select(key, "text"), key, "left")
    else:
        here = topics.join(rows.select(key, "memory_id"), key).join(texts.select("memory_id", "text"), "memory_id").select(key, "pos", "topic", "text")
        held = here.unionByName(topics.withColumn("text", F.lit(None).cast("string")))
    seen = (held.groupBy(key, "pos", "topic")
            .agg(F.max(F.coalesce(phrase, F.lit(False))).alias("phrase"),
                 F.array_distinct(F.flatten(F.collect_set(F.coalesce(found, F.array().cast("array<string>"))))).alias("found")))
    needed = F.filter(F.split("topic", " "), lambda w: F.length(w) > 3)
    covered = F.col("phrase") | ((F.size(needed) > 0) & (F.size(F.array_except(needed, F.col("found"))) == 0))
    item = F.struct("pos", F.initcap("topic").alias("topic"))

    def ordered(flag: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(flag, item))), lambda s: s["topic"])

    per_query = seen.withColumn("covered", covered).groupBy(key).agg(
        F.slice(ordered(~F.col("covered")), 1, limit).alias("missing_topics"),
        ordered(F.lit(True)).alias("triggered_topics"), ordered(F.col("covered")).alias("covered_topics"))
    none = F.array().cast("array<string>")
    return queries.select(key).join(per_query, key, "left").select(
        key, *[F.coalesce(c, none).alias(c) for c in ("missing_topics", "triggered_topics", "covered_topics")])
