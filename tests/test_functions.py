from __future__ import annotations

import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import days_ago
from engram import vocab as V
from engram.functions import lifecycle as L
from engram.functions import relevance as R
from engram.functions import scoring as S
from engram.functions import text as T
from engram.operators import understanding as U
from engram.operators.packing import fill_by_ratio, knapsack_mask, optimize_budget
from engram.sources import parse as P


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def row(spark):
    return lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))


def test_scores_stay_in_range_and_rank_sensibly(spark):
    df = spark.createDataFrame([("I always love my goal of building a startup and learning strategy!!!", "identity"), ("ok thanks bye", "episodic")], ["c", "t"])
    scores = S.heuristic_scores(F.col("c"), F.col("t"))
    rows = df.select(*[c.alias(n) for n, c in scores.items()]).collect()
    assert all(0 <= v <= 1 for r in rows for v in r)
    assert rows[0]["importance"] > rows[1]["importance"]


def test_stable_uuid_is_a_version_five_name_id(row):
    ns = uuid.UUID(V.ID_NAMESPACE)
    df = row(a="alice", b="2F1A9E2A-3C9A-4A5B-8F1E-8B6A2C9D4E10")
    assert one(df, T.stable_uuid(F.col("a"))) == str(uuid.uuid5(ns, "alice"))
    assert one(df, T.stable_uuid(F.col("b"))) == "2f1a9e2a-3c9a-4a5b-8f1e-8b6a2c9d4e10"


def test_text_shaping(row):
    df = row(a="the quick brown fox jumps over it", b="x" * 20)
    assert one(df, T.shorten(F.col("a"))) == "The quick brown fox jumps over"
    assert one(df, T.cut_at_space(F.col("a"), 12)) == "the quick..."
    assert one(df, T.truncate(F.col("b"), 10)) == "xxxxxxx..."
    assert one(df, T.humanize(F.lit("system_design"))) == "System design"
    assert one(df, T.humanize(F.lit(""))) == "General assistance"


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_only_listed_transitions_are_legal(spark):
    pairs = list(itertools.product(V.STATES, V.STATES))
    df = spark.createDataFrame(pairs, ["s", "t"])
    for r in df.select("s", "t", L.transition_allowed(F.col("s"), F.col("t")).alias("ok")).collect():
        assert r["ok"] == (r["t"] in V.TRANSITIONS[r["s"]])


def test_state_machine_examples(spark):
    df = spark.createDataFrame([("dormant", 0.8), ("decaying", 0.55), ("archived", 0.2), ("active", 0.2)], ["s", "m"])
    state, strength = L.state_on_access(F.col("s"), F.col("m"))
    got = [(r[0], round(r[1], 2)) for r in df.select(state, strength).collect()]
    assert got == [("active", 0.9), ("reinforced", 0.65), ("dormant", 0.3), ("active", 0.2)]


def test_weak_active_row_remains_because_archiving_is_illegal(spark):
    df = spark.createDataFrame([("active", 0.2, 10), ("dormant", 0.2, 10), ("archived", 0.05, 200), ("active", 0.5, 1), ("active", 0.9, 1)], ["s", "m", "d"])
    decision, _ = L.forgetting_decision(F.col("s"), F.col("m"), F.col("d"))
    assert [r[0] for r in df.select(decision).collect()] == ["Remain", "Archived", "Forgotten", "Weaken", "Remain"]


def test_identity_decays_slower_than_small_talk(memories, as_of):
    from engram.plans.evolution import effective_rate
    df = memories({"memory_type": "identity", "last_accessed": days_ago(60)}, {"memory_type": "episodic", "importance_score": 0.1, "last_accessed": days_ago(60)})
    df = df.withColumns({"in_concept": F.lit(False), "in_identity": F.lit(False)})
    slow, fast = [r["r"] for r in df.select("memory_id", effective_rate(as_of).alias("r")).orderBy("memory_id").collect()]
    assert slow < fast / 10


@pytest.mark.parametrize(("query", "goal"), [
    ("Help me prepare for my interview tomorrow", "interview_preparation"),
    ("Let's brainstorm a startup business idea", "startup_ideation"),
    ("How should I approach system design for a microservices architecture", "system_design"),
    ("hello there", "general_assistance"), ("", "general_assistance")])
def test_goals(spark, query, goal):
    r = U.detect_goals(spark.createDataFrame([(query,)], ["query"])).first()
    assert r["goal"] == goal
    assert r["goal_confidence"] == (0.0 if query == "" else r["goal_confidence"]) and r["goal_confidence"] <= 1


def test_several_intents_at_once(spark):
    r = U.classify_intents(spark.createDataFrame([("compare Redis and Memcached and optimize my cache",), ("",)], ["query"])).collect()
    assert {i["intent"] for i in r[0]["intents"]} >= {"compare", "optimize"}
    assert r[1]["primary_intent"] == "explain"


def test_knowledge_gaps(spark):
    queries = spark.createDataFrame([(1, "design a distributed cache"), (2, "hello"), (3, "rust ownership")], ["query_id", "query"])
    rows = spark.createDataFrame([(1, "we studied consistency"), (1, "replication and the cap theorem"), (3, "ownership borrowing lifetimes traits, safety of memory")], ["query_id", "text"])
    got = {r["query_id"]: r for r in U.knowledge_gaps(queries, rows).collect()}
    assert "Consistency" not in got[1]["missing_topics"] and "Consensus" in got[1]["missing_topics"]
    assert len(got[1]["missing_topics"]) <= V.MAX_MISSING_TOPICS
    assert got[2]["triggered_topics"] == [] and got[3]["missing_topics"] == []


def test_knapsack_textbook_and_brute_force():
    values, costs = np.array([60.0, 100.0, 120.0]), np.array([10, 20, 30])
    assert list(np.flatnonzero(knapsack_mask(values, costs, 50))) == [1, 2]
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = 9
        values, costs, budget = rng.random(n), rng.integers(1, 12, n), int(rng.integers(5, 40))
        best = max(sum(values[list(c)]) for k in range(n + 1) for c in itertools.combinations(range(n), k) if sum(costs[list(c)]) <= budget)
        mask = knapsack_mask(values, costs, budget)
        assert costs[mask].sum() <= budget and values[mask].sum() == pytest.approx(best)


def test_budget_is_spent_exactly_or_by_ratio(spark):
    rows = [(1, i, 1.0 / (i + 1), 10) for i in range(70)] + [(2, i, 1.0, 30) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, memory_id long, utility_score double, token_cost int")
    got = optimize_budget(df, "query_id", "memory_id", 100).groupBy("query_id").agg(F.sum("token_cost").alias("c"), F.count("*").alias("n")).collect()
    assert {r["query_id"]: (r["c"], r["n"]) for r in got} == {1: (100, 10), 2: (90, 3)}
    assert optimize_budget(df, "query_id", "memory_id", 0).count() == 0
    assert fill_by_ratio(df, "query_id", "memory_id", "utility_score", "token_cost", 5).count() == 0


def test_malformed_responses_are_dropped(spark):
    df = spark.createDataFrame([(1, '[{"memory_type":"semantic","content":"likes tea"},{"memory_type":"odd","content":"x"},{"content":"y"}]'), (2, "no json")], ["conv_id", "response"])
    got = P.extracted_memories(df).collect()
    assert [(r["conv_id"], r["content"], r["importance_score"]) for r in got] == [(1, "likes tea", 0.5)]


def test_concept_is_found_inside_chatter(spark):
    df = spark.createDataFrame([('Sure!\n{"name": "Tea", "description": "d", "confidence": 1.7}\nbye',), ('{"name": "Tea"}',)], ["r"])
    got = df.select(P.parsed_concept(F.col("r")).alias("c")).collect()
    assert got[0]["c"]["confidence"] == 1.0 and got[1]["c"] is None


def test_trait_values_are_normalised(spark):
    df = spark.createDataFrame([("backend",), ("python",), ("gardening",)], ["v"])
    assert [r[0] for r in df.select(P.normal_trait(F.col("v"))).collect()] == ["backend_engineering", "python", "gardening"]
