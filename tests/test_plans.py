"""Composite jobs and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, days_ago
from engram.operators import analytics as A
from engram.operators import identity as I
from engram.operators.understanding import understand
from engram.plans import compose as CO
from engram.plans import evolution as EV
from engram.plans import offline as OF
from engram.plans import recall as RC
from engram.sources import store as ST
from engram.streaming import jobs as J


def test_newer_claim_supersedes_the_older(memories, as_of):
    m = memories({"content": "User prefers Vue for frontend work", "last_accessed": days_ago(100)}, {"content": "User prefers React for frontend work", "last_accessed": days_ago(1)},
                 {"content": "User likes long walks"})
    after, events = EV.supersede(m, as_of)
    rows = {r["memory_id"]: r for r in after.collect()}
    assert rows[1]["cognitive_state"] == "archived" and rows[1]["memory_strength"] == pytest.approx(0.25)
    assert rows[2]["memory_strength"] == pytest.approx(0.6) and rows[2]["reinforcement_count"] == 1
    assert rows[3]["cognitive_state"] == "active"
    assert [(e["memory_id"], e["event_type"]) for e in events.collect()] == [(1, "archive")]


def test_episodic_rows_never_conflict(memories, as_of):
    m = memories({"content": "User prefers Vue for frontend work", "memory_type": "episodic"}, {"content": "User prefers React for frontend work", "memory_type": "episodic"})
    assert EV.supersede(m, as_of)[1].count() == 0


def test_evolution_keeps_every_row_and_logs_changes(memories, empty_concepts, empty_traits, as_of):
    m = memories({"content": "Likes Rust"}, {"content": "Enjoys Rust"}, {"content": "idle", "cognitive_state": "archived", "last_accessed": days_ago(300)},
                 {"content": "gone", "cognitive_state": "forgotten"}, {"content": "User prefers Vue for frontend", "memory_type": "identity", "last_accessed": days_ago(50)})
    e = EV.evolve(m, empty_concepts, empty_traits, as_of)
    rows = {r["memory_id"]: r for r in e.memories.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[3]["cognitive_state"] == "forgotten" and rows[5]["cognitive_state"] == "dormant" and rows[1]["cognitive_state"] == "archived"
    assert all(0 <= r["memory_strength"] <= 1 and 0 <= r["entropy_score"] <= 1 for r in rows.values())
    kinds = {(r["memory_id"], r["event_type"]) for r in e.events.collect()}
    assert {(1, "merge"), (2, "merge"), (1, "decay")} <= kinds


def test_recall_packs_and_explains(spark, memories, empty_concepts, empty_traits, as_of):
    m = memories({"content": "Explains the caching architecture and databases", "memory_type": "procedural"}, {"content": "Explains the caching architecture and databases", "memory_type": "semantic"},
                 {"content": "Ate an apple", "memory_type": "episodic"}, {"content": "archived note on architecture", "cognitive_state": "archived"})
    q = understand(spark.createDataFrame([(7, 1, "system design: explain caching architecture")], "query_id long, user_id long, query string"))
    chosen = RC.predictive_recall(m, q, empty_traits, empty_concepts, as_of, 1000)
    got = chosen.orderBy("retrieval_rank").collect()
    assert got[0]["memory_id"] == 1 and 2 not in {r["memory_id"] for r in got} and 4 not in {r["memory_id"] for r in got}
    assert got[0]["selection_reason"].startswith("Selected because it matches the current goal")
    text = RC.assemble(chosen, q).first()["context_text"]
    assert "Communication Style:" in text and "System design" in text and "Supporting Evidence" not in text


def test_compose_within_budget(spark, memories, empty_concepts, empty_traits, as_of):
    m = memories(*[{"content": f"note {i} on topic {i % 3} with details {i * 7}", "memory_type": "semantic"} for i in range(12)],
                 {"content": "User prefers tabs for indentation", "memory_type": "identity", "last_accessed": days_ago(90)}, {"content": "User prefers spaces for indentation", "memory_type": "identity"})
    q = understand(spark.createDataFrame([(1, 1, "summarize my notes on indentation")], "query_id long, user_id long, query string"))
    c = CO.compose(m, q, empty_traits, empty_concepts, as_of, 60)
    totals, ev = c.totals.first(), c.evaluation.first()
    assert totals["compressed_tokens"] <= 60 and 0 <= totals["compression_ratio"] <= 1 and 0 <= ev["quality_score"] <= 1
    assert ev["contradictions"] == 1
    snap = c.snapshots(as_of)[0].first()
    assert snap["primary_goal"] == "Summarization" and "Current User State" in snap["final_context"]


def test_offline_pass_runs_whole(spark, memories, empty_concepts, empty_traits, as_of):
    m = memories({"content": "User prefers Vue for frontend work", "memory_type": "identity", "last_accessed": days_ago(80)}, {"content": "User prefers React for frontend work", "memory_type": "identity"},
                 {"content": "security encryption authentication vulnerability"})
    concepts = spark.createDataFrame([(i, 1, n, "d " + n, 0.6 + i / 100, 3, [i], False, AS_OF, AS_OF) for i, n in enumerate(["distributed systems", "tea ceremony", "garden tools"])], empty_concepts.schema)
    traits = spark.createDataFrame([(1, 1, "interest", "react", 0.9, 0.9, 5, 5, 0.02, False, [1], days_ago(90), days_ago(60))]
                                   + [(i, 1, "interest", v, 0.8, 0.1, 3, 2, 0.02, False, [i], days_ago(2), days_ago(1)) for i, v in enumerate(["kernel", "compilers", "schedulers"], 2)], empty_traits.schema)
    edges = spark.createDataFrame([(1, "a", "b", "related_to", 0.5, 2)], "user_id long, src string, dst string, type string, strength double, evidence_count long")
    vectors = spark.createDataFrame([(1, [1.0])], "memory_id long, embedding array<double>")
    o = OF.offline_pass(m, vectors, concepts, traits, edges, as_of)
    s = o.session.first()
    assert s["contradictions_resolved"] == 1 and s["identity_shifts"] == 1 and s["knowledge_synthesized"] == 1 and s["patterns_discovered"] == 1
    assert o.edges.first()["strength"] == pytest.approx(0.55)
    assert o.vectors.count() == 0  # its memory was superseded


def test_trait_shift_needs_established_and_recent(spark, empty_traits, as_of):
    recent = [(i, 1, "interest", f"t{i}", 0.8, 0.1, 3, 2, 0.02, False, [i], days_ago(2), days_ago(1)) for i in range(3)]
    assert I.identity_shifts(spark.createDataFrame(recent, empty_traits.schema), as_of).count() == 0


def test_monthly_cap_resets_and_spares_the_unverified(spark):
    use = lambda t, y, m, n: [(t, dt.datetime(y, m, 1 + i % 27, i % 24, i % 60)) for i in range(n)]
    usage = spark.createDataFrame(use(1, 2024, 1, 201) + use(1, 2024, 2, 3) + use(2, 2024, 1, 250), "tenant_id long, ts timestamp")
    tenants = spark.createDataFrame([(1, True), (2, False)], "tenant_id long, verified boolean")
    got = {(r["tenant_id"], r["month"].month): (r["breached"], r["refused"]) for r in A.monthly_usage(usage, tenants).collect()}
    assert got == {(1, 1): (True, 1), (1, 2): (False, 0), (2, 1): (False, 0)}


def test_sixth_attempt_in_a_day_is_flagged(spark):
    tries = spark.createDataFrame([("ip", AS_OF + dt.timedelta(hours=i)) for i in range(6)] + [("ip", AS_OF + dt.timedelta(hours=40))], "ip string, ts timestamp")
    got = [r["blocked"] for r in A.rolling_attempts(tries, "ip").orderBy("second").collect()]
    assert got == [False] * 5 + [True, False]


def test_erasure_leaves_nothing(spark, memories):
    m = memories({"user_id": 1}, {"user_id": 2})
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "memory_id long, embedding array<double>")
    ids = spark.createDataFrame([(1,), (77,)], ["user_id"])
    kept, counts = ST.erase({"memories": m, "vectors": v}, ids, children={"vectors": ("memories", "memory_id")})
    assert [r["memory_id"] for r in kept["memories"].collect()] == [2] and [r["memory_id"] for r in kept["vectors"].collect()] == [2]
    assert {r["table_name"]: r["n_deleted"] for r in counts.collect()} == {"memories": 1, "vectors": 1}


# ---- streams equal batches ---------------------------------------------------------
@pytest.fixture(scope="module")
def events(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, 1 + i % 3, AS_OF + dt.timedelta(minutes=7 * i), "error" if i % 4 == 0 else "view", float(i), i % 5, i % 2) for i in range(120)]
    # a far later row pushes the watermark past every window above
    rows.append((999, 9, AS_OF + dt.timedelta(days=9), "view", 0.0, 0, 0))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, memory_id long, tenant_id long")
    df.coalesce(1).write.parquet(folder + "/events")
    return folder + "/events"


def run_stream(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("job", ["hourly_users", "sessions", "service_rates"])
def test_stream_equals_batch(spark, events, job):
    schema = spark.read.parquet(events).schema
    fn = getattr(J, job)
    batch, stream = fn(spark.read.parquet(events)), run_stream(fn(spark.readStream.schema(schema).parquet(events)), "append", f"s_{job}")
    key = [c for c in batch.columns if c != "quantiles"]
    closed = [tuple(r) for r in stream.select(*key).collect()]
    every = [tuple(r) for r in batch.filter("user_id <> 9" if "user_id" in batch.columns else "end < timestamp'2024-02-05'").select(*key).collect()]
    assert sorted(map(str, closed)) == sorted(map(str, every)) and closed


def test_stream_counts_reinforcement_once_per_event(spark, events, memories):
    m = memories(*[{"memory_id": i, "memory_strength": 0.2} for i in range(5)])
    schema = spark.read.parquet(events).schema
    stream = run_stream(J.running_reinforcement(spark.readStream.schema(schema).parquet(events), m), "complete", "s_reinforce")
    batch = J.running_reinforcement(spark.read.parquet(events), m)
    cols = ["memory_id", "n", "memory_strength", "reinforcement_count", "cognitive_state"]
    assert sorted(map(str, stream.select(*cols).collect())) == sorted(map(str, batch.select(*cols).collect()))


def test_turns_are_scored_and_stored_as_they_arrive(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    turns = spark.createDataFrame([(1, 0, 5, "I always love my goal"), (1, 1, 5, "ok")], "conv_id long, turn long, user_id long, text string")
    turns.write.parquet(folder + "/in")
    J.ingest_stream(spark.readStream.schema(turns.schema).parquet(folder + "/in"), folder + "/out", folder + "/cp").awaitTermination(120)
    stored = {r["turn"]: round(r["importance_score"], 9) for r in spark.read.parquet(folder + "/out").collect()}
    assert stored == {r["turn"]: round(r["importance_score"], 9) for r in J.score_turns(turns).collect()}


def test_arriving_query_revives_a_sleeping_row(spark, memories, empty_concepts, empty_traits, as_of):
    m = memories({"content": "react frontend development preferences architecture", "cognitive_state": "dormant", "memory_type": "procedural", "importance_score": 0.9, "memory_strength": 0.5, "reinforcement_score": 0.9})
    q = understand(spark.createDataFrame([(1, 1, "react frontend development")], "query_id long, user_id long, query string"))
    got = J.revivals(q, m, empty_traits, empty_concepts, as_of, 0.5).collect()
    assert [(r["memory_id"], r["new_state"], r["revival_count"]) for r in got] == [(1, "active", 1)]


def test_conversational_turns(spark, memories, empty_concepts, empty_traits, as_of):
    m = memories({"content": "User enjoys detailed architecture explanations", "memory_type": "procedural"})
    turns = spark.createDataFrame([(1, 0, 1, AS_OF, "explain the architecture of my system design")], "conv_id long, turn long, user_id long, ts timestamp, text string")
    r = J.conversational_turns(turns, m, empty_traits, empty_concepts, as_of).first()
    assert r["goal"] == "system_design" and r["compressed_tokens"] > 0 and 0 <= r["quality_score"] <= 1


def test_conflicts_are_settled_among_the_candidates_of_a_query(spark, memories, as_of, monkeypatch):
    m = memories({"content": "prefers React for frontend work", "memory_strength": 0.9}, {"content": "prefers Vue for frontend work", "memory_strength": 0.6},
                 {"content": "prefers Angular for frontend work", "memory_strength": 0.3})
    useful = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)], "query_id long, memory_id long").join(m, "memory_id").withColumn("utility_score", F.lit(0.5))
    seen = {}

    def stop(kept, *a, **k):
        seen["kept"] = sorted((r["query_id"], r["memory_id"]) for r in kept.collect())
        raise StopIteration

    monkeypatch.setattr(CO, "scored_candidates", lambda *a, **k: (useful, useful))
    monkeypatch.setattr(CO, "knowledge_gaps", lambda *a, **k: None)
    monkeypatch.setattr(CO, "compress", stop)
    with pytest.raises(StopIteration):
        CO.compose(m, None, None, None, as_of)
    assert seen["kept"] == [(1, 1), (2, 2)]


def test_texts_are_not_written_for_every_query(spark, memories, empty_concepts, empty_traits, as_of, monkeypatch):
    """The rows of a user once went through every stage with their texts for each turn."""
    m = memories(*[{"content": f"note {i} about architecture and design {i * 7} " + "x" * 500, "memory_type": k} for i, k in enumerate(["semantic", "procedural", "identity"] * 4)],
                 *[{"content": "copies of one statement about design " + w, "summary": s, "memory_type": "concept"} for w, s in (("one", None), ("two", "in short."))])
    turns = spark.createDataFrame([(1, i, 1, AS_OF, f"explain the architecture of design {i}") for i in range(3)], "conv_id long, turn long, user_id long, ts timestamp, text string")
    written = []

    def seen(df):
        written.append(df.columns)
        return cut(df)

    cut = CO.cut
    monkeypatch.setattr(CO, "cut", seen)
    monkeypatch.setattr(RC, "cut", seen)
    rows = J.conversational_turns(turns, m, empty_traits, empty_concepts, as_of).collect()
    assert len(rows) == 3 and all(0 < r["compressed_tokens"] <= 800 < r["original_tokens"] for r in rows)
    per_query = [c for c in written if "query_id" in c and "memory_id" in c]
    assert per_query and not any({"content", "summary"} & set(c) for c in per_query)


def test_evolution_writes_no_texts(spark, memories, empty_concepts, empty_traits, as_of, monkeypatch):
    """Every stage once wrote all rows with their texts."""
    m = memories({"content": "Likes Rust"}, {"content": "Enjoys Rust"}, {"content": "User prefers Vue for frontend work", "memory_type": "identity", "last_accessed": days_ago(80)},
                 {"content": "User prefers React for frontend work", "memory_type": "identity", "summary": "React"}, {"content": "gone", "cognitive_state": "forgotten"})
    written, cut = [], EV.cut
    monkeypatch.setattr(EV, "cut", lambda df: written.append(df.columns) or cut(df))
    e = EV.evolve(m, empty_concepts, empty_traits, as_of)
    rows = {r["memory_id"]: r for r in e.memories.collect()}
    assert written and not any({"content", "summary"} & set(c) for c in written)
    assert {i: r["content"] for i, r in rows.items()} == {r["memory_id"]: r["content"] for r in m.collect()} and rows[4]["summary"] == "React"
    assert rows[1]["cognitive_state"] == rows[2]["cognitive_state"] == rows[3]["cognitive_state"] == "archived" and "React" in rows[3]["archive_reason"]
