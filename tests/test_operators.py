"""Pair joins, greedy choice, clusters and graphs against brute force on small inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import days_ago
from engram.functions import text as T
from engram import vocab as V
from engram.operators import clusters as C
from engram.operators import extract as X
from engram.operators import graph as G
from engram.operators import greedy, packing
from engram.operators import pairs as PR
from engram.operators.density import density_clusters


@pytest.fixture(scope="module")
def word_rows():
    rng = random.Random(3)
    rows = [(u, i + 100 * u, sorted({f"w{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randint(0, 14))})) for u in (1, 2) for i in range(40)]
    rows += [(3, 1000 + i, ["a", "b", "c"]) for i in range(25)]  # one hot group of copies
    return rows


@pytest.mark.parametrize("measure", ["jaccard", "overlap"])
@pytest.mark.parametrize("threshold", [0.4, 0.8])
@pytest.mark.parametrize(("per_task", "cells"), [(4000, 1 << 24), (3, 0), (4000, 900)])
def test_word_pairs_equal_brute_force(spark, word_rows, measure, threshold, per_task, cells, monkeypatch):
    monkeypatch.setattr(PR, "POSTINGS_PER_TASK", per_task)  # 3 forces blocks
    df = spark.createDataFrame(word_rows, "user_id long, id long, words array<string>")
    got = {(r["id_a"], r["id_b"]): (r["shared"], round(r["score"], 9), r["n_a"], r["n_b"]) for r in PR.word_pairs(df, ["user_id"], "id", "words", threshold, measure, cells).collect()}
    want = {}
    for (u, i, a), (v, j, b) in itertools.combinations(sorted(word_rows, key=lambda r: r[1]), 2):
        if u != v or not a or not b:
            continue
        shared = len(set(a) & set(b))
        score = shared / (len(set(a) | set(b)) if measure == "jaccard" else min(len(a), len(b)))
        if score >= threshold - 1e-12:
            want[(i, j)] = (shared, round(score, 9), len(a), len(b))
    assert got == want


@pytest.mark.parametrize("block", [1024, 4])
def test_vector_pairs_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(PR, "VECTORS_PER_BLOCK", block)  # 4 forces several blocks per group
    rng = np.random.default_rng(1)
    rows = [(u, u * 100 + i, rng.normal(size=3).tolist()) for u in (1, 2) for i in range(17)] + [(1, 500, [0.0, 0.0, 0.0]), (1, 501, [1.0])]
    df = spark.createDataFrame(rows, "user_id long, id long, embedding array<double>")
    got = {(r["id_a"], r["id_b"]) for r in PR.vector_pairs(df, ["user_id"], "id", 0.7).collect()}
    want = set()
    for (u, i, a), (v, j, b) in itertools.combinations(rows, 2):
        if u == v and len(a) == len(b) and np.linalg.norm(a) * np.linalg.norm(b) > 0 and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.7:
            want.add((min(i, j), max(i, j)))
    assert got == want


def _greedy(nodes, edges):
    kept, lost = [], {}
    for n in nodes:
        before = [k for k in kept if frozenset((k, n)) in edges]
        if before:
            lost[n] = min(before)
        else:
            kept.append(n)
    return lost


def test_losers_equal_taking_rows_one_by_one(spark):
    rng = random.Random(5)
    edges = {frozenset(rng.sample(range(60), 2)) for _ in range(150)} | {frozenset((100, i)) for i in range(101, 140)} | {frozenset((i, i + 1)) for i in range(200, 230)}
    df = spark.createDataFrame([(min(e), max(e), min(e)) for e in edges], "first long, second long, rank long")
    got = {r["loser"]: r["winner"] for r in greedy.losers(df).collect()}
    assert got == _greedy(sorted({n for e in edges for n in e}), edges)
    assert greedy.losers(df.limit(0)).count() == 0


def test_near_copies_keep_the_better(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.4), (2, 3, 0.4), (2, 4, 0.1)], "query_id long, memory_id long, utility_score double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    got = {(r[0], r[1]) for r in packing.drop_near_copies(rows, pairs, ["query_id"], "memory_id", "utility_score").select("query_id", "memory_id").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4)}


def test_four_rust_notes_become_one_concept(memories, as_of):
    m = memories({"content": "Likes Rust"}, {"content": "Enjoys Rust"}, {"content": "Interested in Rust"}, {"content": "Learning Rust"},
                 {"content": "Visited Paris in spring"}, {"content": "Favourite soup is miso"})
    members = C.duplicate_clusters(m)
    assert sorted(r["memory_id"] for r in members.collect()) == [1, 2, 3, 4]
    after, made, evidence, events = C.merge_duplicates(m, members, as_of)
    c = made.collect()
    assert [(r["concept_name"], r["support_count"], round(r["confidence"], 6)) for r in c] == [("Rust Interest", 4, 0.9)]
    assert evidence.count() == 4 and events.count() == 4
    states = {r["memory_id"]: r["cognitive_state"] for r in after.collect()}
    assert [states[i] for i in range(1, 7)] == ["archived"] * 4 + ["active"] * 2


def test_contradicting_claims_are_not_merged(memories):
    m = memories({"content": "prefers Angular for frontend work"}, {"content": "prefers React for frontend work"})
    assert C.duplicate_clusters(m).count() == 0


def test_a_word_in_every_row_of_a_hot_user(spark):
    """A user with a third of all rows, one word in each of them and many copies: blocks bound what meets, copies do not multiply."""
    hot = spark.range(6_000).select(F.lit(1).alias("user_id"), "id", F.array(F.lit("all"), F.concat(F.lit("a"), F.col("id") % 900), F.concat(F.lit("b"), F.col("id") % 900), F.lit("too")).alias("words"))
    rest = spark.range(12_000).select((2 + F.col("id") % 3_000).alias("user_id"), (F.col("id") + 6_000).alias("id"), F.array(F.concat(F.lit("w"), F.col("id") % 7), F.lit("x")).alias("words"))
    _, base = PR.distinct_sets(hot.unionByName(rest), ["user_id"], "id", "words")
    assert base.filter("user_id = 1").count() == 900
    pairs = PR.distinct_pairs(base, ["user_id"], 0.75, "overlap", cells_in_task=1_000).filter("user_id = 1")
    assert pairs.count() == 0 and PR.distinct_pairs(base, ["user_id"], 0.5, "overlap", cells_in_task=1_000).filter("user_id = 1").count() == 900 * 899 // 2


def test_conflicts_are_counted_from_different_sets(spark, memories):
    m = memories(*[{"content": "prefers Angular for frontend work"}] * 5, *[{"content": "prefers React for frontend work"}] * 3, {"content": "likes tea"})
    counts, rows = PR.contradictions(m)
    assert [r["conflict_count"] for r in counts.collect()] == [15] == [PR.contradictory_pairs(m).count()]
    assert sorted(r["memory_id"] for r in rows.collect()) == list(range(1, 9))


def test_a_hot_group_is_one_cluster(spark):
    df = spark.range(5_000).select(F.lit(1).alias("user_id"), "id", F.array(F.lit("rust"), F.lit("go"), F.concat(F.lit("x"), F.col("id") % 3)).alias("words"))
    got = C.leader_clusters(df, ["user_id"], "id", "words", 0.4)
    assert got.count() == 5_000 and got.select("cluster_id").distinct().count() == 1


def test_two_tight_vector_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, (np.array([1.0, 0, 0]) + rng.normal(size=3) * 0.02).tolist()) for i in range(5)]
    rows += [(1, 10 + i, (np.array([0, 1.0, 0]) + rng.normal(size=3) * 0.02).tolist()) for i in range(4)] + [(1, 99, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "user_id long, memory_id long, embedding array<double>")
    members = density_clusters(df, ["user_id"], "memory_id", V.CLUSTER_AT)
    got = {r["memory_id"]: r["cluster_id"] for r in members.collect()}
    assert got == {**{i: 0 for i in range(5)}, **{10 + i: 10 for i in range(4)}}
    stats = {r["cluster_id"]: r for r in C.cluster_metrics(members, df).collect()}
    v = np.array([r[2] for r in rows[:5]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert stats[0]["member_count"] == 5 and stats[0]["avg_similarity"] == pytest.approx(np.mean((v @ v.T)[np.triu_indices(5, 1)]))


def test_blocks_too_far_apart_do_not_meet(spark, monkeypatch):
    """Clustered vectors of one hot user: most pairs of blocks are skipped, and no pair of rows is lost."""
    monkeypatch.setattr(PR, "VECTORS_PER_BLOCK", 40)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(20, 16))
    rows = [(1, i, (middles[i % 20] + rng.normal(size=16) * 0.08).tolist()) for i in range(1_200)] + [(1, 5_000, [0.0] * 16), (1, 5_001, [1.0, 2.0]), (2, 5_002, [1.0] * 16)]
    df = spark.createDataFrame(rows, "user_id long, id long, embedding array<double>")
    got = {(r["id_a"], r["id_b"]) for r in PR.vector_pairs(df, ["user_id"], "id", 0.9).collect()}
    m = np.array([r[2] for r in rows[:1_200]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.9, 1)))}
    placed, meetings = PR.vector_blocks(df.select("user_id", "id", F.col("embedding").alias("v")), ["user_id"], 0.9)
    blocks, met = placed.filter("user_id = 1").select("block").distinct().count(), meetings.filter("user_id = 1").count()
    assert placed.count() == len(rows)
    assert met < 0.3 * blocks * (blocks + 1) / 2


# ---- graphs --------------------------------------------------------------------
EDGES = [(1, "a", "b", "uses", 0.5), (1, "b", "c", "depends_on", 0.5), (1, "a", "d", "related_to", 0.9), (1, "d", "c", "uses", 0.2), (1, "e", "a", "blocks", 0.8), (2, "a", "b", "uses", 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "user_id long, src string, dst string, type string, strength double").withColumn("evidence_count", F.lit(1).cast("long"))


@pytest.fixture(scope="module")
def nodes(edges):
    return edges.select("user_id", F.col("src").alias("node_id")).unionByName(edges.select("user_id", F.col("dst").alias("node_id"))).distinct().withColumn("confidence", F.lit(0.5))


def test_dependencies_follow_dependency_edges_only(spark, edges):
    src = spark.createDataFrame([(1, "a")], ["user_id", "node_id"])
    assert {(r["node"], r["depth"]) for r in G.dependencies(src, edges).collect()} == {("b", 1), ("c", 2)}
    assert {r["node"] for r in G.affected(src, edges).collect()} == {"e"}


def test_shortest_path_and_explanation(spark, edges):
    pair = spark.createDataFrame([(1, "c", "e")], "user_id long, source string, target string")
    assert G.shortest_paths(pair, edges).count() == 0
    hops = G.explain_paths(pair, edges).orderBy("hop").collect()
    assert [(h["a"], h["b"], h["direction"]) for h in hops] == [("c", "b", "backward"), ("b", "a", "backward"), ("a", "e", "backward")]


def test_components_partition_the_nodes(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(edges, "src long, dst long")
    vertices = spark.range(600)
    got = {r["id"]: r["component"] for r in G.connected_components(df, vertices).collect()}
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(600)}


def test_pagerank_sums_to_one_per_user(nodes, edges):
    ranks = G.pagerank(nodes, edges, iterations=60)
    for r in ranks.groupBy("user_id").agg(F.sum("rank").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0, abs=1e-6)


def test_ranks_stop_when_each_graph_has_settled(spark):
    """In one task, in rounds of joins and by hand: a chain that takes long, a ring that settles at once, lone nodes."""
    rng = random.Random(5)
    graphs = {1: (12, [(i, i + 1, 1.0) for i in range(11)]), 2: (5, [(i, (i + 1) % 5, 0.3) for i in range(5)]), 3: (3, []),
              4: (30, [(rng.randrange(30), rng.randrange(30), rng.random()) for _ in range(90)])}
    n = spark.createDataFrame([(u, i) for u, (k, _) in graphs.items() for i in range(k)], "user_id long, node_id long")
    e = spark.createDataFrame([(u, *x) for u, (_, es) in graphs.items() for x in es], "user_id long, src long, dst long, strength double")
    want = {}
    for u, (k, es) in graphs.items():
        m = np.zeros((k, k))
        for a, b, w in es:
            m[a, b] += w
        out = m.sum(axis=1)
        m = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
        r = np.full(k, 1 / k)
        for _ in range(40):
            new = 0.85 * (r @ m + r[out == 0].sum() / k) + 0.15 / k
            moved, r = np.abs(new - r).sum(), new
            if moved < k * 1e-3:
                break
        want |= {(u, i): round(float(x), 9) for i, x in enumerate(r)}
    for bound in (1 << 18, 20, 0):
        got = {(r["user_id"], r["node_id"]): round(r["rank"], 9) for r in G.pagerank(n, e, 40, tolerance=1e-3, edges_in_task=bound).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_betweenness_counts_lightest_paths(spark):
    # a-b-d and a-c-d weigh the same, so b and c carry half each; e hangs behind d
    rows = [(1, "a", "b", 1.0), (1, "b", "d", 1.0), (1, "a", "c", 1.0), (1, "c", "d", 1.0), (1, "d", "e", 1.0)]
    e = spark.createDataFrame(rows, "user_id long, src string, dst string, strength double")
    n = spark.createDataFrame([(1, x) for x in "abcde"], "user_id long, node_id string")
    got = {r["node_id"]: round(r["betweenness"] * 12, 6) for r in G.betweenness(n, e).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 3.0, "e": 0.0}


def betweenness_by_hand(nodes, edges):
    """Over all simple paths, lightest first and then fewest edges of weight zero."""
    best = {}
    for a, b, w in edges:
        if a != b:
            best[a, b] = min(w, best.get((a, b), w))
    out, found = dict.fromkeys(nodes, 0.0), {}

    def walk(path, cost):
        found.setdefault((path[0], path[-1]), []).append((cost, path))
        for (a, b), w in best.items():
            if a == path[-1] and b not in path:
                walk([*path, b], (round(cost[0] + w, 9), cost[1] + (w == 0)))

    for n in nodes:
        walk([n], (0.0, 0))
    for paths in found.values():
        low = min(c for c, _ in paths)
        tied = [p for c, p in paths if c == low]
        for p in tied:
            for v in p[1:-1]:
                out[v] += 1 / len(tied)
    n = len(nodes)
    return {v: round(x / ((n - 1) * (n - 2)) if n > 2 else x, 6) for v, x in out.items()}


def test_betweenness_with_weights_of_zero_ends(spark):
    rng = random.Random(8)
    graphs = {1: (["a", "b", "c"], [("a", "b", 0.0), ("b", "a", 0.0), ("b", "c", 0.5), ("c", "c", 0.0)])}
    for u in range(2, 6):
        names = [f"n{i}" for i in range(6)]
        graphs[u] = (names, [(rng.choice(names), rng.choice(names), rng.choice([0.0, 0.0, 0.1, 0.2, 0.3])) for _ in range(14)])
    n = spark.createDataFrame([(u, x) for u, (ns, _) in graphs.items() for x in ns], "user_id long, node_id string")
    e = spark.createDataFrame([(u, *x) for u, (_, es) in graphs.items() for x in es], "user_id long, src string, dst string, strength double")
    want = {(u, v): x for u, (ns, es) in graphs.items() for v, x in betweenness_by_hand(ns, es).items()}
    got = {(r["user_id"], r["node_id"]): round(r["betweenness"], 6) for r in G.betweenness(n, e, batches=2).collect()}
    assert got == want


def test_distances_from_64_sources_at_once(spark):
    rng = random.Random(3)
    sizes = {1: 150, 2: 1, 3: 40}
    edges = {(u, rng.randrange(n), rng.randrange(n)) for u, n in sizes.items() for _ in range(2 * n)}
    n = spark.createDataFrame([(u, i) for u, k in sizes.items() for i in range(k)], "user_id long, node_id long")
    e = spark.createDataFrame(list(edges), "user_id long, src long, dst long")
    want = {}
    for u, k in sizes.items():
        total = pairs = 0
        for s in range(k):
            depth, front = {s: 0}, [s]
            while front:
                front = list({d for x, a, d in edges if x == u and a in front and d not in depth})
                depth |= {d: max(depth.values()) + 1 for d in front}
            total, pairs = total + sum(depth.values()), pairs + len(depth) - 1
        want[u] = (total, pairs)
    got = {r["user_id"]: (r["total"], r["pairs"]) for r in G.distance_sums(n, e).collect()}
    assert got == {u: v for u, v in want.items() if v[1]}


# ---- extraction -------------------------------------------------------------------
def test_world_model_sentences(spark):
    rows = [(1, 1, days_ago(3), "Started building Atlas. Atlas uses PostgreSQL and Redis."), (1, 2, days_ago(2), "We decided to keep Redis because it is fast. Atlas depends on Docker."),
            (1, 3, days_ago(1), "Working on Atlas. Currently implementing search. Next step is indexing.")]
    texts = spark.createDataFrame(rows, "user_id long, text_id long, ts timestamp, text string")
    found = X.entities(texts)
    names = {(r["entity_type"], r["name"]) for r in found.collect()}
    assert {("technology", "PostgreSQL"), ("technology", "Redis"), ("technology", "Docker"), ("project", "Atlas")} <= names
    assert ("project", "Redis") not in names
    rolled = {r["name"]: r for r in X.entity_rollup(found).collect()}
    assert rolled["Redis"]["mention_count"] == 2 and rolled["Redis"]["confidence"] == pytest.approx(0.85)
    rel = {(r["src"], r["dst"], r["type"]) for r in X.relations(texts, found).collect()}
    assert ("atlas", "postgresql", "uses") in rel and ("atlas", "docker", "depends_on") in rel
    assert not any(s == "postgresql" and d == "atlas" for s, d, _ in rel)
    project = {r["key"]: r for r in X.projects(texts, found).collect()}["atlas"]
    assert project["current_phase"] == "search" and project["next_step"] == "indexing" and project["status"] == "active"
    decision = X.decisions(texts).filter("text_id = 2").first()
    assert decision["status"] == "decided" and decision["decision"].startswith("keep Redis") and decision["reason"] == "it is fast"


def test_word_sets_use_unicode_letters(spark):
    df = spark.createDataFrame([("Über, die Straße été_1",)], ["t"])
    assert df.select(T.word_set(F.col("t"), ["die"])).first()[0] == ["über", "straße", "été_1"]
