"""Cases in which results once differed from their SQL, and graphs searched in tasks."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check import normal
from conftest import SMALL
from engram.catalog import graphs, reports, views
from engram.functions import relevance as R
from engram.functions import text as T
from engram.operators import graph as G
from engram.operators import leaders as LD
from engram.operators import local as L
from engram.operators import packing as K
from engram.operators import utility as UT
from engram.streaming import jobs as J


def test_first_letter_is_raised_to_one_character(spark):
    rows = spark.createDataFrame([("ßheit und mehr",), ("über",), ("ŉ x",), ("ᾳ",), ("\U00010428",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(T.shorten(rows.text)).collect()] == ["ẞheit und mehr", "Über", "ŉ x", "ᾼ", "\U00010400", "", ""]


def test_active_project_of_equal_dates(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(7, 99_999, day), (7, 100_001, day), (8, 5, day), (8, 100_004, day + dt.timedelta(days=1)), (9, 100_003, day), (9, 3, day)]
    tables = SimpleNamespace(projects_v=spark.createDataFrame(rows, "user_id long, project_id long, updated_at timestamp"))
    assert {tuple(r) for r in reports.w_05(tables).collect()} == {(7, 99_999), (8, 100_004), (9, 3)}


def test_an_event_at_the_end_of_a_session_starts_the_next(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, t0 + dt.timedelta(seconds=s)) for u, s in ((1, 0), (1, 900), (2, 0), (2, 899), (2, 2000))]
    got = {(r.user_id, (r.started - t0).total_seconds(), (r.idle_from - t0).total_seconds(), r.n)
           for r in J.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp")).collect()}
    assert got == {(1, 0, 900, 1), (1, 900, 1800, 1), (2, 0, 1799, 2), (2, 2000, 2900, 1)}


def random_graphs(spark):
    """Rings, loops, parallel edges, lone nodes and edges without an end, for three users and some that have no user."""
    rng = random.Random(11)
    edges = [(u, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["uses", "reinforces", "related_to"]), rng.choice([0.0, 0.2, 0.5, 0.9, None]))
             for u, n in ((1, 9), (2, 5), (3, 12)) for _ in range(14)] + [(1, "n0", None, "uses", 0.5), (None, "n0", "n1", "uses", 0.5)]
    nodes = [(u, f"n{i}", rng.choice([0.3, 0.8, 1.0])) for u, n in ((1, 9), (2, 5), (3, 13)) for i in range(n)]
    return (spark.createDataFrame(nodes, "user_id long, node_id string, importance double"),
            spark.createDataFrame(edges, "user_id long, src string, dst string, type string, strength double"))


SEARCHES = {
    "reach": lambda n, e: G.reach(n, e, None, with_path=True),
    "reach_two": lambda n, e: G.reach(n, e, 2),
    "related": lambda n, e: G.related(n, e, n, 2),
    "paths": lambda n, e: G.shortest_paths(both(n), e),
    "explained": lambda n, e: G.explain_paths(both(n), e.filter("strength > 0")),
    "ego": lambda n, e: G.ego_graph(n, e, 1)[1],
    "components": G.components,
    "closeness": G.closeness,
    "betweenness": G.betweenness,
    "statistics": G.statistics,
    "confidence": lambda n, e: G.spread_confidence(n, e),
    "importance": lambda n, e: G.spread_importance(n, e),
}


def both(n):
    return n.select("user_id", F.col("node_id").alias("source")).join(n.select("user_id", F.col("node_id").alias("target")), "user_id")


@pytest.mark.parametrize("name", SEARCHES)
def test_graphs_in_tasks_equal_graphs_in_joins(spark, name, monkeypatch):
    nodes, edges = random_graphs(spark)

    def rows():
        df = SEARCHES[name](nodes, edges)
        return normal([tuple(r) for r in df.select(*sorted(df.columns)).collect()])

    monkeypatch.setattr(L, "CELLS_AT_ONCE", 100)  # some graphs at a time
    inside = rows()
    monkeypatch.setattr(L, "ROWS_IN_TASK", 30)  # the smallest in tasks, the others by joins
    mixed = rows()
    monkeypatch.setattr(L, "ROWS_IN_TASK", 0)
    assert inside and inside == rows() == mixed


def test_many_graphs_are_ranked_at_once(spark):
    """A call per graph once made the time, and an edge without a weight had no rank as its end."""
    nodes, edges = random_graphs(spark)
    edges = edges.unionByName(spark.createDataFrame([(1, "n0", "n1", "uses", None), (1, "n0", None, "uses", 0.4), (4, "n0", "n1", "uses", 0.4)], edges.schema))

    def ranks(bound):
        return {(r.user_id, r.node_id): round(r["rank"], 9) for r in G.pagerank(nodes, edges, tolerance=1e-2, edges_in_task=bound).collect()}

    inside = ranks(1 << 18)
    assert len(inside) == 27 and inside == pytest.approx(ranks(20))  # the second graph in a task, the others by joins
    plan = G.pagerank(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and "MapInArrow" in plan


def test_searches_take_few_jobs(spark):
    """A chain of 60 nodes once took a round of joins per step."""
    edges = spark.createDataFrame([(1, i, i + 1, 0.5) for i in range(60)], "user_id long, src long, dst long, strength double")
    nodes = spark.createDataFrame([(1, i) for i in range(61)], "user_id long, node_id long")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.node_id: r.closeness for r in G.closeness(nodes, edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20
    assert got[60] == pytest.approx(60 / sum(range(1, 61))) and got[0] == 0


def test_large_order_lines_are_not_broadcast(spark, monkeypatch):
    want = normal([tuple(r) for r in views.Tables(spark, SMALL).edges_v.collect()])
    monkeypatch.setattr(views, "portions", lambda *a: 5)
    lines = views.Tables(spark, SMALL)
    assert normal([tuple(r) for r in lines.edges_v.collect()]) == want
    assert "BroadcastHashJoin" not in lines.edges_v._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sources", [None, {"n0", "n2", "n5"}])
@pytest.mark.parametrize("ends", [None, {"n1", "n4"}])
@pytest.mark.parametrize("bound", [1 << 11, 16, 0])
def test_simple_paths_in_tasks_and_in_joins(spark, monkeypatch, sources, ends, bound):
    """Each path without a repeated node once, against a walk over all of them; sources and ends may repeat or be no node."""
    nodes, edges = random_graphs(spark)
    edges = edges.unionByName(edges)
    pick = lambda names: None if names is None else nodes.filter(F.col("node_id").isin(*names)).unionByName(nodes).filter(F.col("node_id").isin(*names))
    steps = {(r.user_id, r.src, r.dst) for r in edges.collect() if None not in (r.user_id, r.src, r.dst)}
    want, front = set(), {(u, (a,)) for u, a, _ in steps if sources is None or a in sources}
    for _ in range(4):
        front = {(u, (*path, b)) for u, path in front for v, a, b in steps if v == u and a == path[-1] and b not in path}
        want |= {(u, path) for u, path in front if ends is None or path[-1] in ends}
    monkeypatch.setattr(L, "CELLS_AT_ONCE", 100)
    monkeypatch.setattr(L, "ROWS_IN_TASK", bound)
    got = [(r.user_id, r.source, r.target, tuple(r.path)) for r in G.simple_paths(pick(sources), edges, 4, pick(ends)).collect()]
    assert want and sorted(got) == sorted((u, path[0], path[-1], path) for u, path in want)


def test_simple_paths_of_a_crowded_graph_come_in_pieces(spark):
    """40 nodes that all lead to each other have 59,280 paths of two steps; a task puts off pieces of them."""
    edges = spark.range(40).select(F.lit(1).alias("user_id"), F.col("id").alias("src")).crossJoin(spark.range(40).select(F.col("id").alias("dst"))).filter("src <> dst")
    paths = G.simple_paths(None, edges, 3)
    assert {r.n: r["count"] for r in paths.groupBy(F.size("path").alias("n")).count().collect()} == {2: 1560, 3: 59280, 4: 2193360}


def test_paths_read_the_order_lines_once(spark, monkeypatch):
    """Each step of a path once read them anew: six joins of lines and parts for three steps and their ends."""
    read = []
    monkeypatch.setattr(views, "cut", lambda df: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    tables = views.Tables(spark, SMALL)
    nodes, edges = tables.walks
    assert len(read) == 1 and read[0].count("l_orderkey") and read[0].count("Relation [l_orderkey") == 1
    same = lambda a, b: normal([tuple(r) for r in a.collect()]) == normal([tuple(r) for r in b.collect()])
    assert same(nodes.distinct(), tables.nodes_v.select("user_id", "node_id")) and same(edges, tables.edges_v.select("user_id", "src", "dst"))
    plan = graphs.g_04(views.Tables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_words_in_texts_by_bytes_equal_a_search():
    """Null, empty and long words, letters of two bytes, words within words and across them; rows that share their items and rows that do not."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé -ß0_") for _ in range(rng.randrange(0, n)))
    lists = [None if rng.random() < 0.05 else [None if rng.random() < 0.05 else [None if rng.random() < 0.05 else word(8) for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 20))]
             for _ in range(60)]
    texts = [None if rng.random() < 0.1 else word(80) for _ in range(600)]
    items = [lists[i // 10] for i in range(600)]
    got = R.contained.func(pa.array(texts, pa.string()), pa.array(items, pa.list_(pa.list_(pa.string())))).to_pylist()
    assert got == [[t is not None and any(w is not None and w in t for w in x or []) for x in i or []] for t, i in zip(texts, items)]
    assert 500 < sum(map(sum, got))


@pytest.mark.parametrize("at_once", [64, 2])
def test_texts_are_searched_once_for_all_queries(spark, memories, as_of, monkeypatch, at_once):
    """Every query once searched the texts of its user anew. Keywords may repeat, a text or a list may be null, a user may hold no traits or concepts."""
    monkeypatch.setattr(UT, "QUERIES_AT_ONCE", at_once)
    rows = memories(*[{"user_id": u, "content": c, "memory_type": k} for u in (1, 2, 3) for c, k in (
        ("Learning Rust and Großes systems", "identity"), ("cache_key rules for Redis caches", "concept"), (None, "procedural"), ("", "semantic"), ("rust-belt travel to Lyon", "procedural"))])
    queries = spark.createDataFrame([(i, 1 + i % 3, "g", kw, need) for i, (kw, need) in enumerate([
        (["rust", "rust", "systems"], ["cache_design", "travel"]), ([], []), (["red", "los"], ["großes"]), (["key", "nothing"], None), (["lyon"], ["a__b"]), (["belt", "caches"], ["system_design"])] * 3)],
        "query_id long, user_id long, goal string, keywords array<string>, required_knowledge array<string>")
    traits = spark.createDataFrame([(1, 1, "interest", "Rust", 0.9, 0.5), (2, 1, "skill", "", 0.8, 0.4), (3, 1, "skill", "Go", 0.5, 0.3), (4, 2, "goal", "travel", None, 0.3)],
                                   "node_id long, user_id long, node_type string, node_value string, confidence double, importance double")
    concepts = spark.createDataFrame([(1, 1, "cache_keys", "", 0.5, 1), (2, 1, "Belt", "", None, 1), (3, 3, "", "", 0.7, 1), (4, 3, "red systems", "", 0.6, 1)],
                                     "concept_id long, user_id long, concept_name string, description string, confidence double, support_count int")
    scored = UT.score_utility(rows, queries, traits, concepts, as_of)
    assert "Contains(" not in scored._jdf.queryExecution().analyzed().toString() and "contains(lower" not in scored._jdf.queryExecution().optimizedPlan().toString().lower()
    dims = ["goal_alignment", "identity_alignment", "concept_relevance"]
    direct = rows.join(UT.user_traits(traits), "user_id", "left").join(UT.user_concepts(concepts), "user_id", "left").join(queries, "user_id").select(
        "query_id", "memory_id", R.goal_alignment(rows.content, rows.memory_type, F.col("keywords"), F.col("required_knowledge")).alias(dims[0]),
        R.identity_alignment(rows.content, rows.memory_type, F.col("traits")).alias(dims[1]), R.concept_relevance(rows.content, rows.memory_type, F.col("concepts")).alias(dims[2]))
    got, want = (sorted(tuple(r) for r in df.select("query_id", "memory_id", *dims).collect()) for df in (scored, direct))
    assert got == want and len({r[2] for r in got}) > 4


def test_groups_settled_in_bits_equal_groups_settled_by_words(monkeypatch):
    rng = np.random.default_rng(5)
    for n in range(60):
        monkeypatch.setattr(LD, "WORDS_IN_BITS", 1 << 14 if n % 2 else 4)
        sets = [rng.choice(30, rng.integers(0, 9), replace=False) for _ in range(rng.integers(1, 25))]
        for threshold in (0.0, 0.3, 0.5, 1.0):
            assert LD.settle_in_bits(sets, 30, threshold) == LD.settle([s.tolist() for s in sets], threshold, False)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_knapsacks_are_packed_at_once(spark, kind):
    """A call of Python for each query once made the time. Rows of equal value go by id, rows that do not fit at all are out."""
    rng = random.Random(9)
    rows = [(q, i if kind == "long" else f"m{i:02}", rng.choice([0.2, 0.4, 0.7]), rng.randrange(1, 14)) for q in range(40) for i in range(rng.randrange(1, 9))]
    chosen = K.optimize_budget(spark.createDataFrame(rows, f"query_id long, id {kind}, utility_score double, token_cost int"), "query_id", "id", 12)
    assert "InPandas" not in chosen._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in chosen.collect():
        got.setdefault(r.query_id, []).append((r.id, r.utility_score, r.token_cost))
    for q in range(40):
        mine = [r[1:] for r in rows if r[0] == q]
        subsets = [[x for i, x in enumerate(mine) if m >> i & 1] for m in range(1 << len(mine))]
        best = max(sum(v for _, v, _ in s) for s in subsets if sum(c for _, _, c in s) <= 12)
        assert sum(c for _, _, c in got.get(q, [])) <= 12 and sum(v for _, v, _ in got.get(q, [])) == pytest.approx(best)
