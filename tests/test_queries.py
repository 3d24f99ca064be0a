"""Every registered query against its SQL check at the smallest scale."""

from __future__ import annotations

from types import SimpleNamespace

import duckdb
import pytest

from check import normal
from conftest import SMALL
from engram.catalog import all_oracles, all_queries, graphs, reports
from engram.catalog.views import BASE

# multi-stage jobs are exercised by test_plans on small fixtures
SLOW = {"g_06_betweenness", "p_03", "p_04", "p_05", "p_05_events", "p_06", "p_07", "p_15", "p_16", "src_12", "src_13", "src_16", "sc_68", "c_10", "a_13"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = normal([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    sql = all_oracles().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == normal([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_every_check_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


def test_settled_ranks(spark):
    """A long chain, a ring with a hub and a loose node, against power iteration that runs until nothing moves."""
    edges = [(1, i, i + 1, 1.0) for i in range(30)] + [(2, i, (i + 1) % 12, 0.5) for i in range(12)] + [(2, i, 0, 0.2) for i in range(2, 11)]
    nodes = sorted({(u, x) for u, a, b, _ in edges for x in (a, b)} | {(2, 99)})
    tables = SimpleNamespace(nodes_v=spark.createDataFrame(nodes, "user_id long, node_id long"), edges_v=spark.createDataFrame(edges, "user_id long, src long, dst long, strength double"))
    got = {(r.user_id, r.node_id): r["rank"] for r in graphs.g_05_settled(tables).collect()}
    assert sorted(got) == nodes
    for user in (1, 2):
        ids = [x for u, x in nodes if u == user]
        out = {x: sum(w for u, a, _, w in edges if u == user and a == x) for x in ids}
        rank = {x: 1 / len(ids) for x in ids}
        for _ in range(400):
            loose = sum(rank[x] for x in ids if not out[x])
            new = {x: (0.85 * loose + 0.15) / len(ids) for x in ids}
            for u, a, b, w in edges:
                if u == user:
                    new[b] += 0.85 * rank[a] * w / out[a]
            rank = new
        assert all(abs(got[user, x] - rank[x]) < len(ids) * 1e-6 for x in ids)


def test_word_sets_of_all_memories(spark):
    """Each memory meets all queries of its user, and stays when there is none."""
    tables = SimpleNamespace(memories_v=spark.createDataFrame([(900, 1, "Red fox, red hat"), (901, 2, "blue"), (902, 3, None)], "memory_id long, user_id long, content string"),
                             queries_v=spark.createDataFrame([(5, 1, "a red dog"), (6, 1, "hat"), (7, 3, "blue")], "query_id long, user_id long, query string"))
    got = {(r.memory_id, r.query_id): (r.n_both, r.n_only, r.n_union) for r in reports.set_04_user_queries(tables).collect()}
    assert got == {(900, 5): (1, 2, 5), (900, 6): (1, 2, 3), (901, None): (0, 1, 1), (902, 7): (0, 0, 1)}
