"""Grouping with pooled words against the sequential rule."""

from __future__ import annotations

import numpy as np
import pytest

from engram import vocab as V
from engram.operators import clusters as C
from engram.operators import leaders as L
from engram.operators.leaders import leaders


def by_hand(rows, threshold, apart):
    """{id: leader} for rows (id, words) in order."""
    def against(a, b):
        shared = len(a & b)
        return shared >= 2 and len(a) > shared and len(b) > shared and shared / min(len(a), len(b)) >= V.CONTRADICT_AT

    groups, home = [], {}
    for i, words in rows:
        for group in groups:
            pool = group["words"]
            if words and pool and len(words & pool) / min(len(words), len(pool)) >= threshold and not (apart and any(against(words, o) for o in group["rows"])):
                break
        else:
            group = {"leader": i, "words": set(), "rows": []}
            groups.append(group)
        group["words"] |= words
        group["rows"].append(words)
        home[i] = group["leader"]
    return home


def table(spark, users):
    rows = [(u, i, sorted(w)) for u, rs in users.items() for i, w in rs]
    return spark.createDataFrame(rows, "user_id long, id long, words array<string>").repartition(4)


def drawn(seed, n, words, most):
    rng = np.random.default_rng(seed)
    return [(i, {f"w{x}" for x in rng.integers(0, words, rng.integers(0, most))}) for i in range(n)]


@pytest.mark.parametrize(("apart", "in_task"), [(True, 1 << 18), (True, 150), (False, 0)])
def test_groups_of_any_size_follow_the_sequential_rule(spark, apart, in_task):
    users = {u: drawn(u, 50, 12 + 25 * u, 8) for u in range(3)}
    users[7] = [(i, {"rust", "go", f"x{i % 3}"}) for i in range(60)]
    got = {(r.user_id, r.id): r.leader for r in leaders(table(spark, users), ["user_id"], "id", "words", "id", 0.4, apart, in_task).collect()}
    assert got == {(u, i): leader for u, rows in users.items() for i, leader in by_hand(rows, 0.4, apart).items()}


def test_five_thousand_rows_in_one_group(spark):
    """Rows of one user in rounds: topics that grow into each other, with copies and rows without words."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(5_000):
        topic = int(rng.integers(0, 150))
        rows.append((i, {f"t{topic}_{x}" for x in rng.integers(0, 9, rng.integers(1, 6))} | ({f"n{rng.integers(0, 4000)}"} if i % 3 == 0 else set())))
    rows[100:400] = [(i, {"same", "words", "again"}) for i in range(100, 400)]
    rows[700] = (700, set())
    got = {r.id: r.leader for r in leaders(table(spark, {1: rows}), ["user_id"], "id", "words", "id", 0.5, words_in_task=1_000).collect()}
    assert got == by_hand(rows, 0.5, False)


def test_pooled_words_draw_in_rows_the_leader_does_not_overlap(spark):
    rows = [(1, {"a", "b"}), (2, {"b", "c"}), (3, {"c", "d"}), (4, {"d", "e"}), (5, {"x", "y"})]
    got = {r.id: r.cluster_id for r in C.leader_clusters(table(spark, {1: rows}), ["user_id"], "id", "words", 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_no_rows(spark):
    assert leaders(table(spark, {}), ["user_id"], "id", "words", "id", 0.4).collect() == []


def test_groups_of_any_key_are_walked_many_at_a_time(spark, monkeypatch):
    """Nulls among the keys and the words, groups across batches, and no call of Python for each group."""
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 64)
    users = {(u, k): drawn(7 * u + k, 9, 20, 6) for u in range(40) for k in range(3)}
    users[(None, 1)], users[(3, None)] = drawn(900, 150, 60, 7), drawn(901, 5, 8, 4)
    users[(5, 2)] = [(i, set(w) | {None}) for i, w in drawn(902, 9, 9, 4)]
    rows = [(u, k, i, sorted(w, key=str)) for (u, k), rs in users.items() for i, w in rs]
    found = L.leaders(spark.createDataFrame(rows, "u long, k long, id long, words array<string>").repartition(5), ["u", "k"], "id", "words", "id", 0.4, True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.u, r.k, r.id): r.leader for r in found.collect()} == {(u, k, i): x for (u, k), rs in users.items() for i, x in by_hand(rs, 0.4, True).items()}
