"""Density clusters against a sequential version over the whole distance matrix."""

from __future__ import annotations

import numpy as np
import pytest

from engram.operators.density import DIGITS, NEAREST, density_clusters, settle, spanning_forest


def brute(rows, min_similarity, min_samples, min_size):
    """{id: smallest id of its cluster} for rows (id, vector) of one user: sorted edges, a dendrogram, its condensed tree, the most stable nodes."""
    ids = [r[0] for r in rows]
    m = np.array([r[1] for r in rows], float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    n, limit = len(ids), round(1 - min_similarity, DIGITS)
    d = np.maximum(np.round(1 - m @ m.T, DIGITS), 0)
    for i in range(n):  # equal vectors are at distance 0 whatever the rounding
        for j in range(n):
            if rows[i][1] == rows[j][1]:
                d[i, j] = 0
    if n <= min_samples:
        return {}
    off = d + np.diag([np.inf] * n)
    core = np.sort(off, axis=1)[:, min_samples - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((w[i, j], ids[i], ids[j], i, j) for i in range(n) for j in range(i + 1, n) if w[i, j] <= limit)
    # single linkage: nodes 0..n-1 are rows, later ones join two
    top, members, joined = list(range(n)), {i: [i] for i in range(n)}, {}
    for weight, _, _, i, j in edges:
        a, b = top[i], top[j]
        if a != b:
            new = n + len(joined)
            joined[new] = (weight, a, b)
            members[new] = members[a] + members[b]
            for x in members[new]:
                top[x] = new
    density = lambda x: 1 / max(x, NEAREST)
    found = {}

    def condense(node, birth):
        """(stability kept, clusters kept) of the cluster that starts at ``node``."""
        stability, here = 0.0, []
        while True:
            if node < n:
                return 0.0, []
            weight, a, b = joined[node]
            large = [x for x in (a, b) if len(members[x]) >= min_size]
            fallen = [x for c in (a, b) if c not in large for x in members[c]]
            here += fallen
            stability += len(fallen) * (density(weight) - birth)
            if len(large) == 1:
                node = large[0]
                continue
            if len(large) == 2:
                stability += sum(len(members[x]) for x in large) * (density(weight) - birth)
                below = [condense(x, density(weight)) for x in large]
                everything = here + [p for x in large for p in members[x]]
                if stability >= sum(s for s, _ in below):
                    return stability, [everything]
                return sum(s for s, _ in below), below[0][1] + below[1][1]
            return stability, [here]

    for root in set(top):
        if len(members[root]) >= min_size:
            for cluster in condense(root, density(limit))[1]:
                for p in cluster:
                    found[ids[p]] = min(ids[q] for q in cluster)
    return found


def blobs(seed, n, dim=6, spread=0.25):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, 1, (4, dim))
    rows = [[float(x) for x in middles[i % 4] + rnd.normal(0, spread * (1 + i % 3), dim)] for i in range(n)]
    rows += [rows[0]] * 2 + [rows[n // 2]] * 4 + [[2 * x for x in rows[n - 1]]] + [[float(x) for x in rnd.normal(0, 3, dim)] for _ in range(5)]
    return rows


@pytest.mark.parametrize(("min_similarity", "min_samples", "min_size", "in_task"), [(0.75, 2, 3, 40), (0.2, 2, 3, 1_024), (-1.0, 1, 4, 0)])
def test_clusters_equal_the_sequential_version(spark, min_similarity, min_samples, min_size, in_task):
    users = {u: [(100 * u + i, v) for i, v in enumerate(blobs(u, n))] for u, n in [(1, 45), (2, 30), (3, 1), (4, 60)]}
    users[5] = [(500, [1.0, 0.0]), (501, [0.0, 1.0])]
    users[6] = [(600 + i, [1.0, 2.0]) for i in range(7)]  # copies only
    rows = [(u, i, v) for u, vs in users.items() for i, v in vs] + [(7, 700, None), (7, 701, [])]
    vectors = spark.createDataFrame(rows, "user_id long, memory_id long, embedding array<double>").repartition(3)
    got = {r.memory_id: r.cluster_id for r in density_clusters(vectors, ["user_id"], "memory_id", min_similarity, min_samples, min_size, in_task).collect()}
    want = {}
    for vs in users.values():
        want |= brute(vs, min_similarity, min_samples, min_size)
    assert got == want
    assert len(set(got.values())) > 3 and got[600] == 600


def test_spanning_forest_takes_the_lightest_edges(spark):
    rnd = np.random.default_rng(4)
    edges = [(float(rnd.integers(0, 6)), i, j) for i in range(40) for j in range(i + 1, 40) if rnd.random() < 0.2 and (i < 20) == (j < 20)]
    root = list(range(40))
    want = []
    for e in sorted(edges):
        a, b = root[e[1]], root[e[2]]
        if a != b:
            want.append(e)
            root = [a if r == b else r for r in root]
    got = spanning_forest(spark.createDataFrame(edges, "w double, a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "user_id long, memory_id long, embedding array<double>")
    assert density_clusters(none, ["user_id"], "memory_id", 0.5).collect() == []


@pytest.mark.parametrize("options", [(0.75, 2, 3), (0.2, 2, 3), (-1.0, 1, 4), (0.5, 3, 2), (0.9, 2, 5)])
def test_one_task_settles_as_the_sequential_version(options):
    for seed in range(12):
        rows = list(enumerate(blobs(seed, 10 + 3 * seed)))
        got = settle(np.array([v for _, v in rows]), *options)
        assert {i: int(c) for i, c in enumerate(got) if c >= 0} == brute(rows, *options)
