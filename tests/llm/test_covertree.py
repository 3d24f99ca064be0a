"""Cover-tree Lloyd against plain Lloyd rounds over all points and entries."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from engram.llm import covertree


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (key, label, vector) of one length; {index: (code, error, label_error, digest)}."""
    kept = [(i, k, lab, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, (k, lab, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[3].tolist()))[:entries]
    bounds = covertree.bounds(len(kept[0][3]), parts)
    books = [[s[3][a:b].tolist() for s in seeds] for a, b in bounds]

    def assign():
        out = []
        for *_, v in kept:
            row = []
            for (a, b), book in zip(bounds, books):
                d = [sum((int(x) - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        labels = assign()
        for p, (a, b) in enumerate(bounds):
            for e in range(len(books[p])):
                mine = [kept[i][3][a:b] for i in range(len(kept)) if labels[i][p][0] == e]
                if mine:
                    books[p][e] = [int(x) // len(mine) for x in np.sum(mine, axis=0)]
    final = assign()
    by_label = collections.Counter()
    for (_, _, lab, _), row in zip(kept, final):
        by_label[lab] += sum(d for _, d in row)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return collections.Counter((k, "".join(f"{e:02x}" for e, _ in row), sum(d for _, d in row), by_label[lab], digest)
                               for (_, k, lab, _), row in zip(kept, final))


def compared(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<float>, error int, code string").repartition(4)
    return collections.Counter(tuple(r) for r in covertree.compress(df, "vec_id", "embedding", "label", **options).collect())


def single(v):
    return [float(np.float32(x)) for x in v]


def test_codes_equal_plain_rounds(spark):
    rnd = np.random.default_rng(3)
    middles = rnd.normal(0, 0.4, (9, 24))
    rows = [(i, None if i % 7 == 0 else i % 3, single(middles[i % 9] + rnd.normal(0, 0.05, 24))) for i in range(500)]
    rows += [(600 + i, 1, rows[20][2]) for i in range(150)]  # a group of copies
    rows += [(30, 2, rows[31][2]), (30, 2, rows[31][2]), (None, 0, rows[5][2]), (None, None, rows[6][2])]
    rows += [(900, 0, None), (901, 0, []), (902, 0, [float("nan")] * 24), (903, 0, [None] + [1.0] * 23), (904, 0, [float("inf")] * 24)]
    assert compared(spark, rows) == brute(rows)


def test_points_without_structure_and_ties(spark):
    rnd = random.Random(5)
    rows = [(i, 0, [rnd.randint(-2, 2) / 4096 for _ in range(16)]) for i in range(300)]  # few different parts, many equal distances
    assert compared(spark, rows) == brute(rows)
    wide = np.random.default_rng(8)
    rows = [(i, i % 2, single(wide.normal(0, 0.3, 64))) for i in range(400)]
    assert compared(spark, rows, entries=5, rounds=2) == brute(rows, entries=5, rounds=2)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_few_rows_and_uneven_parts(spark, n):
    rnd = np.random.default_rng(n)
    rows = [(i, 0, single(rnd.normal(0, 1, 11))) for i in range(n)]
    assert compared(spark, rows) == brute(rows)


def test_each_length_is_coded_by_itself(spark):
    rnd = np.random.default_rng(1)
    short = [(i, 0, single(rnd.normal(0, 1, 8))) for i in range(40)]
    long = [(100 + i, 1, single(rnd.normal(0, 1, 16))) for i in range(40)]
    assert compared(spark, short + long) == brute(short) + brute(long)


def test_no_rows_and_too_large_components(spark):
    assert compared(spark, [(1, 0, None)]) == collections.Counter()
    df = spark.createDataFrame([(1, 0, [1e9] * 8)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        covertree.compress(df, "vec_id", "embedding", "label").collect()


def test_a_tree_covers_its_points_and_assigns_whole_nodes():
    rnd = np.random.default_rng(2)
    middles = rnd.integers(-40_000, 40_000, (12, 4))
    points = np.concatenate([m + rnd.integers(-50, 50, (200, 4)) for m in middles])
    tree = covertree.CoverTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    ordered = points[tree.order]
    for node in range(len(tree.lo)):
        mine = ordered[tree.lo[node]:tree.hi[node]]
        assert np.sqrt(((mine - mine[0]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-6
        kids = range(tree.first[node], tree.first[node] + tree.children[node])
        assert not kids or (tree.lo[kids[0]], tree.hi[kids[-1]]) == (tree.lo[node], tree.hi[node])
        assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-6 for k in kids)
    labels, whole, single_points = tree.assign(ordered, middles)
    assert (labels == covertree.squares(ordered, middles).argmin(axis=1)).all()
    assert len(single_points) == 0 and sum(len(lo) for lo, _, _ in whole) < 100  # clusters far apart never descend to points
    sums = covertree.totals(labels, whole, single_points, ordered, 12)
    assert sums[:, 0].tolist() == [200] * 12 and (sums[:, 1:].sum(axis=0) == points.sum(axis=0)).all()
