"""Hierarchical density clustering of vectors by joins (C-01).

Single linkage over mutual-reachability distances, condensed to groups of a least size, of which the most stable are kept.
A user with few rows is settled in one task; one with a third of all rows is spread over all of them by joins. Both do the
same, so the bound decides where the work is done and never what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from engram.operators.graph import connected_components
from engram.operators.pairs import vector_pairs
from engram.session import cut

#: Distances are rounded to so many digits and taken as at least the last of them, so that copies have a finite density.
DIGITS, NEAREST = 9, 1e-9
#: Rows up to which one task settles a user.
ROWS_IN_TASK = 1_024


def _density(distance: Column) -> Column:
    return 1.0 / F.greatest(distance, F.lit(NEAREST))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The lightest spanning trees of (w, a, b) edges, equal weights ordered by their ends.

    Every round each part takes its lightest edge to another part and the parts so joined become one (Boruvka), so parts at least halve.
    Of parallel edges between two parts only the lightest is carried on.
    """
    left = cut(edges.select("w", "a", "b", F.col("a").alias("x"), F.col("b").alias("y")))
    trees = []
    while not left.isEmpty():
        ends = left.select("w", "a", "b", "x", "y", F.explode(F.array("x", "y")).alias("part"))
        taken = cut(ends.groupBy("part").agg(F.min(F.struct("w", "a", "b", "x", "y")).alias("e")).select("e.*").distinct())
        trees.append(taken.select("w", "a", "b"))
        parts = cut(connected_components(taken.select(F.col("x").alias("src"), F.col("y").alias("dst"))))
        moved = (left.join(parts.withColumnsRenamed({"id": "x", "component": "_x"}), "x").join(parts.withColumnsRenamed({"id": "y", "component": "_y"}), "y")
                 .filter("_x <> _y").select("w", "a", "b", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")))
        left = cut(moved.groupBy("x", "y").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*", "x", "y"))
    out = trees[0] if trees else edges.select("w", "a", "b").limit(0)
    for more in trees[1:]:
        out = out.unionByName(more)
    return cut(out)


def _before(r: str, e: str) -> Column:
    """Whether the edge ``r`` (without ends: copies that join) comes before the edge ``e``."""
    f, g = F.col(r), F.col(e)
    return (f["w"] < g["w"]) | ((f["w"] == g["w"]) & (f["a"].isNull() | (f["a"] < g["a"]) | ((f["a"] == g["a"]) & (f["b"] < g["b"]))))


def _when_large(nodes: DataFrame, tree: DataFrame, min_size: int) -> DataFrame:
    """(node, n, r): the edge at which what a node is part of first holds ``min_size`` rows, or null.

    From each node the lightest edges are followed, ``min_size`` - 1 of them at most. ``nodes``: (node, n, core).
    """
    e = F.struct("w", "a", "b")
    adjacent = cut(tree.select(e.alias("e"), F.col("a").alias("at"), F.col("b").alias("next")).unionByName(tree.select(e.alias("e"), F.col("b").alias("at"), F.col("a").alias("next"))))
    none = F.lit(None).cast(dict(nodes.dtypes)["node"])
    state = nodes.select("node", "n", F.array("node").alias("held"), F.col("n").alias("size"), F.struct(F.col("core").alias("w"), none.alias("a"), none.alias("b")).alias("r"))
    weight = nodes.select(F.col("node").alias("next"), F.col("n").alias("_n"))
    done = state.filter(F.col("size") >= min_size)
    growing = state.filter(F.col("size") < min_size)
    for _ in range(min_size - 1):
        reached = growing.withColumn("at", F.explode("held")).join(adjacent, "at").filter(~F.array_contains("held", F.col("next")))
        step = reached.groupBy("node").agg(F.min(F.struct("e", "next")).alias("s"), F.first("n").alias("n"), F.first("held").alias("held"), F.first("size").alias("size"), F.first("r").alias("r"))
        grown = step.withColumn("next", F.col("s.next")).join(weight, "next").withColumn("e", F.col("s.e")).select(
            "node", "n", F.array_append("held", F.col("next")).alias("held"), (F.col("size") + F.col("_n")).alias("size"), F.when(_before("r", "e"), F.col("e")).otherwise(F.col("r")).alias("r"))
        grown = cut(grown)
        done, growing = done.unionByName(grown.filter(F.col("size") >= min_size)), grown.filter(F.col("size") < min_size)
    return cut(done.select("node", "n", "r"))


def _condensed(points: DataFrame, splits: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(clusters, homes) of the condensed trees over groups that no split parts.

    ``points``: (node, n, r, group), ``splits``: (w, a, b, x, y) between groups x and y. Every round joins the groups whose lightest split is the same; a
    group that is joined ends as a cluster born at that split. Points that fall out only above it go on to the cluster that is
    made of both. Rounds grow with the depth of the tree, not with its size.
    clusters: (k, parent, chosen), homes: (node, k), the last cluster that a point belongs to.
    """
    key = F.struct(F.col("group").alias("g"), F.lit(0).alias("t"))
    waiting = cut(points.withColumn("density", _density(F.col("r.w"))))
    open_ = cut(waiting.select("group", key.alias("k"), F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("death"), F.lit(0.0).alias("best")).distinct())
    left, t, clusters, homes = cut(splits), 0, [], []
    while True:
        t += 1
        e = F.struct("w", "a", "b", "x", "y")
        least = left.select(e.alias("e"), F.explode(F.array("x", "y")).alias("group")).groupBy("group").agg(F.min("e").alias("e"))
        ready = least.groupBy("e").agg(F.count("*").alias("_both")).filter("_both = 2").select("e")
        # a group without a split left is a root, born where distances end
        ends = ready.select("e", F.explode(F.array("e.x", "e.y")).alias("group"))
        rooted = open_.join(left.select(F.explode(F.array("x", "y")).alias("group")).distinct(), "group", "left_anti").select("group")
        closing = cut(ends.select("group", "e", F.least("e.x", "e.y").alias("into")).unionByName(
            rooted.select("group", F.lit(None).cast(dict(ends.dtypes)["e"]).alias("e"), F.lit(None).cast(dict(ends.dtypes)["group"]).alias("into"))))
        if clusters and closing.isEmpty():
            break
        here = waiting.join(closing, "group")
        stays = F.col("e").isNull() | _before("r", "e")
        settled = cut(here.filter(stays).select("node", "n", "density", "group"))
        own = settled.groupBy("group").agg(F.sum("n").alias("own"), F.sum(F.col("n") * F.col("density")).alias("dense"))
        birth = F.when(F.col("e").isNull(), _density(F.lit(limit))).otherwise(_density(F.col("e.w")))
        stability = F.col("dense") - F.col("own") * birth + F.col("below") * (F.col("death") - birth)
        closed = (open_.join(closing, "group").join(own, "group", "left").na.fill(0, ["own"]).na.fill(0.0, ["dense"])
                  .select("group", "k", "e", "into", (F.col("own") + F.col("below")).alias("n"), stability.alias("stability"), "best")
                  .withColumn("chosen", F.col("stability") >= F.col("best")))
        parent = F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("g"), F.lit(t).alias("t")))
        closed = cut(closed.withColumn("parent", parent))
        clusters.append(closed.select("k", "parent", "chosen"))
        homes.append(settled.join(open_.select("group", "k"), "group").select("node", "k"))
        made = closed.filter("into is not null").groupBy("into").agg(
            F.first("parent").alias("k"), F.sum("n").alias("below"), F.first(_density(F.col("e.w"))).alias("death"), F.sum(F.greatest("stability", "best")).alias("best")).withColumnRenamed("into", "group")
        moves = closing.filter("into is not null").select("group", "into")
        waiting = cut(waiting.join(closing.select("group"), "group", "left_anti").unionByName(
            here.filter(~stays).drop("group", "e").withColumnRenamed("into", "group").select(*waiting.columns)))
        open_ = cut(open_.join(closing.select("group"), "group", "left_anti").unionByName(made.select(*open_.columns)))
        one, other = moves.withColumnsRenamed({"group": "x", "into": "_x"}), moves.withColumnsRenamed({"group": "y", "into": "_y"})
        left = cut(left.join(one, "x", "left").join(other, "y", "left").select("w", "a", "b", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).filter("x <> y"))
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    return cut(whole(clusters)), cut(whole(homes))


def _topmost(clusters: DataFrame) -> DataFrame:
    """(k, top): the highest chosen cluster above or at each; every round doubles the steps upwards."""
    jump = cut(clusters.select("k", F.col("parent").alias("to"), F.when(F.col("chosen"), F.col("k")).alias("top")))
    while not jump.filter("to is not null").isEmpty():
        above = jump.select(F.col("k").alias("to"), F.col("to").alias("_to"), F.col("top").alias("_top"))
        jump = cut(jump.join(above, "to", "left").select("k", F.col("_to").alias("to"), F.coalesce("_top", "top").alias("top")))
    return jump.select("k", "top")


def settle(vectors: np.ndarray, min_similarity: float, min_samples: int, min_size: int) -> np.ndarray:
    """The first row of the cluster of each row, or -1, for rows (of one length) in the order of their ids."""
    n, limit = len(vectors), round(1 - min_similarity, DIGITS)
    out = np.full(n, -1)
    if n < max(min_size, min_samples + 1):
        return out
    size = np.linalg.norm(vectors, axis=1)
    m = np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0)
    d = np.maximum(np.round(1 - m @ m.T, DIGITS), 0)
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    d[kind.ravel()[:, None] == kind.ravel()[None, :]] = 0
    others = d.copy()
    np.fill_diagonal(others, np.inf)
    core = np.partition(others, min_samples - 1, axis=1)[:, min_samples - 1]
    i, j = np.triu_indices(n, 1)
    w = np.maximum(np.maximum(d[i, j], core[i]), core[j])
    near = np.flatnonzero(w <= limit)
    near = near[np.lexsort((j[near], i[near], w[near]))]
    density = lambda x: 1.0 / max(x, NEAREST)
    root, members = list(range(n)), {x: [x] for x in range(n)}
    # an open cluster: rows that fell out, their summed densities, rows of the clusters below, where those were born, what they are worth, which are kept
    open_: dict[int, list] = {}

    def close(part: int, birth: float) -> tuple[float, list[list[int]]]:
        own, dense, below, death, best, kept = open_.pop(part)
        stability = dense - own * birth + below * (death - birth)
        return (stability, [list(members[part])]) if stability >= best else (best, kept)

    for weight, a, b in zip(w[near].tolist(), i[near].tolist(), j[near].tolist()):
        a, b = root[a], root[b]
        if a == b:
            continue
        at, into, from_ = density(weight), *((a, b) if len(members[a]) >= len(members[b]) else (b, a))
        large = [x for x in (into, from_) if x in open_]
        if len(large) == 2:
            done = [close(x, at) for x in large]
            state = [0, 0.0, len(members[a]) + len(members[b]), at, sum(s for s, _ in done), done[0][1] + done[1][1]]
        elif large:
            state = open_.pop(large[0])
            state[0] += len(members[from_])
            state[1] += len(members[from_]) * at
        else:
            total = len(members[a]) + len(members[b])
            state = [total, total * at, 0, 0.0, 0.0, []]
        for x in members[from_]:
            root[x] = into
        members[into] += members.pop(from_)
        if len(members[into]) >= min_size:
            open_[into] = state
    for part in list(open_):
        for cluster in close(part, density(limit))[1]:
            out[cluster] = min(cluster)
    return out


def _in_tasks(rows: DataFrame, keys: list[str], min_similarity: float, min_samples: int, min_size: int) -> DataFrame:
    """(keys, id, cluster_id) of users whose rows one task can hold; vectors of each length by themselves."""
    kind = rows.schema["id"].dataType
    schema = StructType([*[rows.schema[k] for k in keys], StructField("id", kind), StructField("cluster_id", kind)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        column = table.column("v").combine_chunks()
        lengths, parts = column.value_lengths().to_numpy(zero_copy_only=False), []
        ends = np.cumsum(lengths)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            first = settle(flat[(ends[at] - dim)[:, None] + np.arange(dim)], min_similarity, min_samples, min_size)
            some = np.flatnonzero(first >= 0)
            mine = table.take(pa.array(at[some]))
            parts.append(pa.table([*[mine.column(k) for k in keys], mine.column("id"), table.column("id").take(pa.array(at[first[some]]))], [f.name for f in schema.fields]))
        return pa.concat_tables(parts)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _by_rounds(rows: DataFrame, keys: list[str], min_similarity: float, min_samples: int, min_size: int) -> DataFrame:
    """(keys, id, cluster_id) of users of any size. Equal vectors are compared once."""
    limit = round(1 - min_similarity, DIGITS)
    same = cut(rows.groupBy(*keys, "v").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    pairs = cut(vector_pairs(same.withColumnRenamed("v", "embedding"), keys, "node", min_similarity).select(
        "id_a", "id_b", F.greatest(F.round(1 - F.col("score"), DIGITS), F.lit(0.0)).alias("d")))
    both = pairs.select(F.col("id_a").alias("node"), F.col("id_b").alias("other"), "d").unionByName(pairs.select(F.col("id_b").alias("node"), F.col("id_a").alias("other"), "d"))
    # of equal vectors one is the row itself and the others are at distance 0
    order = Window.partitionBy("node").orderBy("d", "other")
    close = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= min_samples)
    count = same.select(F.col("node").alias("other"), F.col("n").alias("m"))
    met = close.join(count, "other").withColumn("seen", F.sum("m").over(order)).join(same.select("node", "n"), "node")
    far = met.filter(F.col("seen") + F.col("n") - 1 >= min_samples).groupBy("node").agg(F.min("d").alias("core"))
    dense = F.when(F.col("n") > min_samples, 0.0).otherwise(F.col("core"))
    nodes = cut(same.select("node", "n").join(far, "node", "left").select("node", "n", dense.alias("core")).filter("core is not null"))
    ends = lambda c: nodes.select(F.col("node").alias(c), F.col("core").alias(f"_{c}"))
    edges = pairs.join(ends("id_a"), "id_a").join(ends("id_b"), "id_b").select(F.greatest("d", "_id_a", "_id_b").alias("w"), F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    tree = spanning_forest(edges)
    large = _when_large(nodes, tree, min_size)
    judged = (tree.join(large.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a").join(large.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
              .withColumn("e", F.struct("w", "a", "b")).select("w", "a", "b", (_before("ra", "e") & _before("rb", "e")).alias("split")))
    judged = cut(judged)
    group = cut(connected_components(judged.filter("not split").select(F.col("a").alias("src"), F.col("b").alias("dst")), large.select(F.col("node").alias("id"))))
    at = lambda c, name: group.withColumnsRenamed({"id": c, "component": name})
    splits = judged.filter("split").join(at("a", "x"), "a").join(at("b", "y"), "b").select("w", "a", "b", "x", "y")
    clusters, homes = _condensed(large.join(at("node", "group"), "node"), splits, limit)
    placed = homes.join(_topmost(clusters), "k").filter("top is not null").select("node", "top")
    named = placed.groupBy("top").agg(F.min("node").alias("cluster_id"))
    member = placed.join(named, "top").select("node", "cluster_id").join(same.select(*keys, "node", "v"), "node")
    return rows.join(member, [*keys, "v"]).select(*keys, "id", "cluster_id")


def density_clusters(vectors: DataFrame, keys: Sequence[str], id_col: str, min_similarity: float, min_samples: int = 2, min_size: int = 3,
                     rows_in_task: int = ROWS_IN_TASK) -> DataFrame:
    """(keys, id, cluster_id) of the most stable density clusters of a hierarchy (C-01). Rows in no cluster are noise and left out.

    Distance is one minus the cosine. A row's core distance is that of its ``min_samples``-th nearest other row, two rows are as far apart
    as the largest of their distance and both core distances. The hierarchy starts at ``min_similarity``: rows further apart are never joined, and a
    whole part may be one cluster. ``cluster_id`` is the smallest id of a cluster; ids must be unique across ``keys``.
    """
    keys = list(keys)
    rows = cut(vectors.filter(F.size("embedding") > 0).select(*keys, F.col(id_col).alias("id"), F.col("embedding").alias("v")))
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("_all")).filter(F.col("_all") > rows_in_task).select(*keys))
    if large.isEmpty():
        return _in_tasks(rows, keys, min_similarity, min_samples, min_size).withColumnRenamed("id", id_col)
    found = _in_tasks(rows.join(large, keys, "left_anti"), keys, min_similarity, min_samples, min_size)
    return found.unionByName(_by_rounds(rows.join(large, keys, "left_semi"), keys, min_similarity, min_samples, min_size)).withColumnRenamed("id", id_col)
