"""Traversal, ranking and maintenance of per-user graphs (G-01 … G-18).

Graphs are two tables: nodes (user_id, node_id, …) and directed edges
(user_id, src, dst, type, strength, …). Every operator works on all users at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from engram import vocab as V
from engram.operators import local as L
from engram.session import cut
from engram.sources.store import top_per_group


#: Edges, or nodes, of one graph up to which one task ranks it.
EDGES_IN_TASK = 1 << 18


def build(nodes: DataFrame, edges: DataFrame, min_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges whose two ends are among them (G-01, J-10)."""
    kept = nodes if min_confidence is None else nodes.filter(F.col("confidence") >= min_confidence)
    ids = kept.select("user_id", "node_id")
    inside = (edges.join(ids.withColumnRenamed("node_id", "src"), ["user_id", "src"], "left_semi")
              .join(ids.withColumnRenamed("node_id", "dst"), ["user_id", "dst"], "left_semi"))
    return kept, inside


def both_ways(edges: DataFrame) -> DataFrame:
    pair = edges.select("user_id", "src", "dst")
    return pair.unionByName(pair.select("user_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("user_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def _only(large: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """What tables have of the large graphs, without edges that lack an end."""
    return [(t.filter("src is not null and dst is not null") if "src" in t.columns else t).join(large, "user_id", "left_semi") for t in tables]


def _schema(like: DataFrame, node: str, *fields: tuple) -> StructType:
    """Output of a task: user_id, columns of the type of a node, and columns of given types."""
    return StructType([StructField("user_id", like.schema["user_id"].dataType)] + [StructField(f[0], f[1] if len(f) > 1 else like.schema[node].dataType) for f in fields])


def _table(schema: StructType, *columns) -> pa.Table:
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.name for f in schema.fields])


def reach(sources: DataFrame, edges: DataFrame, max_depth: int | None, with_path: bool = False, cut_every: int = 2, ends: DataFrame | None = None) -> DataFrame:
    """Shortest distance (and one shortest path) from each source to what it reaches (G-02, G-03).

    Breadth-first over all sources at once: only nodes reached for the first time expand.
    Of equally short paths the one that reads first wins. Includes the sources at distance 0.
    Without ``max_depth`` it runs until nothing new is reached. With ``ends`` (user_id, node, …) only what is among them
    returns, with their columns. Graphs of few rows are searched in tasks, larger ones in rounds of joins.
    """
    parts, extra, some = [L.tagged(L.NODE, sources, "node_id"), L.edge_rows(edges)], [], ends is not None
    if some:
        ends = ends.filter("user_id is not null and node is not null")
        extra = [f for f in ends.schema.fields if f.name not in ("user_id", "node")]
        parts.append(L.tagged(L.END, ends.withColumn("_more", F.struct(*[f.name for f in extra])), "node", more="_more") if extra else L.tagged(L.END, ends, "node"))
    rows, large = L.gathered(*parts)
    node = edges.schema["src"].dataType
    schema = _schema(edges, "src", ("source",), ("node",), ("depth", IntegerType()), *([("path", ArrayType(node))] if with_path else []), *[(f.name, f.dataType) for f in extra])

    def run(g: L.Graphs):
        g.start_at(g.a[g.of(L.NODE)])
        # a path is followed back to its source
        g.walk(g.a[g.edge], g.b[g.edge])
        g.search(max_depth, with_path)
        wanted = g.of(L.END)
        wanted = wanted[np.argsort(g.a[wanted], kind="stable")]
        for cells in L.pieces(np.flatnonzero(g.depth >= 0)):
            at = None
            if some:
                lo, hi = (np.searchsorted(g.a[wanted], g.vertex[cells], side) for side in ("left", "right"))
                which = np.repeat(np.arange(len(cells)), hi - lo)
                at = wanted[lo[which] + np.arange(len(which)) - (np.cumsum(hi - lo) - (hi - lo))[which]]
                cells = cells[which]
            out = [g.name(g.vertex[cells]), g.id(g.start(cells)), g.id(g.vertex[cells]), g.depth[cells]]
            if with_path:
                flat, begin = g.trails(cells)
                length = np.diff(begin)
                turned = np.repeat(begin[1:] - 1 + begin[:-1], length) - np.arange(len(flat))
                out.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), g.id(flat[turned])))
            if extra:
                more = g.rows["more"].combine_chunks().take(pa.array(at))
                out += [more.field(f.name) for f in extra]
            yield _table(schema, *out)

    found = L.in_tasks(rows, run, schema)
    if large is None:
        return found
    far = _reach_in_rounds(*_only(large, sources, edges), max_depth, with_path, cut_every)
    return found.unionByName(far.join(ends, ["user_id", "node"]) if some else far)


def _reach_in_rounds(sources: DataFrame, edges: DataFrame, max_depth: int | None, with_path: bool = False, cut_every: int = 2) -> DataFrame:
    keys = ["user_id", "source", "node"]
    step = edges.select("user_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = sources.select("user_id", F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0).alias("depth")).distinct()
    if with_path:
        front = front.withColumn("path", F.array("node"))
    if max_depth is None or max_depth > cut_every:
        step = cut(step)
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = front.join(step, ["user_id", "node"]).select(
            "user_id", "source", F.col("next").alias("node"),
            *([F.array_append("path", F.col("next")).alias("path")] if with_path else []))
        once = found.groupBy(*keys).agg(F.min("path").alias("path")) if with_path else found.distinct()
        front = once.join(seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)).select(*seen.columns)
        more = max_depth is None or depth < max_depth
        if depth % cut_every == 0 and more:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
        if depth % cut_every == 0 and more:
            seen = cut(seen)
    return seen


def related(sources: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, with_path: bool = False) -> DataFrame:
    """What each source reaches along its edges, nearest and most confident first (G-02)."""
    return reach(sources, edges, depth, with_path, ends=nodes.withColumnRenamed("node_id", "node")).filter("depth > 0")


def related_concepts(sources: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 10) -> DataFrame:
    """Reached nodes with the type and strength of the edge that first led there, strongest first (G-02)."""
    near = reach(sources, edges, depth)
    last = near.filter("depth > 0").alias("n")
    prior = near.select("user_id", "source", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    hops = (last.join(edges.select("user_id", "src", F.col("dst").alias("node"), "type", "strength"), ["user_id", "node"])
            .join(prior, ["user_id", "source", "src", "depth"], "left_semi"))
    via = hops.groupBy("user_id", "source", "node", "depth").agg(
        F.max_by(F.struct("type", "strength"), F.struct("strength", "src")).alias("e"))
    rows = via.select("user_id", "source", "node", "depth", "e.type", "e.strength")
    nearest = top_per_group(rows, ["user_id", "source"], [F.col("depth"), F.desc("strength"), F.col("node")], limit, "_r")
    return top_per_group(nearest.drop("_r"), ["user_id", "source"], [F.desc("strength"), F.col("node")], limit)


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None, undirected: bool = False) -> DataFrame:
    """One shortest path per (user_id, source, target), absent when there is none (G-03)."""
    asked = pairs.select("user_id", "source", "target").filter("user_id is not null and source is not null and target is not null")
    rows, large = L.gathered(L.tagged(L.END, asked, "source", "target"), L.edge_rows(edges))
    schema = _schema(edges, "src", ("source",), ("target",), ("depth", IntegerType()), ("path", ArrayType(edges.schema["src"].dataType)))

    def run(g: L.Graphs):
        for cells in L.pieces(_searched_back(g, max_depth, undirected)):
            flat, begin = g.trails(cells)
            yield _table(schema, g.name(g.vertex[cells]), g.id(g.vertex[cells]), g.id(g.start(cells)), g.depth[cells],
                         pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), g.id(flat)))

    found = L.in_tasks(rows, run, schema)
    return found if large is None else found.unionByName(_paths_in_rounds(*_only(large, asked, edges), max_depth, undirected))


def _searched_back(g: L.Graphs, max_depth: int | None, undirected: bool) -> np.ndarray:
    """Cells of the sources asked for after a search from their targets against the edges; parents lead on along the path that reads first."""
    asked, a, b = g.of(L.END), g.a[g.edge], g.b[g.edge]
    g.start_at(g.b[asked])
    g.walk(np.concatenate([b, a]), np.concatenate([a, b])) if undirected else g.walk(b, a)
    g.search(max_depth)
    place = np.searchsorted(g.starts, g.b[asked]) - g.first_start[g.user[g.b[asked]]]
    cells = np.unique(g.base[g.a[asked]] + place)
    return cells[g.depth[cells] >= 0]


def _paths_in_rounds(pairs: DataFrame, edges: DataFrame, max_depth: int | None, undirected: bool) -> DataFrame:
    steps = both_ways(edges) if undirected else edges
    starts = pairs.select("user_id", F.col("source").alias("node_id")).distinct()
    found = _reach_in_rounds(starts, steps, max_depth, with_path=True).withColumnRenamed("node", "target")
    return found.join(pairs.select("user_id", "source", "target"), ["user_id", "source", "target"], "left_semi")


def simple_paths(sources: DataFrame | None, edges: DataFrame, max_hops: int = 3, ends: DataFrame | None = None) -> DataFrame:
    """All paths without a repeated node, up to ``max_hops`` edges, each once (G-04).

    Without ``sources`` they start at every node. With ``ends`` (user_id, node_id) only paths to these return, and are looked for from
    there. Graphs of few rows are walked in tasks, larger ones in rounds of joins.
    """
    every, some = sources is None, ends is not None
    rows, large = L.gathered(L.edge_rows(edges), *[L.tagged(kind, df, "node_id") for kind, df in ((L.NODE, sources), (L.END, ends)) if df is not None])
    schema = _schema(edges, "src", ("source",), ("target",), ("path", ArrayType(edges.schema["src"].dataType)))

    def run(g: L.Graphs):
        starts = g.a[g.edge if every else g.of(L.NODE)]
        step = np.unique(g.a[g.edge] * g.n + g.b[g.edge])
        a, b = step // g.n, step % g.n
        g.walk(b, a) if some else g.walk(a, b)
        known = np.zeros(g.n, bool)
        known[starts] = True
        # the piece last put off goes first, so that few are held at a time
        left = [np.unique(g.a[g.of(L.END)] if some else starts)[:, None]]
        while left:
            trail = left.pop()
            which, to = g.beyond(trail[:, -1])
            new = (trail[which] != to[:, None]).all(axis=1)
            trail = np.column_stack([trail[which[new]], to[new]])
            found = trail[known[trail[:, -1]]][:, ::-1] if some else trail
            begin = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            yield _table(schema, g.name(found[:, 0]), g.id(found[:, 0]), g.id(found[:, -1]), pa.ListArray.from_arrays(pa.array(begin), g.id(found.ravel())))
            if trail.shape[1] <= max_hops:
                # what a piece leads to is bounded
                work = np.cumsum(g.first[trail[:, -1] + 1] - g.first[trail[:, -1]]) >> 18
                left += np.split(trail, np.flatnonzero(np.diff(work)) + 1)

    found = L.in_tasks(rows, run, schema) if max_hops > 0 else edges.sparkSession.createDataFrame([], schema)
    if large is None:
        return found
    far = [None if df is None else _only(large, df)[0] for df in (sources, edges, ends)]
    return found.unionByName(_simple_in_rounds(far[0], far[1], max_hops, far[2]))


def _simple_in_rounds(sources: DataFrame | None, edges: DataFrame, max_hops: int, ends: DataFrame | None) -> DataFrame:
    some = ends is not None
    sources = edges.select("user_id", F.col("src").alias("node_id")) if sources is None else sources
    step = cut((reversed_edges(edges) if some else edges).select("user_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    start = (ends if some else sources).select("user_id", F.col("node_id").alias("node")).distinct()
    front, out = start.select("user_id", "node", F.array("node").alias("path")), start.limit(0).select("user_id", "node", F.array("node").alias("path"))
    for _ in range(max_hops):
        longer = F.concat(F.array("next"), "path") if some else F.array_append("path", F.col("next"))
        front = cut(front.join(step, ["user_id", "node"]).filter(~F.array_contains("path", F.col("next"))).select("user_id", F.col("next").alias("node"), longer.alias("path")))
        out = out.unionByName(front)
    if some:
        out = out.join(sources.select("user_id", F.col("node_id").alias("node")), ["user_id", "node"], "left_semi")
    return out.select("user_id", F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target"), "path")


def explain_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Hops of the shortest undirected path, with relation, direction and strength (G-16)."""
    asked = pairs.select("user_id", "source", "target").filter("user_id is not null and source is not null and target is not null")
    rows, large = L.gathered(L.tagged(L.END, asked, "source", "target"), L.edge_rows(edges, type="type", strength="strength"))
    schema = _schema(edges, "src", ("source",), ("target",), ("depth", IntegerType()), ("hop", IntegerType()), ("a",), ("b",),
                     ("relation", edges.schema["type"].dataType), ("direction", StringType()), ("strength", edges.schema["strength"].dataType))

    def run(g: L.Graphs):
        paths = _searched_back(g, max_depth, True)
        kinds, types = L._codes(g.rows["type"])
        rank = np.empty(len(types), np.int64)
        rank[pc.sort_indices(types, null_placement="at_start").to_numpy()] = np.arange(len(types))
        known, value = ~g.rows["strength"].is_null().to_numpy()[g.edge], g.numbers("strength")[g.edge]
        best = g.edge[L.firsts(-rank[kinds[g.edge]], -np.where(known, value, -np.inf), ~known, g.b[g.edge], g.a[g.edge])]
        keys = g.a[best] * g.n + g.b[best]
        for cells in L.pieces(paths[g.depth[paths] > 0]):
            flat, begin = g.trails(cells)
            hop = np.delete(np.arange(len(flat)), begin[1:] - 1)
            cell = np.repeat(np.arange(len(cells)), np.diff(begin) - 1)
            a, b = flat[hop], flat[hop + 1]
            at, back = (np.minimum(np.searchsorted(keys, k), len(keys) - 1) for k in (a * g.n + b, b * g.n + a))
            forward = keys[at] == a * g.n + b
            edge = pa.array(best[np.where(forward, at, back)])
            yield _table(schema, g.name(a), g.id(g.vertex[cells[cell]]), g.id(g.start(cells[cell])), g.depth[cells[cell]], (hop - begin[cell]).astype(np.int32), g.id(a), g.id(b),
                         g.rows["type"].combine_chunks().take(edge), pa.array(np.where(forward, "forward", "backward"), pa.string()), g.rows["strength"].combine_chunks().take(edge))

    found = L.in_tasks(rows, run, schema)
    return found if large is None else found.unionByName(_explained_by_joins(*_only(large, asked, edges), max_depth))


def _explained_by_joins(pairs: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    paths = _paths_in_rounds(pairs, edges, max_depth, undirected=True).filter("depth > 0")
    hops = paths.select("user_id", "source", "target", "depth",
                        F.posexplode(F.zip_with(F.slice("path", F.lit(1), F.col("depth")), F.slice("path", F.lit(2), F.col("depth")),
                                                lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("hop", "h"))
    one = edges.groupBy("user_id", "src", "dst").agg(F.max_by(F.struct("type", "strength"), F.struct("strength", "type")).alias("e"))
    forward = one.select("user_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("e").alias("fe"))
    back = one.select("user_id", F.col("dst").alias("a"), F.col("src").alias("b"), F.col("e").alias("be"))
    flat = hops.select("user_id", "source", "target", "depth", "hop", "h.a", "h.b")
    df = flat.join(forward, ["user_id", "a", "b"], "left").join(back, ["user_id", "a", "b"], "left")
    e = F.coalesce("fe", "be")
    return df.select("user_id", "source", "target", "depth", "hop", "a", "b", e["type"].alias("relation"),
                     F.when(F.col("fe").isNotNull(), "forward").otherwise("backward").alias("direction"), e["strength"].alias("strength"))


def related_of_type(sources: DataFrame, edges: DataFrame, nodes: DataFrame, entity_type: str = "project", depth: int = 2) -> DataFrame:
    """Nodes of a type within ``depth`` hops either way (G-13)."""
    return related(sources, both_ways(edges), nodes.filter(F.col("entity_type") == entity_type), depth)


def affected(sources: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """What depends on each source, against the edges (G-14)."""
    return reach(sources, reversed_edges(edges), depth).filter("depth > 0")


def dependencies(sources: DataFrame, edges: DataFrame, depth: int = 3, types: Sequence[str] = V.DEPENDENCY_TYPES) -> DataFrame:
    """What each source depends on, along dependency edges only (G-15)."""
    return reach(sources, edges.filter(F.col("type").isin(*types)), depth).filter("depth > 0")


def ego_graph(centers: DataFrame, edges: DataFrame, radius: int = 2, undirected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each center (G-11)."""
    rest = [f for f in edges.schema.fields if f.name not in ("user_id", "src", "dst")]
    links = L.edge_rows(edges.withColumn("_more", F.struct(*[f.name for f in rest])), more="_more") if rest else L.edge_rows(edges)
    rows, large = L.gathered(L.tagged(L.NODE, centers, "node_id"), links)
    schema = _schema(edges, "src", ("source",), ("dst",), ("src",), *[(f.name, f.dataType) for f in rest])

    near = _schema(edges, "src", ("source",), ("node",), ("depth", IntegerType()))

    def search(g: L.Graphs):
        a, b = g.a[g.edge], g.b[g.edge]
        g.start_at(g.a[g.of(L.NODE)])
        g.walk(np.concatenate([a, b]), np.concatenate([b, a])) if undirected else g.walk(a, b)
        g.search(radius)

    def around(g: L.Graphs):
        search(g)
        for cells in L.pieces(np.flatnonzero(g.depth >= 0)):
            yield _table(near, g.name(g.vertex[cells]), g.id(g.start(cells)), g.id(g.vertex[cells]), g.depth[cells])

    def run(g: L.Graphs):
        search(g)
        g.walk(g.a[g.edge], g.b[g.edge])
        for cells in L.pieces(np.flatnonzero(g.depth >= 0)):
            which, step, to = g.expand(cells)
            which, step, to = (x[g.depth[to] >= 0] for x in (which, step, to))
            out = [g.name(g.vertex[to]), g.id(g.start(to)), g.id(g.vertex[to]), g.id(g.vertex[cells[which]])]
            if rest:
                more = g.rows["more"].combine_chunks().take(pa.array(g.edge[g.step[step]]))
                out += [more.field(f.name) for f in rest]
            yield _table(schema, *out)

    inside, within = L.in_tasks(rows, around, near), L.in_tasks(rows, run, schema)
    if large is None:
        return inside, within
    far_centers, far_edges = _only(large, centers, edges)
    far = _reach_in_rounds(far_centers, both_ways(far_edges) if undirected else far_edges, radius)
    return inside.unionByName(far), within.unionByName(_within_by_joins(far, far_edges))


def _within_by_joins(inside: DataFrame, edges: DataFrame) -> DataFrame:
    ids = inside.select("user_id", "source", "node")
    within = (edges.join(ids.withColumnRenamed("node", "src"), ["user_id", "src"])
              .join(ids.withColumnRenamed("node", "dst"), ["user_id", "source", "dst"], "left_semi"))
    return within


# ---- components ------------------------------------------------------------------
def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component) with the smallest member as label (G-10).

    Ids are ordered by a hash first. In each round every node points to its least neighbour below it, pointers are followed
    to their ends, which lie few steps away in a random order, and the edges are carried over to the ends. Minima are
    combined before the shuffle, joined nodes leave the edges, and it ends when no edge is left. ``edges`` holds (src, dst);
    ids must be unique across users. ``vertices`` (id) adds lone nodes.
    """
    at = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    pairs = edges.filter("src <> dst").select(at("src").alias("a"), at("dst").alias("b"))
    links = cut(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    labels = links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        up = cut(links.groupBy("hi").agg(F.min("lo").alias("to")))
        while not up.join(up.select(F.col("hi").alias("to")), "to", "left_semi").isEmpty():
            further = up.select(F.col("hi").alias("to"), F.col("to").alias("end"))
            up = cut(up.join(further, "to", "left").select("hi", F.coalesce("end", "to").alias("to")))
        labels = cut(labels.join(up.withColumnRenamed("hi", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        open_ = links.join(up, "hi").filter("lo <> to").select(F.col("to").alias("a"), "lo")
        moved = open_.join(up.select(F.col("hi").alias("lo"), F.col("to").alias("end")), "lo", "left").select("a", F.coalesce("end", "lo").alias("b"))
        links = cut(moved.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    least = labels.groupBy("root").agg(F.min("node.id").alias("component"))
    out = labels.join(least, "root").select(F.col("node.id").alias("id"), "component")
    if vertices is None:
        return out
    return vertices.select("id").distinct().join(out, "id", "left").withColumn("component", F.coalesce("component", "id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, node_id, component) of graphs per user, with the smallest node as label (G-10): of every node, and of what only edges name."""
    rows, large = L.gathered(L.tagged(L.NODE, nodes, "node_id"), L.edge_rows(edges))
    schema = _schema(edges, "src", ("node_id",), ("component",))

    def run(g: L.Graphs):
        every = np.arange(g.n)
        yield _table(schema, g.name(every), g.id(every), g.id(g.least(g.a[g.edge], g.b[g.edge])))

    found = L.in_tasks(rows, run, schema)
    if large is None:
        return found
    far_nodes, far_edges = _only(large, nodes, edges)
    at = lambda c: F.struct("user_id", F.col(c).alias("node"))
    ids = far_nodes.select(at("node_id").alias("id"))
    far = connected_components(far_edges.select(at("src").alias("src"), at("dst").alias("dst")), ids.unionByName(far_edges.select(F.explode(F.array(at("src"), at("dst"))).alias("id"))))
    return found.unionByName(far.select("id.user_id", F.col("id.node").alias("node_id"), F.col("component.node").alias("component")))


# ---- ranking -----------------------------------------------------------------------
def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6,
             weight: str = "strength", edges_in_task: int = EDGES_IN_TASK) -> DataFrame:
    """Weighted rank per user graph, dangling mass spread evenly (G-05).

    Ranks of a user sum to one. A graph is done when its ranks moved by less than its number of nodes times
    ``tolerance`` in a round, or after ``iterations``. Graphs of up to ``edges_in_task`` rows are ranked many at a time in tasks, larger ones in rounds of joins, by the same rule.
    """
    schema = _schema(nodes, "node_id", ("node_id",), ("rank", DoubleType()))
    known = nodes.select("user_id", "node_id").filter("user_id is not null")
    given = edges.filter("user_id is not null and src is not null")
    rows, large = L.gathered(L.tagged(L.NODE, known, "node_id"), L.tagged(L.EDGE, given, "src", "dst", weight=weight), bound=edges_in_task)
    small = L.in_tasks(rows, lambda g: _ranked(g, schema, iterations, damping, tolerance), schema)
    if large is None:
        return small
    known, given = (t.join(large, "user_id", "left_semi") for t in (known, given))
    ids = known.distinct()
    sizes = ids.groupBy("user_id").agg(F.count("*").alias("n"))
    merged = given.groupBy("user_id", "src", "dst").agg(F.sum(weight).alias("w"))
    totals = merged.groupBy("user_id", "src").agg(F.sum("w").alias("total"))
    flow = cut(merged.join(totals, ["user_id", "src"]).filter("total > 0").select("user_id", "src", "dst", (F.col("w") / F.col("total")).alias("share")))
    has_out = flow.select("user_id", F.col("src").alias("node_id")).distinct().withColumn("_out", F.lit(True))
    base = ids.join(sizes, "user_id").join(has_out, ["user_id", "node_id"], "left").select("user_id", "node_id", "n", F.col("_out").isNull().alias("dangling"))
    return small.unionByName(_ranked_in_rounds(base, flow, iterations, damping, tolerance))


def _ranked(g: L.Graphs, schema: StructType, iterations: int, damping: float, tolerance: float):
    """All graphs step together; those that are done keep their ranks and leave."""
    nodes = np.unique(g.a[g.of(L.NODE)])
    place = np.full(g.n, -1)
    place[nodes] = np.arange(len(nodes))
    user = g.user[nodes]
    n = np.bincount(user, minlength=len(g.users)).astype(float)
    src, dst, w = g.a[g.edge], g.b[g.edge], np.nan_to_num(g.numbers("weight")[g.edge])
    total = np.bincount(src, w, g.n)
    loose = ~(total > 0)[nodes]  # a node without weight to give spreads its rank
    # an edge that leads nowhere takes its share along
    links = (total[src] > 0) & (place[src] >= 0) & (place[dst] >= 0) & ~g.rows["b"].is_null().to_numpy()[g.edge]
    src, dst, share = place[src[links]], place[dst[links]], w[links] / total[src[links]]
    rank, out = 1.0 / n[user], np.empty(len(nodes))
    at = np.arange(len(nodes))  # nodes whose graphs are not done
    for _ in range(iterations):
        if not len(at):
            break
        spare = np.bincount(user, np.where(loose, rank, 0.0), len(n))
        new = damping * (np.bincount(dst, share * rank[src], len(at)) + spare[user] / n[user]) + (1 - damping) / n[user]
        moved, rank = np.bincount(user, np.abs(new - rank), len(n)), new
        done = (moved < n * tolerance)[user]
        if done.any():
            out[at[done]] = rank[done]
            stay, to = ~done, np.cumsum(~done) - 1
            links = stay[src]
            src, dst, share = to[src[links]], to[dst[links]], share[links]
            at, rank, user, loose = at[stay], rank[stay], user[stay], loose[stay]
    out[at] = rank
    yield _table(schema, g.name(nodes), g.id(nodes), out)


def _ranked_in_rounds(base: DataFrame, flow: DataFrame, iterations: int, damping: float, tolerance: float) -> DataFrame:
    ranks, done = cut(base.withColumn("rank", 1.0 / F.col("n"))), []
    for _ in range(iterations):
        loose = ranks.groupBy("user_id").agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("loose"))
        inflow = (flow.join(ranks.select("user_id", F.col("node_id").alias("src"), "rank"), ["user_id", "src"])
                  .groupBy("user_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("share") * F.col("rank")).alias("inflow")))
        new = damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("loose") / F.col("n")) + (1 - damping) / F.col("n")
        stepped = cut(ranks.withColumnRenamed("rank", "_old").join(inflow, ["user_id", "node_id"], "left").join(loose, "user_id")
                      .select("user_id", "node_id", "n", "dangling", new.alias("rank"), F.abs(new - F.col("_old")).alias("_moved")))
        settled = cut(stepped.groupBy("user_id").agg(F.sum("_moved").alias("d"), F.first("n").alias("n")).filter(F.col("d") < F.col("n") * tolerance).select("user_id"))
        done.append(stepped.join(settled, "user_id", "left_semi").select("user_id", "node_id", "rank"))
        ranks = stepped.join(settled, "user_id", "left_anti").drop("_moved")
        if ranks.isEmpty():
            break
    out = ranks.select("user_id", "node_id", "rank")
    for more in done:
        out = out.unionByName(more)
    return out


def concept_importance(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rank times node confidence (G-05)."""
    return ranks.join(nodes.select("user_id", "node_id", "confidence"), ["user_id", "node_id"]).withColumn(
        "importance", F.col("rank") * F.coalesce("confidence", F.lit(0.5)))


def min_max(df: DataFrame, value: str, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Scale a score to 0 … 1 within each group; a constant group stays as it is."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return df.join(span, keys).withColumn(value, scaled).drop("_lo", "_hi")


def closeness(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Incoming closeness, scaled by the share of the graph that reaches the node (G-06)."""
    nodes = nodes.filter("user_id is not null")
    rows, large = L.gathered(L.tagged(L.NODE, nodes, "node_id"), L.edge_rows(edges))
    schema = _schema(edges, "src", ("node_id",), ("n", LongType()), ("k", LongType()), ("total", LongType()))

    def run(g: L.Graphs):
        mine = g.a[g.of(L.NODE)]
        g.start_at(np.arange(g.n))
        g.walk(g.a[g.edge], g.b[g.edge])
        g.search(max_depth)
        k, total = (np.bincount(g.vertex[g.depth > 0], w, g.n).astype(np.int64) for w in (None, g.depth[g.depth > 0]))
        yield _table(schema, g.name(mine), g.id(mine), np.bincount(g.user[mine], minlength=len(g.users))[g.user[mine]], k[mine], total[mine])

    df = L.in_tasks(rows, run, schema)
    if large is not None:
        df = df.unionByName(_far_sums(*_only(large, nodes, edges), max_depth))
    value = F.when((F.col("k") > 0) & (F.col("n") > 1), F.col("k") / F.col("total") * (F.col("k") / (F.col("n") - 1))).otherwise(0.0)
    return df.select("user_id", "node_id", value.alias("closeness"))


def _far_sums(nodes: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    sizes = nodes.groupBy("user_id").agg(F.count("*").alias("n"))
    to_node = _reach_in_rounds(nodes, reversed_edges(edges), max_depth).filter("depth > 0")
    sums = to_node.groupBy("user_id", F.col("source").alias("node_id")).agg(F.count("*").alias("k"), F.sum("depth").alias("total"))
    return nodes.select("user_id", "node_id").join(sizes, "user_id").join(sums, ["user_id", "node_id"], "left")


def betweenness(nodes: DataFrame, edges: DataFrame, weight: str = "strength", batches: int = 1) -> DataFrame:
    """Share of lightest paths that run through a node (G-06), with edge weights as distances.

    Of equally light paths those with fewer edges of weight zero count, so that a ring of such edges lengthens a path and everything ends; loops at a node are on no path
    and weights below zero count as zero. Distances relax over all sources at once; path counts then flow along tight edges in
    order of distance, and dependencies flow back. Rounds stop when nothing changes. With ``batches`` the sources are taken in so many
    parts one after the other, since what is held grows with sources times nodes. Graphs of few rows are settled in tasks.
    """
    ids = nodes.select("user_id", "node_id").distinct()
    light = edges.filter("src <> dst").select("user_id", "src", "dst", F.greatest(F.round(weight, 9), F.lit(0.0)).alias("w")).filter("w is not null")
    rows, large = L.gathered(L.tagged(L.NODE, ids, "node_id"), L.edge_rows(light, w="w"))
    schema = _schema(edges, "src", ("node_id",), ("g", DoubleType()), ("n", LongType()))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    small = L.in_tasks(rows, lambda g: _between(g, schema), schema).filter("user_id is not null").select("user_id", "node_id", (F.col("g") * scale).alias("betweenness"))
    return small if large is None else small.unionByName(_between_by_joins(*_only(large, ids, light), batches))


def _between(g: L.Graphs, schema: StructType):
    mine = g.a[g.of(L.NODE)]
    a, b, w = g.a[g.edge], g.b[g.edge], g.numbers("w")[g.edge]
    least = L.firsts(w, b, a)
    g.start_at(mine)
    g.walk(a[least], b[least])
    w = w[least][g.step]
    far, zero = np.full(len(g.vertex), np.inf), np.zeros(len(g.vertex), np.int64)
    far[g.front], front = 0.0, g.front
    while len(front):
        which, step, to = g.expand(front)
        d, k = np.round(far[front][which] + w[step], 9), zero[front][which] + (w[step] == 0)
        better = (d < far[to]) | ((d == far[to]) & (k < zero[to]))
        d, k, to = d[better], k[better], to[better]
        order = np.lexsort((k, d, to))
        order = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
        front = to[order]
        far[front], zero[front] = d[order], k[order]
    reached = np.flatnonzero(far < np.inf)
    which, step, to = g.expand(reached)
    at = reached[which]
    tight = (np.abs(far[at] + w[step] - far[to]) < 1e-9) & (zero[at] + (w[step] == 0) == zero[to])
    at, to = at[tight], to[tight]
    # counts by number of edges walked; every lightest path has some length
    walk = np.zeros(len(far))
    walk[g.front] = 1.0
    sigma = walk.copy()
    while (walk := np.bincount(to, walk[at], len(far))).any():
        sigma += walk
    share, total = sigma[at] / sigma[to], np.zeros(len(far))
    back = (far < np.inf).astype(float)
    while (back := np.bincount(at, share * back[to], len(far))).any():
        back[g.front] = 0.0
        total += back
    sums = np.bincount(g.vertex, total, g.n)
    yield _table(schema, g.name(mine), g.id(mine), sums[mine], np.bincount(g.user[mine], minlength=len(g.users))[g.user[mine]])


def _between_by_joins(ids: DataFrame, light: DataFrame, batches: int) -> DataFrame:
    e = cut(light.groupBy("user_id", "src", "dst").agg(F.min("w").alias("w")).withColumn("z", (F.col("w") == 0).cast("int")))
    totals = []
    for batch in range(batches):
        sources = ids.filter(F.pmod(F.xxhash64("user_id", "node_id"), F.lit(batches)) == batch)
        part = _dependencies(sources, e)
        if part is not None:
            totals.append(part)
    sizes = ids.groupBy("user_id").agg(F.count("*").alias("n"))
    base = ids.join(sizes, "user_id")
    if not totals:
        return base.select("user_id", "node_id", F.lit(0.0).alias("betweenness"))
    total = totals[0]
    for more in totals[1:]:
        total = total.unionByName(more)
    sums = total.groupBy("user_id", F.col("t").alias("node_id")).agg(F.sum("g").alias("g"))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    return base.join(sums, ["user_id", "node_id"], "left").select(
        "user_id", "node_id", (F.coalesce("g", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(sources: DataFrame, e: DataFrame) -> DataFrame | None:
    """(user_id, t, g): what each node carries of the paths from the sources, over edges (user_id, src, dst, w, z) with z for weight zero."""
    keys = ["user_id", "s", "t"]
    far = F.struct(F.round(F.col("d") + F.col("w"), 9).alias("d"), (F.col("k") + F.col("z")).alias("k"))
    dist = cut(sources.select("user_id", F.col("node_id").alias("s"), F.col("node_id").alias("t"), F.lit(0.0).alias("d"), F.lit(0).alias("k")))
    front = dist
    while True:
        # only pairs that improved in the last round can improve others
        longer = front.join(e.withColumnRenamed("src", "t"), ["user_id", "t"]).groupBy("user_id", "s", F.col("dst").alias("t")).agg(F.min(far).alias("f"))
        known = dist.select(*keys, F.struct("d", "k").alias("_f"))
        front = cut(longer.join(known, keys, "left").filter(F.col("_f").isNull() | (F.col("f") < F.col("_f"))).select(*keys, "f.d", "f.k"))
        if front.isEmpty():
            break
        dist = cut(dist.join(front.select(*keys), keys, "left_anti").unionByName(front))
    a = dist.select("user_id", "s", F.col("t").alias("src"), F.col("d").alias("da"), F.col("k").alias("ka"))
    b = dist.select("user_id", "s", F.col("t").alias("dst"), F.col("d").alias("db"), F.col("k").alias("kb"))
    tight = cut(a.join(e, ["user_id", "src"]).join(b, ["user_id", "s", "dst"])
                .filter((F.abs(F.col("da") + F.col("w") - F.col("db")) < 1e-9) & (F.col("ka") + F.col("z") == F.col("kb"))).select("user_id", "s", "src", "dst"))
    # counts by number of edges walked; every lightest path has some length
    walk = sources.select("user_id", F.col("node_id").alias("s"), F.col("node_id").alias("t"), F.lit(1.0).alias("c"))
    counts = walk
    while True:
        walk = cut(walk.join(tight.withColumnRenamed("src", "t"), ["user_id", "s", "t"])
                   .groupBy("user_id", "s", F.col("dst").alias("t")).agg(F.sum("c").alias("c")))
        if walk.isEmpty():
            break
        counts = counts.unionByName(walk)
    sigma = cut(counts.groupBy("user_id", "s", "t").agg(F.sum("c").alias("sigma")))
    sa = sigma.select("user_id", "s", F.col("t").alias("src"), F.col("sigma").alias("sig_a"))
    sb = sigma.select("user_id", "s", F.col("t").alias("dst"), F.col("sigma").alias("sig_b"))
    share = cut(tight.join(sa, ["user_id", "s", "src"]).join(sb, ["user_id", "s", "dst"])
                .select("user_id", "s", "src", "dst", (F.col("sig_a") / F.col("sig_b")).alias("r")))
    back = sigma.filter("s <> t").select("user_id", "s", "t", F.lit(1.0).alias("g"))
    total = None
    while True:
        back = (share.join(back.withColumnRenamed("t", "dst"), ["user_id", "s", "dst"])
                .groupBy("user_id", "s", F.col("src").alias("t")).agg(F.sum(F.col("r") * F.col("g")).alias("g")))
        back = cut(back.filter("s <> t"))
        if back.isEmpty():
            return total
        total = back.select("user_id", "t", "g") if total is None else total.unionByName(back.select("user_id", "t", "g"))


# ---- spreading ---------------------------------------------------------------------
def one_hop_reinforcement(nodes: DataFrame, edges: DataFrame, sources: DataFrame, factor: float = 0.8, mode: str = "parity") -> DataFrame:
    """Confidence of the neighbours of reinforced nodes (G-07).

    The established formula lowers it; ``mode="boost"`` raises it by the propagated strength instead.
    Several reinforced neighbours multiply.
    """
    s = sources.select("user_id", F.col("node_id").alias("src"))
    w = F.coalesce("strength", F.lit(0.5))
    change = 1 + (w * factor - w) if mode == "parity" else 1 + w * factor
    hits = (edges.join(s, ["user_id", "src"], "left_semi").groupBy("user_id", F.col("dst").alias("node_id"))
            .agg(F.product(change).alias("_m"), F.count("*").alias("hits")))
    return nodes.join(hits, ["user_id", "node_id"]).select(
        "user_id", "node_id", F.least(F.lit(1.0), F.col("confidence") * F.col("_m")).alias("confidence"), "hits")


def spread_confidence(sources: DataFrame, edges: DataFrame, factor: float = 0.5, max_depth: int = 3,
                      types: Sequence[str] = ("reinforces", "related_to")) -> DataFrame:
    """Confidence gained by nodes around reinforced traits (G-08): per source, node and summed boost.

    A visited node sends ``factor · strength · (1 − depth/max)`` along each allowed edge to nodes
    not visited before it.
    """
    allowed = edges.filter(F.col("type").isin(*types) & F.col("strength").isNotNull()).select("user_id", "src", "dst", "strength")
    rows, large = L.gathered(L.tagged(L.NODE, sources, "node_id"), L.edge_rows(allowed, w="strength"))
    schema = _schema(edges, "src", ("source",), ("node_id",), ("boost", DoubleType()), ("edges_used", LongType()))

    def run(g: L.Graphs):
        w = g.numbers("w")[g.edge]
        g.start_at(g.a[g.of(L.NODE)])
        g.walk(g.a[g.edge], g.b[g.edge])
        g.search(max_depth)
        near = np.flatnonzero(g.depth >= 0)
        which, step, to = g.expand(near)
        da, db, later = g.depth[near][which], g.depth[to], g.vertex[to] > g.vertex[near][which]
        boost = factor * w[g.step][step] * (1 - da / max_depth)
        sent = ((db < 0) | (db > da) | ((db == da) & later)) & (boost > 0)
        used = np.bincount(to[sent], minlength=len(g.vertex))
        total, cells = np.bincount(to[sent], boost[sent], len(g.vertex)), np.flatnonzero(used)
        yield _table(schema, g.name(g.vertex[cells]), g.id(g.start(cells)), g.id(g.vertex[cells]), total[cells], used[cells])

    found = L.in_tasks(rows, run, schema)
    return found if large is None else found.unionByName(_confidence_by_joins(*_only(large, sources, allowed), factor, max_depth))


def _confidence_by_joins(sources: DataFrame, allowed: DataFrame, factor: float, max_depth: int) -> DataFrame:
    # a node expands at its first distance; it may send to nodes at the same or a later distance
    near = _reach_in_rounds(sources, allowed, max_depth)
    a = near.select("user_id", "source", F.col("node").alias("src"), F.col("depth").alias("da"))
    b = near.select("user_id", "source", F.col("node").alias("dst"), F.col("depth").alias("db"))
    sent = (a.join(allowed, ["user_id", "src"]).join(b, ["user_id", "source", "dst"], "left")
            .filter((F.coalesce("db", F.lit(max_depth + 1)) > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("dst") > F.col("src")))))
    boost = factor * F.col("strength") * (1 - F.col("da") / max_depth)
    return (sent.withColumn("boost", boost).filter("boost > 0").groupBy("user_id", "source", F.col("dst").alias("node_id"))
            .agg(F.sum("boost").alias("boost"), F.count("*").alias("edges_used")))


def spread_importance(sources: DataFrame, edges: DataFrame, factor: float = 0.7, floor: float = 0.01) -> DataFrame:
    """Importance passed on from each source (G-09): strength times ``factor`` per hop while above ``floor``,
    until nothing is left to pass on.

    Every node expands once, with the value that reaches it first; what a node receives sums up.
    ``sources`` carries (user_id, node_id, importance).
    """
    rows, large = L.gathered(L.tagged(L.NODE, sources, "node_id", w="importance"), L.edge_rows(edges.filter("strength is not null"), w="strength"))
    schema = _schema(edges, "src", ("source",), ("node_id",), ("importance", DoubleType()))

    def run(g: L.Graphs):
        w, mine = g.numbers("w"), g.of(L.NODE)
        a, b, strength = g.a[g.edge], g.b[g.edge], w[g.edge]
        most = L.firsts(-strength, b, a)
        g.start_at(g.a[mine])
        g.walk(a[most], b[most])
        strength = strength[most][g.step]
        total, hit, seen = (np.zeros(len(g.vertex), t) for t in (float, bool, bool))
        front, value = g.front[np.searchsorted(g.starts, g.a[mine])], w[mine]
        seen[front] = True
        while len(front):
            which, step, to = g.expand(front)
            sent = value[which] * strength[step] * factor
            to, sent = to[sent > floor], sent[sent > floor]
            np.add.at(total, to, sent)
            hit[to] = True
            # of the values arriving in one round the largest counts as the first
            to, sent = to[~seen[to]], sent[~seen[to]]
            order = np.lexsort((-sent, to))
            order = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
            front, value = to[order], sent[order]
            seen[front] = True
        for cells in L.pieces(np.flatnonzero(hit)):
            yield _table(schema, g.name(g.vertex[cells]), g.id(g.start(cells)), g.id(g.vertex[cells]), total[cells])

    found = L.in_tasks(rows, run, schema)
    return found if large is None else found.unionByName(_importance_in_rounds(*_only(large, sources, edges), factor, floor))


def _importance_in_rounds(sources: DataFrame, edges: DataFrame, factor: float, floor: float) -> DataFrame:
    step = edges.groupBy("user_id", F.col("src").alias("node"), F.col("dst").alias("next")).agg(F.max("strength").alias("strength"))
    front = sources.select("user_id", F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.col("importance").alias("value"))
    seen = front.select("user_id", "source", "node")
    got = None
    while True:
        sent = (front.join(step, ["user_id", "node"])
                .select("user_id", "source", F.col("node").alias("sender"), F.col("next").alias("node"), (F.col("value") * F.col("strength") * factor).alias("value"))
                .filter(F.col("value") > floor))
        sent = cut(sent)
        if got is not None and sent.isEmpty():
            break
        got = sent.select("user_id", "source", "node", "value") if got is None else got.unionByName(sent.select("user_id", "source", "node", "value"))
        keys = ["user_id", "source", "node"]
        # of the values arriving in one round the largest counts as the first
        front = sent.groupBy(*keys).agg(F.max("value").alias("value")).join(seen, keys, "left_anti")
        front = cut(front)
        seen = seen.unionByName(front.select(*keys))
    return got.groupBy("user_id", "source", F.col("node").alias("node_id")).agg(F.sum("value").alias("importance"))


# ---- statistics and upkeep -----------------------------------------------------------
def clustering_coefficient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean local clustering of the undirected graph per user; triangles come from an ordered join."""
    und = both_ways(edges).filter("src <> dst")
    deg = und.groupBy("user_id", F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    up = und.filter("src < dst")
    ab, bc = up.select("user_id", F.col("src").alias("a"), F.col("dst").alias("b")), up.select("user_id", F.col("src").alias("b"), F.col("dst").alias("c"))
    ac = up.select("user_id", F.col("src").alias("a"), F.col("dst").alias("c"))
    tri = ab.join(bc, ["user_id", "b"]).join(ac, ["user_id", "a", "c"], "left_semi")
    per_node = tri.select("user_id", F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("user_id", "node_id").agg(F.count("*").alias("t"))
    local = (nodes.select("user_id", "node_id").join(deg, ["user_id", "node_id"], "left").join(per_node, ["user_id", "node_id"], "left"))
    c = F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return local.groupBy("user_id").agg(F.avg(c).alias("avg_clustering"))


def distance_sums(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, total, pairs): the summed distances and the number of ordered pairs of different nodes that reach each other along edges.

    Breadth-first from 64 sources at once: a node holds one long per group of sources, a bit for each that has reached it, and bits are combined before
    they are shuffled. What is held is a row per node and 64 sources, not one per pair.
    """
    step = cut(edges.select("user_id", F.col("src").alias("node"), F.col("dst").alias("next")).filter("node <> next").distinct())
    ids = nodes.select("user_id", F.col("node_id").alias("node")).distinct()
    sizes = ids.groupBy("user_id").agg(F.ceil(F.count("*") / 48).alias("_parts"))
    dealt = ids.join(sizes, "user_id").withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    place = F.row_number().over(Window.partitionBy("user_id", "part").orderBy("node")) - 1
    front = dealt.withColumn("_at", place).select(
        "user_id", F.struct("part", F.floor(F.col("_at") / 64).alias("more")).alias("group"), "node", F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("bits"))
    keys = ["user_id", "group", "node"]
    front = cut(front)
    seen, sums, depth = front, [], 0
    while True:
        depth += 1
        sent = (front.join(step, ["user_id", "node"]).groupBy("user_id", "group", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits")))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        front = cut(sent.join(seen.withColumnRenamed("bits", "_seen"), keys, "left").select(*keys, fresh.alias("bits")).filter("bits <> 0"))
        if front.isEmpty():
            break
        sums.append(front.groupBy("user_id").agg(F.sum(F.bit_count("bits")).alias("pairs")).withColumn("total", F.col("pairs") * depth))
        seen = cut(seen.unionByName(front).groupBy(*keys).agg(F.bit_or("bits").alias("bits")))
    if not sums:
        return ids.select("user_id", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("pairs")).limit(0)
    every = sums[0]
    for more in sums[1:]:
        every = every.unionByName(more)
    return every.groupBy("user_id").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, density, clustering, weak components, degree centrality, mean shortest path (G-12).

    The mean path is given for graphs in one piece, and distances are taken in those alone.
    """
    rows, large = L.gathered(L.tagged(L.NODE, nodes, "node_id"), L.edge_rows(edges))
    long = LongType()
    schema = _schema(edges, "src", ("n_nodes", long), ("n_edges", long), ("avg_clustering", DoubleType()), ("weak_components", long), ("total", long), ("pairs", long))
    df = L.in_tasks(rows, lambda g: _described(g, schema), schema).filter("user_id is not null").withColumn(
        "density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))
    if large is not None:
        df = df.unionByName(_described_by_joins(*_only(large, nodes, edges)))
    n = F.col("n_nodes")
    return df.withColumns({
        "avg_degree_centrality": F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(1.0),
        "avg_shortest_path": F.when((n > 1) & (F.col("weak_components") == 1) & (F.col("pairs") == n * (n - 1)), F.col("total") / F.col("pairs"))}).drop("total", "pairs")


def _described(g: L.Graphs, schema: StructType):
    mine = g.a[g.of(L.NODE)]
    per = lambda users, w=None: np.bincount(users, w, len(g.users))
    pair = np.unique(g.a[g.edge] * g.n + g.b[g.edge])
    a, b = pair // g.n, pair % g.n
    und = np.unique(np.concatenate([pair, b * g.n + a]))
    x, y = und // g.n, und % g.n
    und, x, y = (v[x != y] for v in (und, x, y))
    degree, up = np.bincount(x, minlength=g.n), x < y
    lo, hi, first = x[up], y[up], np.searchsorted(x[up], np.arange(g.n + 1))
    wedges = first[hi + 1] - first[hi]
    which = np.repeat(np.arange(len(lo)), wedges)
    end = hi[first[hi][which] + np.arange(len(which)) - (np.cumsum(wedges) - wedges)[which]]
    closed = np.isin(lo[which] * g.n + end, und)
    corners = np.concatenate([lo[which][closed], hi[which][closed], end[closed]])
    triangles = np.bincount(corners, minlength=g.n)
    local = np.where(degree > 1, 2.0 * triangles / np.maximum(degree * (degree - 1), 1), 0.0)
    nodes = np.unique(mine)
    parts = np.unique(g.least(a, b)[nodes[~g.id(nodes).is_null().to_numpy(zero_copy_only=False)]])
    g.start_at(nodes)
    g.walk(x, y)
    g.search()
    far = np.flatnonzero(g.depth > 0)
    owner, users = g.user[g.vertex[far]], np.flatnonzero(per(g.user[mine]))
    n = per(g.user[mine])
    out = [n, per(g.user[a]), per(g.user[mine], local[mine]) / np.maximum(n, 1), per(g.user[parts]), per(owner, g.depth[far]).astype(np.int64), per(owner)]
    yield _table(schema, g.users.take(pa.array(users)), *[v[users] for v in out])


def _described_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    from engram.operators.entropy import density
    pair = cut(edges.select("user_id", "src", "dst").distinct())
    base = density(nodes, pair)
    name = lambda c: F.concat(F.col("user_id").cast("string"), F.lit("\u0001"), F.col(c).cast("string"))
    comp = connected_components(pair.select(name("src").alias("src"), name("dst").alias("dst")), nodes.select(name("node_id").alias("id")))
    parts = cut(comp.select(F.split("id", "\u0001")[0].alias("_u"), "component").groupBy("_u").agg(F.count_distinct("component").alias("weak_components")))
    whole = parts.filter("weak_components = 1").select("_u")
    one = lambda df: df.join(whole, F.col("_u") == F.col("user_id").cast("string"), "left_semi")
    far = distance_sums(one(nodes), one(both_ways(pair)))
    return (base.join(clustering_coefficient(nodes, pair), "user_id", "left")
            .join(parts, F.col("_u") == F.col("user_id").cast("string"), "left").drop("_u").join(far, "user_id", "left"))


def upsert_edges(edges: DataFrame, new: DataFrame, mode: str = "strengthen", as_of: Column | None = None) -> DataFrame:
    """Insert edges or update known ones, keyed by user, ends and type (G-17).

    ``strengthen`` adds 0.1 to a known edge, ``set`` takes the new strength.
    """
    from engram.sources.store import upsert
    fresh = new.groupBy("user_id", "src", "dst", "type").agg(F.max("strength").alias("strength"), F.count("*").alias("n"))
    known, seen = F.col("base.strength"), F.col("delta.strength")
    again = F.least(F.lit(1.0), known + 0.1 * F.col("delta.n")) if mode == "strengthen" else seen
    first = F.least(F.lit(1.0), seen + 0.1 * (F.col("delta.n") - 1)) if mode == "strengthen" else seen
    return upsert(edges.select("user_id", "src", "dst", "type", "strength", "evidence_count"), fresh, ["user_id", "src", "dst", "type"], {
        "strength": F.when(known.isNull(), first).when(seen.isNull(), known).otherwise(again),
        "evidence_count": F.coalesce("base.evidence_count", F.lit(0)) + F.coalesce("delta.n", F.lit(0))})


def prune_nodes(nodes: DataFrame, count: str, has_links: Column | None = None) -> DataFrame:
    """Retire nodes without evidence or links (G-18)."""
    alive = ~F.coalesce("retired", F.lit(False))
    dead = (F.coalesce("confidence", F.lit(0.0)) <= V.DEAD_NODE_CONFIDENCE) & (F.coalesce(count, F.lit(0)) <= 1)
    dead = alive & (dead & ~has_links if has_links is not None else dead)
    return nodes.withColumns({"retired": F.coalesce("retired", F.lit(False)) | dead, "pruned": dead,
                              "confidence": F.when(dead, 0.0).otherwise(F.col("confidence"))})


def strengthen_edges(edges: DataFrame, count: str = "evidence_count") -> DataFrame:
    """Edges seen repeatedly gain 0.05, up to one (G-18)."""
    again = (F.coalesce(count, F.lit(0)) >= 2) & (F.coalesce("strength", F.lit(0.0)) < 0.95)
    known = F.coalesce(F.when(F.col("strength") != 0, F.col("strength")), F.lit(0.5))
    return edges.withColumns({"strengthened": again, "strength": F.when(again, F.least(F.lit(1.0), known + 0.05)).otherwise(F.col("strength"))})
