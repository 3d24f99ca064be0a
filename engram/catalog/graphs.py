"""Graph queries over the per-customer graphs of consecutive order lines (G-01 … G-18, J-10 … J-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog.registry import query, r6
from engram.operators import graph as G
from engram.operators import identity as I

BOTH = "SELECT DISTINCT user_id, src, dst FROM (SELECT user_id, src, dst FROM edges_v UNION ALL SELECT user_id, dst, src FROM edges_v)"


def reach_sql(edges: str, depth: int, sources: str = "SELECT user_id, node_id FROM nodes_v") -> str:
    """CTEs ending in ``near(user_id, source, node, depth)`` with shortest distances."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT user_id, src, dst FROM ({edges})),
      walk AS (SELECT user_id, node_id AS source, node_id AS node, 0 AS depth FROM ({sources})
        UNION SELECT w.user_id, w.source, e.dst, w.depth + 1 FROM walk w JOIN e ON e.user_id = w.user_id AND e.src = w.node WHERE w.depth < {depth}),
      near AS (SELECT user_id, source, node, MIN(depth) AS depth FROM walk GROUP BY user_id, source, node)"""


def all_reach_sql(edges: str, sources: str = "SELECT user_id, node_id FROM nodes_v") -> str:
    """The same without a depth: a node enters ``near`` once, when it is first reached."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT user_id, src, dst FROM ({edges})),
      near(user_id, source, node, depth) USING KEY (user_id, source, node) AS (SELECT user_id, node_id, node_id, 0 FROM ({sources})
        UNION SELECT w.user_id, w.source, e.dst, w.depth + 1 FROM near w JOIN e ON e.user_id = w.user_id AND e.src = w.node
          WHERE NOT EXISTS (SELECT 1 FROM recurring.near r WHERE r.user_id = w.user_id AND r.source = w.source AND r.node = e.dst))"""


def source_nodes(t):
    return t.nodes_v.select("user_id", "node_id")


@query("g_01", """SELECT user_id, src, dst FROM edges_v e WHERE EXISTS (SELECT 1 FROM nodes_v n WHERE n.user_id = e.user_id AND n.node_id = e.src AND n.confidence >= 0.5)
    AND EXISTS (SELECT 1 FROM nodes_v n WHERE n.user_id = e.user_id AND n.node_id = e.dst AND n.confidence >= 0.5)""")
def g_01(t):
    return G.build(t.nodes_v, t.edges_v, 0.5)[1].select("user_id", "src", "dst")


@query("j_10", """SELECT user_id, COUNT(*) AS n_edges FROM edges_v e WHERE EXISTS (SELECT 1 FROM nodes_v n WHERE n.user_id = e.user_id AND n.node_id = e.src AND n.confidence >= 0.3)
    AND EXISTS (SELECT 1 FROM nodes_v n WHERE n.user_id = e.user_id AND n.node_id = e.dst AND n.confidence >= 0.3) GROUP BY user_id""")
def j_10(t):
    return G.build(t.nodes_v, t.edges_v, 0.3)[1].groupBy("user_id").agg(F.count("*").alias("n_edges"))


@query("g_02", reach_sql("SELECT * FROM edges_v", 2) + " SELECT user_id, source, node, depth FROM near WHERE depth > 0")
def g_02(t):
    return G.related(source_nodes(t), t.edges_v, source_nodes(t), 2).select("user_id", "source", "node", "depth")


# every node asks for the way to its user's alphabetically first node
FIRST = "SELECT user_id, MIN(node_id) AS target FROM nodes_v GROUP BY user_id"


def first_pairs(t):
    first = t.nodes_v.groupBy("user_id").agg(F.min("node_id").alias("target"))
    return t.nodes_v.select("user_id", F.col("node_id").alias("source")).join(first, "user_id")


@query("g_03", all_reach_sql("SELECT * FROM edges_v") + f""", first AS ({FIRST})
    SELECT n.user_id, source, target, depth FROM near n JOIN first f ON f.user_id = n.user_id AND f.target = n.node""")
def g_03(t):
    found = G.shortest_paths(first_pairs(t), t.edges_v)
    ok = F.size("path") == F.col("depth") + 1
    return found.filter(ok).select("user_id", "source", "target", "depth")


@query("g_04", f"""
    WITH e AS (SELECT DISTINCT user_id, src, dst FROM edges_v),
      one AS (SELECT user_id, src AS s, dst AS t, [src, dst] AS path FROM e),
      two AS (SELECT o.user_id, o.s, e.dst AS t, LIST_APPEND(path, e.dst) AS path FROM one o JOIN e ON e.user_id = o.user_id AND e.src = o.t WHERE NOT LIST_CONTAINS(path, e.dst)),
      three AS (SELECT o.user_id, o.s, e.dst AS t, LIST_APPEND(path, e.dst) AS path FROM two o JOIN e ON e.user_id = o.user_id AND e.src = o.t WHERE NOT LIST_CONTAINS(path, e.dst))
    SELECT user_id, ARRAY_TO_STRING(path, '>') AS path FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) JOIN ({FIRST}) f USING (user_id) WHERE t = f.target""")
def g_04(t):
    nodes, edges = t.walks
    first = nodes.groupBy("user_id").agg(F.min("node_id").alias("node_id"))
    return G.simple_paths(None, edges, 3, first).select("user_id", F.array_join("path", ">").alias("path"))


@query("g_05", """
    WITH RECURSIVE m AS MATERIALIZED (SELECT user_id, src, dst, SUM(strength) AS w FROM edges_v GROUP BY ALL),
    flow AS MATERIALIZED (SELECT m.user_id, m.src, m.dst, m.w / t.w AS share FROM m JOIN (SELECT user_id, src, SUM(w) AS w FROM m GROUP BY ALL) t ON t.user_id = m.user_id AND t.src = m.src WHERE t.w > 0),
    base AS MATERIALIZED (SELECT v.user_id, v.node_id, c.n, v.node_id NOT IN (SELECT src FROM flow f WHERE f.user_id = v.user_id) AS dangling
      FROM (SELECT DISTINCT user_id, node_id FROM nodes_v) v JOIN (SELECT user_id, COUNT(DISTINCT node_id) AS n FROM nodes_v GROUP BY user_id) c ON c.user_id = v.user_id),
    r AS (SELECT user_id, node_id, n, dangling, 1e0 / n AS rank, 0 AS i, false AS done FROM base
      UNION ALL SELECT user_id, node_id, n, dangling, new, i + 1, SUM(ABS(new - rank)) OVER (PARTITION BY user_id) < n * 1e-6 FROM (
        SELECT c.user_id, c.node_id, c.n, c.dangling, c.rank, c.i, 0.85 * (COALESCE(x.inflow, 0.0) + l.loose / c.n) + (1 - 0.85) / c.n AS new
        FROM r c JOIN (SELECT user_id, SUM(CASE WHEN dangling THEN rank ELSE 0.0 END) AS loose FROM r GROUP BY user_id) l ON l.user_id = c.user_id
          LEFT JOIN (SELECT f.user_id, f.dst, SUM(f.share * s.rank) AS inflow FROM flow f JOIN r s ON s.user_id = f.user_id AND s.node_id = f.src GROUP BY f.user_id, f.dst) x ON x.user_id = c.user_id AND x.dst = c.node_id
        WHERE NOT c.done AND c.i < 100))
    SELECT user_id, node_id, ROUND(ARG_MAX(rank, i), 6) AS rank FROM r GROUP BY user_id, node_id""")
def g_05(t):
    return G.pagerank(t.nodes_v, t.edges_v).select("user_id", "node_id", r6("rank").alias("rank"))


@query("g_05_settled")
def g_05_settled(t):
    """Ranks of a tighter tolerance."""
    return G.pagerank(t.nodes_v, t.edges_v, tolerance=1e-9).select("user_id", "node_id", r6("rank").alias("rank"))


@query("g_06", all_reach_sql("SELECT user_id, dst AS src, src AS dst FROM edges_v") + """,
      s AS (SELECT user_id, source, COUNT(*) AS k, SUM(depth) AS total FROM near WHERE depth > 0 GROUP BY user_id, source)
    SELECT n.user_id, n.node_id, ROUND(CASE WHEN s.k > 0 AND c.n > 1 THEN s.k / s.total * (s.k / (c.n - 1)) ELSE 0.0 END, 6) AS closeness
    FROM nodes_v n JOIN (SELECT user_id, COUNT(*) AS n FROM nodes_v GROUP BY user_id) c ON c.user_id = n.user_id
      LEFT JOIN s ON s.user_id = n.user_id AND s.source = n.node_id""")
def g_06(t):
    return G.closeness(t.nodes_v, t.edges_v).select("user_id", "node_id", r6("closeness").alias("closeness"))


@query("g_06_betweenness")
def g_06_betweenness(t):
    return G.betweenness(t.nodes_v.select("user_id", "node_id"), t.edges_v).select("user_id", "node_id", r6("betweenness").alias("betweenness"))


STRONG = "SELECT user_id, node_id, importance FROM nodes_v"


def strong(t):
    """Every node as a reinforced source."""
    return t.nodes_v.select("user_id", "node_id", "importance")


@query("g_07", f"""
    SELECT n.user_id, n.node_id, ROUND(LEAST(1.0, n.confidence * m), 6) AS confidence, hits FROM nodes_v n JOIN (
      SELECT e.user_id, e.dst, PRODUCT(1 + (e.strength * 0.8 - e.strength)) AS m, COUNT(*) AS hits FROM edges_v e JOIN ({STRONG}) s ON s.user_id = e.user_id AND s.node_id = e.src
      GROUP BY e.user_id, e.dst) x ON x.user_id = n.user_id AND x.dst = n.node_id""")
def g_07(t):
    return G.one_hop_reinforcement(t.nodes_v, t.edges_v, strong(t)).select("user_id", "node_id", r6("confidence").alias("confidence"), "hits")


@query("g_08", reach_sql("SELECT * FROM edges_v WHERE type IN ('reinforces', 'related_to')", 3, STRONG) + """
    SELECT a.user_id, a.source, e.dst AS node_id, ROUND(SUM(0.5 * e.strength * (1 - a.depth / 3.0)), 6) AS boost, COUNT(*) AS edges_used
    FROM near a JOIN edges_v e ON e.user_id = a.user_id AND e.src = a.node AND e.type IN ('reinforces', 'related_to')
      LEFT JOIN near b ON b.user_id = a.user_id AND b.source = a.source AND b.node = e.dst
    WHERE a.depth < 3 AND (COALESCE(b.depth, 4) > a.depth OR (b.depth = a.depth AND b.node > a.node)) GROUP BY a.user_id, a.source, e.dst""")
def g_08(t):
    rows = G.spread_confidence(strong(t), t.edges_v)
    return rows.select("user_id", "source", "node_id", r6("boost").alias("boost"), "edges_used")


def _importance_sql(depth: int) -> str:
    ctes = [f"s0 AS (SELECT user_id, node_id AS source, node_id AS node, importance AS value FROM ({STRONG}))",
            "seen0 AS (SELECT user_id, source, node FROM s0)"]
    for i in range(1, depth + 1):
        ctes.append(f"""sent{i} AS (SELECT s.user_id, s.source, e.dst AS node, s.value * e.strength * 0.70710678 AS value FROM s{i - 1} s JOIN edges_v e ON e.user_id = s.user_id AND e.src = s.node
            WHERE s.value * e.strength * 0.70710678 > 0.01)""")
        ctes.append(f"""s{i} AS (SELECT user_id, source, node, MAX(value) AS value FROM sent{i} x WHERE NOT EXISTS (SELECT 1 FROM seen{i - 1} p WHERE p.user_id = x.user_id AND p.source = x.source AND p.node = x.node)
            GROUP BY user_id, source, node)""")
        ctes.append(f"seen{i} AS (SELECT * FROM seen{i - 1} UNION ALL SELECT user_id, source, node FROM s{i})")
    union = " UNION ALL ".join(f"SELECT * FROM sent{i}" for i in range(1, depth + 1))
    return "WITH " + ",\n".join(ctes) + f" SELECT user_id, source, node AS node_id, ROUND(SUM(value), 6) AS importance FROM ({union}) GROUP BY user_id, source, node"


# a factor below 0.71 leaves nothing above 0.01 after fourteen hops
@query("g_09", _importance_sql(14))
def g_09(t):
    # a long factor keeps products off the midpoints that the two roundings treat apart
    rows = G.spread_importance(strong(t), t.edges_v, factor=0.70710678)
    return rows.select("user_id", "source", "node_id", r6("importance").alias("importance"))


NAMED = "CAST(user_id AS VARCHAR) || '|' || node_id"


@query("g_10", f"""
    WITH RECURSIVE b AS MATERIALIZED ({BOTH}),
      walk AS (SELECT user_id, node_id AS source, node_id AS node FROM nodes_v UNION SELECT w.user_id, w.source, b.dst FROM walk w JOIN b ON b.user_id = w.user_id AND b.src = w.node)
    SELECT CAST(user_id AS VARCHAR) || '|' || source AS id, MIN(CAST(user_id AS VARCHAR) || '|' || node) AS component FROM walk GROUP BY user_id, source""")
def g_10(t):
    named = lambda c: F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col(c))
    return G.components(t.nodes_v, t.edges_v).select(named("node_id").alias("id"), named("component").alias("component"))


@query("g_11", reach_sql(BOTH, 1) + """
    SELECT e.user_id, a.source, COUNT(*) AS n_edges FROM edges_v e JOIN near a ON a.user_id = e.user_id AND a.node = e.src
      JOIN near b ON b.user_id = e.user_id AND b.node = e.dst AND b.source = a.source GROUP BY e.user_id, a.source""")
def g_11(t):
    _, inside = G.ego_graph(source_nodes(t), t.edges_v.select("user_id", "src", "dst"), 1)
    return inside.groupBy("user_id", "source").agg(F.count("*").alias("n_edges"))


@query("g_12", all_reach_sql(BOTH) + f""", b AS MATERIALIZED ({BOTH}), n AS (SELECT user_id, COUNT(*) AS n FROM nodes_v GROUP BY user_id), m AS (SELECT user_id, COUNT(*) AS m FROM edges_v GROUP BY user_id),
      deg AS (SELECT user_id, src AS node, COUNT(*) AS k FROM b GROUP BY user_id, src),
      tri AS (SELECT x.user_id, x.src AS node, COUNT(*) AS t FROM b x JOIN b y ON y.user_id = x.user_id AND y.src = x.src AND x.dst < y.dst JOIN b z ON z.user_id = x.user_id AND z.src = x.dst AND z.dst = y.dst GROUP BY x.user_id, x.src),
      cc AS (SELECT v.user_id, AVG(CASE WHEN k > 1 THEN 2.0 * COALESCE(t, 0) / (k * (k - 1)) ELSE 0.0 END) AS c FROM nodes_v v LEFT JOIN deg ON deg.user_id = v.user_id AND deg.node = v.node_id
        LEFT JOIN tri ON tri.user_id = v.user_id AND tri.node = v.node_id GROUP BY v.user_id),
      roots AS (SELECT user_id, source, MIN(node) AS root FROM near GROUP BY user_id, source),
      w AS (SELECT user_id, COUNT(DISTINCT root) AS parts FROM roots GROUP BY user_id),
      far AS (SELECT user_id, SUM(depth) AS total, COUNT(*) AS pairs FROM near WHERE depth > 0 GROUP BY user_id)
    SELECT n.user_id, n.n AS n_nodes, COALESCE(m.m, 0) AS n_edges, ROUND(CASE WHEN n.n > 1 THEN COALESCE(m.m, 0) / (n.n * (n.n - 1)) ELSE 0.0 END, 6) AS density, ROUND(cc.c, 6) AS avg_clustering,
      w.parts AS weak_components, ROUND(CASE WHEN n.n > 1 THEN 2.0 * COALESCE(m.m, 0) / (n.n * (n.n - 1)) ELSE 1.0 END, 6) AS avg_degree_centrality,
      ROUND(CASE WHEN w.parts = 1 AND n.n > 1 THEN far.total / far.pairs END, 6) AS avg_shortest_path
    FROM n LEFT JOIN m ON m.user_id = n.user_id JOIN cc ON cc.user_id = n.user_id JOIN w ON w.user_id = n.user_id LEFT JOIN far ON far.user_id = n.user_id""")
def g_12(t):
    s = G.statistics(t.nodes_v, t.edges_v)
    return s.select("user_id", "n_nodes", "n_edges", r6("density").alias("density"), r6("avg_clustering").alias("avg_clustering"), "weak_components",
                    r6("avg_degree_centrality").alias("avg_degree_centrality"), r6("avg_shortest_path").alias("avg_shortest_path"))


@query("g_13", reach_sql(BOTH, 2) + """
    SELECT n.user_id, n.source, n.node, n.depth FROM near n JOIN nodes_v v ON v.user_id = n.user_id AND v.node_id = n.node WHERE n.depth > 0 AND v.entity_type = 'project'""")
def g_13(t):
    return G.related_of_type(source_nodes(t), t.edges_v, t.nodes_v.select("user_id", "node_id", "entity_type")).select("user_id", "source", "node", "depth")


@query("g_14", reach_sql("SELECT user_id, dst AS src, src AS dst FROM edges_v", 2) + " SELECT user_id, source, node, depth FROM near WHERE depth > 0")
def g_14(t):
    return G.affected(source_nodes(t), t.edges_v, 2).select("user_id", "source", "node", "depth")


@query("g_15", reach_sql("SELECT * FROM edges_v WHERE type IN ('uses', 'depends_on', 'stores', 'deployed_to')", 3) + " SELECT user_id, source, node, depth FROM near WHERE depth > 0")
def g_15(t):
    return G.dependencies(source_nodes(t), t.edges_v, 3).select("user_id", "source", "node", "depth")


@query("g_16", all_reach_sql(BOTH) + f""", first AS ({FIRST})
    SELECT n.user_id, source, target, depth, depth AS n_hops FROM near n JOIN first f ON f.user_id = n.user_id AND f.target = n.node WHERE depth > 0""")
def g_16(t):
    hops = G.explain_paths(first_pairs(t), t.edges_v)
    return hops.groupBy("user_id", "source", "target", "depth").agg(F.count("relation").cast("int").alias("n_hops"))


@query("g_17", """
    SELECT user_id, src, dst, 'related_to' AS type, ROUND(CASE WHEN type = 'related_to' THEN LEAST(1.0, strength + 0.1) ELSE 0.5 END, 6) AS strength,
      CASE WHEN type = 'related_to' THEN evidence_count + 1 ELSE 1 END AS evidence_count FROM edges_v
    UNION ALL SELECT user_id, src, dst, type, ROUND(strength, 6), evidence_count FROM edges_v WHERE type <> 'related_to'""")
def g_17(t):
    new = t.edges_v.select("user_id", "src", "dst", F.lit("related_to").alias("type"), F.lit(0.5).alias("strength"))
    rows = G.upsert_edges(t.edges_v, new)
    return rows.select("user_id", "src", "dst", "type", r6("strength").alias("strength"), "evidence_count")


@query("g_18", """
    SELECT concept_id, retired OR (confidence <= 0.1 AND support_count <= 1 AND NOT has_links) AS retired,
      NOT retired AND confidence <= 0.1 AND support_count <= 1 AND NOT has_links AS pruned FROM concepts_v""")
def g_18(t):
    return G.prune_nodes(t.concepts_v, "support_count", F.col("has_links")).select("concept_id", "retired", "pruned")


@query("g_18_edges", """SELECT user_id, src, dst, ROUND(CASE WHEN evidence_count >= 2 AND strength < 0.95 THEN LEAST(1.0, strength + 0.05) ELSE strength END, 6) AS strength FROM edges_v""")
def g_18_edges(t):
    return G.strengthen_edges(t.edges_v).select("user_id", "src", "dst", r6("strength").alias("strength"))


@query("j_11", """
    SELECT user_id, src || ' blocks ' || dst AS blocker, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY strength DESC, src, dst) AS rank
      FROM edges_v WHERE type = 'blocks') WHERE rank <= 10""")
def j_11(t):
    from engram.plans.world import blockers
    return blockers(t.nodes_v, t.edges_v).select("user_id", "blocker", "rank")


@query("j_12", all_reach_sql("SELECT * FROM edges_v", "SELECT user_id, node_id FROM nodes_v WHERE entity_type = 'project'") + """
    , pairs AS (SELECT n.user_id, COUNT(*) AS aligned FROM near n JOIN nodes_v v ON v.user_id = n.user_id AND v.node_id = n.node AND v.entity_type = 'technology' GROUP BY n.user_id),
    sizes AS (SELECT user_id, SUM(CAST(entity_type = 'technology' AS INT)) * SUM(CAST(entity_type = 'project' AS INT)) AS total FROM nodes_v GROUP BY user_id)
    SELECT s.user_id, COALESCE(aligned, 0) AS aligned_pairs, CAST(total AS BIGINT) AS total_pairs, ROUND(CASE WHEN total > 0 THEN COALESCE(aligned, 0) / total ELSE 0.0 END, 6) AS alignment_score
    FROM sizes s LEFT JOIN pairs p ON p.user_id = s.user_id""")
def j_12(t):
    rows = I.goal_interest_alignment(t.nodes_v.withColumnRenamed("entity_type", "node_type"), t.edges_v, "technology", "project")
    return rows.select("user_id", "aligned_pairs", "total_pairs", r6("alignment_score").alias("alignment_score"))
