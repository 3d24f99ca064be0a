"""World model: projects, active context, timeline (P-08, P-10 … P-12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.text import strings
from engram.operators import extract as X
from engram.session import cut
from engram.sources.store import top_per_group


def recently_active(nodes: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Newest ten tasks and fifteen surest technologies seen in the window (W-08)."""
    recent = nodes.filter(F.col("last_seen_at") >= as_of - F.make_dt_interval(F.lit(days)))
    tasks = top_per_group(recent.filter("entity_type = 'task'"), ["user_id"],
                          [F.desc("last_seen_at"), F.desc("confidence"), F.col("node_id")], 10)
    tech = top_per_group(recent.filter("entity_type = 'technology'"), ["user_id"],
                         [F.desc("confidence"), F.col("node_id")], 15)
    return tasks.unionByName(tech)


def blockers(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Strongest blocking relations with both names (J-11)."""
    top = top_per_group(edges.filter(F.col("type") == "blocks"), ["user_id"], [F.desc("strength"), F.col("src"), F.col("dst")], n)
    src = nodes.select("user_id", F.col("node_id").alias("src"), F.col("name").alias("_s"))
    dst = nodes.select("user_id", F.col("node_id").alias("dst"), F.col("name").alias("_d"))
    return (top.join(src, ["user_id", "src"]).join(dst, ["user_id", "dst"])
            .withColumn("blocker", F.concat("_s", F.lit(" blocks "), "_d")).drop("_s", "_d"))


def timeline_past(decisions: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """Decisions and started tasks, newest first (SET-01)."""
    made = decisions.select("user_id", F.lit("decision").alias("type"), F.col("decision").alias("label"), "reason", "status",
                            F.col("ts").alias("timestamp"), F.col("decision_id").cast("string").alias("_k"))
    tasks = nodes.filter("entity_type = 'task'").select("user_id", F.lit("task_started").alias("type"), F.col("name").alias("label"),
                                                        F.col("first_seen_at").alias("timestamp"), F.col("node_id").cast("string").alias("_k"))
    both = made.unionByName(tasks, allowMissingColumns=True)
    return top_per_group(both, ["user_id"], [F.desc("timestamp"), F.col("type"), F.col("label"), F.col("_k")], limit).drop("_k")


def timeline_present(projects: DataFrame) -> DataFrame:
    return projects.filter("status = 'active'").select("user_id", F.lit("project").alias("type"), F.col("project_name").alias("label"),
                                                       "current_phase", "status", "updated_at")


def timeline_future(projects: DataFrame) -> DataFrame:
    """Next steps and roadmap items of a user's projects (SET-02)."""
    steps = projects.filter("next_step IS NOT NULL").select("user_id", F.lit("next_step").alias("type"), F.col("project_name").alias("project"), F.col("next_step").alias("label"))
    road = projects.select("user_id", F.lit("roadmap_item").alias("type"), F.col("project_name").alias("project"), F.explode("roadmap").alias("label"))
    return steps.unionByName(road)


# ---- P-08: world model from texts ---------------------------------------------------
@dataclass
class World:
    """Entities, relations, projects and decisions found in texts."""

    mentions: DataFrame
    entities: DataFrame
    relations: DataFrame
    edges: DataFrame
    projects: DataFrame
    decisions: DataFrame

    def counts(self) -> DataFrame:
        """Nodes by type per user (A-27)."""
        return self.entities.groupBy("user_id", "entity_type").agg(F.count("*").alias("n"))


def world_model(texts: DataFrame, vocabulary=V.ENTITY_VOCABULARY, rules=V.ENTITY_RULES, verbs=V.RELATION_VERBS, decisions=V.DECISION_PATTERNS,
                reason: str = V.REASON_PATTERN, project: dict | None = None, flags: str = X.UNICODE, verb_flags: str = X.ANY_CASE) -> World:
    """Extract the world model of all users from their texts (P-08).

    Mentions feed every later stage, so they are written out once.
    """
    mentions = cut(X.entities(texts, vocabulary, rules, flags))
    found = X.relations(texts, mentions, verbs, verb_flags)
    return World(mentions, X.entity_rollup(mentions), found, X.relation_rollup(found), X.projects(texts, mentions, **(project or {})),
                 X.decisions(texts, decisions, reason))


# ---- P-10: what a user is on right now -----------------------------------------------
def active_context(projects: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Current project, priorities, blockers, open tasks and technology per user (P-10)."""
    current = projects.filter("status = 'active'").groupBy("user_id").agg(
        F.max_by(F.struct("project_id", "project_name", "current_phase", "next_step"), F.struct("updated_at", "project_id")).alias("p"))
    seen = recently_active(nodes, as_of, days)
    item = F.struct("rank", "name")

    def named(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_type") == kind, item))), lambda s: s["name"])

    lists = seen.groupBy("user_id").agg(named("task").alias("tasks"), named("technology").alias("technology"))
    stops = blockers(nodes, edges).groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocker"))), lambda s: s["blocker"]).alias("blockers"))
    users = projects.select("user_id").unionByName(nodes.select("user_id")).distinct()
    none = F.array().cast("array<string>")
    df = users.join(current, "user_id", "left").join(lists, "user_id", "left").join(stops, "user_id", "left")
    return df.select("user_id", F.col("p.project_id").alias("project_id"), F.col("p.project_name").alias("project_name"), F.col("p.current_phase").alias("current_phase"),
                     F.array_compact(F.array("p.next_step")).alias("priorities"), *[F.coalesce(c, none).alias(c) for c in ("blockers", "tasks", "technology")])


# ---- P-11: what a project needs next ---------------------------------------------------
def stack_gaps(stack: Column, expectations=V.STACK_EXPECTATIONS, limit: int = 5) -> Column:
    """Practices a stack calls for and does not name."""
    low = F.transform(stack, F.lower)
    parts = [F.when(F.arrays_overlap(low, strings(triggers)), strings(topics)).otherwise(strings([])) for triggers, topics in expectations]
    return F.slice(F.filter(F.array_distinct(F.concat(*parts)), lambda topic: ~F.exists(low, lambda t: F.contains(t, topic))), 1, limit)


def predict_projects(projects: DataFrame, decisions: DataFrame, depends: DataFrame | None = None, expectations=V.STACK_EXPECTATIONS) -> DataFrame:
    """Next task, missing knowledge, dependencies and confidence per project (P-11).

    ``projects`` carries next_step, roadmap, tech_stack, open_questions; ``depends`` (project_id, name).
    """
    later = decisions.filter("status = 'postponed'").groupBy("project_id").agg(F.max_by("decision", F.struct("ts", "decision_id")).alias("_later"))
    df = projects.join(later, "project_id", "left").withColumns({
        "likely_next_task": F.coalesce("next_step", F.get("roadmap", F.lit(0)), "_later"),
        "missing_knowledge": stack_gaps(F.coalesce("tech_stack", strings([])), expectations),
        "likely_blockers": F.slice(F.coalesce("open_questions", strings([])), 1, 3)})
    if depends is not None:
        df = df.join(depends.groupBy("project_id").agg(F.array_sort(F.collect_set("name")).alias("dependencies")), "project_id", "left")
    score = 0.5 + F.when(F.col("likely_next_task").isNotNull(), 0.2).otherwise(0.0) + F.when(F.size("missing_knowledge") > 0, 0.15).otherwise(0.0)
    docs = F.transform(F.slice("missing_knowledge", 1, 3), lambda t: F.when(F.contains(t, F.lit("documentation")), t).otherwise(F.concat(t, F.lit(" documentation"))))
    return df.withColumns({"documentation_needed": docs, "confidence": F.least(F.lit(1.0), score)}).drop("_later")
