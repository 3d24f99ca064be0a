"""Traits: reinforcement, decay, relevance, profile (SC-60 … SC-64, W-09, J-12, J-13, A-16 … A-18, A-31, A-32)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions import text as T
from engram.functions.relevance import whole_days
from engram.operators.graph import reach
from engram.sources.store import top_per_group


# ---- scalar rules ------------------------------------------------------------
def reinforced_confidence(confidence: Column, boost: Column | float = 0.1, rate: float = 0.7) -> Column:
    """Confidence after one piece of evidence (SC-60)."""
    boost = F.lit(boost) if isinstance(boost, float) else boost
    return T.clamp(rate * (confidence + boost) + (1 - rate) * confidence)


def evidence_average(first: Column, later: Column, rate: float = 0.7) -> Column:
    """Running average over evidence in order, newest weighing ``rate`` (SC-60)."""
    return F.aggregate(later, first, lambda acc, x: T.clamp(rate * x + (1 - rate) * acc))


def trait_importance(node_type: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), confidence * T.lookup(node_type, V.TRAIT_TYPE_WEIGHT, 0.5))


def decay_traits(traits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(traits, history) after natural loss of confidence (SC-61)."""
    loss = whole_days(as_of, F.coalesce("last_reinforced_at", "created_at")) * F.col("decay_rate")
    df = traits.withColumns({"_loss": loss, "_old": F.col("confidence")})
    hit = F.col("_loss") > 0.01
    df = df.withColumn("confidence", F.when(hit, F.greatest(F.lit(0.0), F.col("_old") - F.col("_loss"))).otherwise(F.col("_old")))
    history = df.filter(hit).select(
        "user_id", "node_id", "node_type", "node_value", F.col("_old").alias("old_confidence"), F.col("confidence").alias("new_confidence"),
        (-F.col("_loss")).alias("confidence_delta"), F.lit("natural_decay").alias("change_reason"),
        F.when(F.col("confidence") < 0.2, "declined").otherwise("decayed").alias("event_type"), as_of.alias("created_at"))
    return df.select(*traits.columns), history


# ---- relevance and guidance ------------------------------------------------------
def trait_relevance(query: Column, node_type: Column, node_value: Column, confidence: Column,
                    words: Mapping[str, Sequence[str]] = V.TRAIT_QUERY_WORDS) -> Column:
    """0.7 for the value, 0.3 for a word of its type, times confidence (SC-62)."""
    q = F.lower(query)
    by_type = F.lit(False)
    for kind, terms in words.items():
        by_type = by_type | ((node_type == kind) & T.contains_any(q, terms))
    base = F.when(F.contains(q, F.lower(node_value)), 0.7).when(by_type, 0.3).otherwise(0.0)
    return base * confidence


def relevant_traits(queries: DataFrame, traits: DataFrame, limit: int = 5, considered: int = 20, min_confidence: float = 0.5,
                    words: Mapping[str, Sequence[str]] = V.TRAIT_QUERY_WORDS) -> DataFrame:
    """The traits that bear on a query, from the most important of its user (SC-62)."""
    top = top_per_group(traits.filter(F.col("confidence") >= min_confidence), ["user_id"],
                        [F.desc("importance"), F.col("node_id")], considered, "_i")
    both = queries.select("query_id", "user_id", "query").join(top, "user_id")
    scored = both.withColumn("relevance", trait_relevance(F.col("query"), F.col("node_type"), F.col("node_value"), F.col("confidence"), words))
    return top_per_group(scored.filter("relevance > 0"), ["query_id"], [F.desc(F.round("relevance", 12)), F.col("_i")], limit)


def concepts_by_identity(concepts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Concept confidence raised for each chosen trait in its name or text (SC-63).

    ``chosen`` comes from ``relevant_traits``, at most a few rows per query.
    """
    values = chosen.groupBy("query_id", "user_id").agg(F.array_sort(F.collect_set(F.lower("node_value"))).alias("values"))
    name, text = F.lower("concept_name"), F.lower(F.coalesce("description", F.lit("")))
    factor = F.aggregate("values", F.lit(1.0), lambda a, v: a * F.when(F.contains(name, v), 1.2).when(F.contains(text, v), 1.1).otherwise(1.0))
    return concepts.join(values, "user_id").withColumn("relevance_to_identity", F.col("confidence") * factor).drop("values")


def communication_style(traits: DataFrame, min_confidence: float = 0.4) -> DataFrame:
    """Most confident way of talking per user, and the others (SC-64)."""
    rows = traits.filter((F.col("node_type") == "communication") & (F.col("confidence") >= min_confidence))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "node_id", "node_value")))
    per = rows.groupBy("user_id").agg(ordered.alias("_o"))
    return per.select("user_id", F.get("_o", F.lit(0))["node_value"].alias("primary_style"),
                      F.transform("_o", lambda s: s["node_value"]).alias("style_traits"), (-F.get("_o", F.lit(0))["c"]).alias("style_confidence"))


def instructions(primary: Column, behaviours: Column, styles: Mapping[str, str] = V.STYLE_INSTRUCTIONS,
                 by_trait: Mapping[str, str] = V.TRAIT_INSTRUCTIONS) -> Column:
    """How to phrase an answer (SC-64). ``behaviours`` is the array of chosen behaviour values."""
    style = T.lookup(primary, styles, "")
    pairs = F.create_map(*[F.lit(x) for kv in by_trait.items() for x in kv]) if by_trait else F.create_map().cast("map<string,string>")
    told = F.filter(F.transform(behaviours, lambda b: pairs[b]), lambda s: s.isNotNull())
    both = F.filter(F.concat(F.array(style), told), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.when(F.size(both) > 0, F.array_join(both, " ")).otherwise(V.DEFAULT_INSTRUCTION)


def routing_hint(types: Column) -> Column:
    return (F.when(F.array_contains(types, "goal"), "goal_aligned").when(F.array_contains(types, "interest"), "interest_relevant")
            .when(F.array_contains(types, "skill"), "skill_development").otherwise("general"))


def skill_level(avg_confidence: Column) -> Column:
    return (F.when(avg_confidence.isNull(), "unknown").when(avg_confidence >= 0.8, "expert").when(avg_confidence >= 0.6, "advanced")
            .when(avg_confidence >= 0.4, "intermediate").otherwise("novice"))


# ---- relations among traits --------------------------------------------------------
def goal_interest_alignment(nodes: DataFrame, edges: DataFrame, goal: str = "goal", interest: str = "interest", max_depth: int | None = None) -> DataFrame:
    """Share of (interest, goal) pairs with a path from interest to goal (J-12).

    Pairs are counted from group sizes; only connected ones are formed.
    """
    starts = nodes.filter(F.col("node_type") == interest).select("user_id", "node_id")
    goals = nodes.filter(F.col("node_type") == goal).select("user_id", F.col("node_id").alias("node"))
    hit = reach(starts, edges, max_depth, ends=goals).groupBy("user_id").agg(F.count("*").alias("aligned_pairs"))
    total = nodes.groupBy("user_id").agg((F.count_if(F.col("node_type") == goal) * F.count_if(F.col("node_type") == interest)).alias("total_pairs"))
    df = total.join(hit, "user_id", "left").withColumn("aligned_pairs", F.coalesce("aligned_pairs", F.lit(0)))
    return df.withColumn("alignment_score", F.when(F.col("total_pairs") > 0, F.col("aligned_pairs") / F.col("total_pairs")).otherwise(0.0))


def value_conflicts(traits: DataFrame, opposing: Sequence[tuple[str, str]] = V.OPPOSING_VALUES, min_confidence: float = 0.6) -> DataFrame:
    """Opposing values a user holds strongly (J-13). One row per user and pair."""
    best = traits.filter(F.col("confidence") >= min_confidence).groupBy("user_id", "node_value").agg(F.max("confidence").alias("c"))
    sides = [(i, side, v) for i, pair in enumerate(opposing) for side, v in enumerate(pair)]
    tagged = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side"), F.lit(v).alias("v")) for i, s, v in sides])
    rows = best.select("user_id", "node_value", "c", F.explode(F.filter(tagged, lambda x: x["v"] == F.col("node_value"))).alias("x"))
    per = rows.groupBy("user_id", "x.pair").agg(
        F.max(F.when(F.col("x.side") == 0, F.col("node_value"))).alias("trait1"), F.max(F.when(F.col("x.side") == 1, F.col("node_value"))).alias("trait2"),
        F.max(F.when(F.col("x.side") == 0, F.col("c"))).alias("confidence1"), F.max(F.when(F.col("x.side") == 1, F.col("c"))).alias("confidence2"))
    return per.filter("trait1 IS NOT NULL AND trait2 IS NOT NULL").drop("pair").withColumn("conflict_level", F.least("confidence1", "confidence2"))


def identity_shifts(traits: DataFrame, as_of: Column, days: int = 30, types: Sequence[str] = ("interest", "trait", "skill")) -> DataFrame:
    """Users whose recent traits now outweigh the established one (W-09)."""
    since = as_of - F.make_dt_interval(F.lit(days))
    recent = F.coalesce(F.col("last_reinforced_at") >= since, F.lit(False)) | F.coalesce(F.col("created_at") >= since, F.lit(False))
    rows = traits.filter(F.col("node_type").isin(*types)).withColumn("_recent", recent)
    confidence, importance = F.coalesce("confidence", F.lit(0.0)), F.coalesce("importance", F.lit(0.0))
    evidence = F.coalesce(F.when(F.col("evidence_count") != 0, F.col("evidence_count")), F.lit(1))
    item = F.struct("node_id", "node_value", "confidence")
    old_key = F.struct(F.round(importance * confidence, 12).alias("w"), (-F.col("node_id")).alias("i"))
    new_key = F.struct(F.round(confidence * evidence, 12).alias("w"), (-F.col("node_id")).alias("i"))
    per = rows.groupBy("user_id").agg(
        F.count_if("_recent").alias("n_recent"),
        F.max_by(item, F.when(~F.col("_recent"), old_key)).alias("old"), F.max_by(item, F.when(F.col("_recent"), new_key)).alias("new"),
        F.count_if(~F.col("_recent")).alias("_n_old"))
    hit = per.filter((F.col("n_recent") >= V.IDENTITY_SHIFT_MIN_RECENT) & (F.col("_n_old") > 0) & (F.col("new.confidence") >= V.IDENTITY_SHIFT_CONFIDENCE))
    return hit.select("user_id", F.col("new.node_id").alias("node_id"), F.col("old.node_value").alias("old_identity"),
                      F.col("new.node_value").alias("new_identity"), F.col("new.confidence").alias("confidence"), "n_recent")


def apply_shifts(traits: DataFrame, shifts: DataFrame, as_of: Column) -> DataFrame:
    """The new leading trait gains importance; nothing else changes."""
    df = traits.join(shifts.select("node_id", F.lit(True).alias("_shift")), "node_id", "left")
    known = F.coalesce(F.when(F.col("importance") != 0, F.col("importance")), F.lit(0.5))
    return df.withColumns({"importance": F.when(F.col("_shift"), F.least(F.lit(1.0), known + 0.15)).otherwise(F.col("importance")),
                           "last_reinforced_at": F.when(F.col("_shift"), as_of).otherwise(F.col("last_reinforced_at"))}).drop("_shift")


# ---- statistics and profile ----------------------------------------------------------
def reinforcement_stats(traits: DataFrame, history: DataFrame) -> DataFrame:
    base = traits.groupBy("user_id").agg(
        F.count("*").alias("total_traits"), F.sum("reinforcement_count").alias("total_reinforcements"),
        F.avg("confidence").alias("avg_confidence"), F.avg("evidence_count").alias("avg_evidence_per_trait"))
    seen = history.groupBy("user_id").agg(F.count_if(F.col("event_type") == "reinforced").alias("reinforced_events"),
                                          F.count_if(F.col("event_type") == "decayed").alias("decayed_events"))
    return base.join(seen, "user_id", "left").fillna(0, ["reinforced_events", "decayed_events"])


def upper_median(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The element at index n // 2 of the sorted values, by position rather than by collecting them (A-17)."""
    keys = list(keys)
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"_upto": upto, "_n": total})
    return ranked.filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def confidence_summary(traits: DataFrame) -> DataFrame:
    base = traits.groupBy("user_id").agg(
        F.avg("confidence").alias("average_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.count("*").alias("total_traits"), F.sum("reinforcement_count").alias("total_reinforcements"),
        F.avg("reinforcement_count").alias("avg_reinforcements_per_trait"))
    return base.join(upper_median(traits, ["user_id"], "confidence").withColumnRenamed("median", "median_confidence"), "user_id")


def evolution_metrics(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """How confidences moved lately (A-18)."""
    rows = history.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    moved = F.when(F.col("confidence_delta") != 0, F.col("confidence_delta"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("confidence_delta") > 0.1).alias("increased"),
        F.count_if(F.col("confidence_delta") < -0.1).alias("decreased"), F.count_distinct("node_value").alias("traits_changed"), F.avg(moved).alias("avg_delta"))


def identity_status(traits: DataFrame, strong: float = 0.7) -> DataFrame:
    return traits.groupBy("user_id").agg(F.count("*").alias("node_count"), F.count_if(F.col("confidence") >= strong).alias("high_confidence"),
                                         F.avg("confidence").alias("mean_confidence"), F.max("last_reinforced_at").alias("last_update"))




def profile(traits: DataFrame, min_confidence: float = 0.5, per_category: int | None = None) -> DataFrame:
    """One row per user and type with its trait structs, most important first (A-31).

    ``per_category`` keeps the leading rows where a report shows only those.
    """
    rows = traits.filter((F.col("confidence") >= min_confidence) & F.col("node_type").isin(*V.TRAIT_CATEGORIES.values()))
    if per_category is not None:
        rows = top_per_group(rows, ["user_id", "node_type"], [F.desc("importance"), F.col("node_id")], per_category, "_r")
    item = F.struct((-F.col("importance")).alias("k"), "node_id", F.col("node_value").alias("value"), "confidence", "importance")
    return rows.groupBy("user_id", "node_type").agg(F.array_sort(F.collect_list(item)).alias("items"))


def profile_text(traits: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One-sentence-per-section summary per user (A-32)."""
    lists = profile(traits, min_confidence)
    per = lists.groupBy("user_id").pivot("node_type", list(V.TRAIT_CATEGORIES.values())).agg(F.first("items"))

    def names(kind: str, start: int, n: int | None) -> Column:
        some = F.slice(F.col(kind), start, n) if n else F.col(kind)
        return F.array_join(F.transform(some, lambda s: T.title(s["value"])), ", ")

    def part(kind: str, prefix: str, suffix: str, n: int | None, start: int = 1, at_least: int = 1) -> Column:
        return F.when(F.size(kind) >= at_least, F.concat(F.lit(prefix), names(kind, start, n), F.lit(suffix)))

    text = F.concat_ws(". ", part("goal", "Working towards: ", "", 1), part("goal", "Also interested in: ", "", 2, 2, 2),
                       part("interest", "Passionate about: ", "", 3), part("behavior", "Core traits: ", "", 2),
                       part("communication", "Prefers ", " communication", None), part("skill", "Skilled in: ", "", 3))
    return per.select("user_id", F.concat(text, F.lit(".")).alias("summary"))


def evolution_narrative(history: DataFrame, newest: int = 50, min_change: float = 0.15) -> DataFrame:
    """What emerged, strengthened and faded among the newest events (A-32)."""
    rows = top_per_group(history, ["user_id"], [F.desc("ts"), F.desc("event_id")], newest)
    big = F.abs("confidence_delta") >= min_change

    def named(*events: str) -> Column:
        hit = F.when(big & F.col("event_type").isin(*events), F.struct("rank", "node_value"))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["node_value"])

    per = rows.groupBy("user_id").agg(named("emerged").alias("emerged"), named("reinforced").alias("reinforced"),
                                      named("declined", "decayed").alias("declined"), F.count("*").alias("total_changes"))

    def part(c: str, prefix: str, n: int) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(c, 1, n), ", ")))

    text = F.concat_ws(". ", part("emerged", "Recent interests: ", 3), part("reinforced", "Strengthening: ", 3), part("declined", "Shifting away from: ", 2))
    return per.withColumn("narrative", F.when(text != "", text).otherwise("Identity remains stable."))


def skill_tiers(traits: DataFrame, min_confidence: float = 0.4) -> DataFrame:
    """Skills by proficiency, counted per tier with the average level (A-31)."""
    rows = traits.filter((F.col("node_type") == "skill") & (F.col("confidence") >= min_confidence))
    c = F.col("confidence")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_skills"), F.count_if(c >= 0.8).alias("expert"), F.count_if((c >= 0.6) & (c < 0.8)).alias("intermediate"),
        F.count_if(c < 0.6).alias("learning"), F.avg(c).alias("_avg")).withColumn("skill_level", skill_level(F.col("_avg"))).drop("_avg")
