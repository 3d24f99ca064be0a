"""Entities, relations, projects, decisions and patterns from texts (EX-01 … EX-08).

Texts come as (user_id, text_id, ts, text).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.text import lookup

UNICODE = "(?U)"
ANY_CASE = "(?iU)"


def vocabulary_entities(texts: DataFrame, vocabulary: Mapping[str, Mapping[str, str]] = V.ENTITY_VOCABULARY,
                        confidence: float = V.VOCABULARY_CONFIDENCE) -> DataFrame:
    """Known names found in a text as substrings, under their canonical spelling (EX-01)."""
    low = F.lower("text")
    found = [F.when(F.contains(low, F.lit(word)), F.struct(F.lit(kind).alias("entity_type"), F.lit(name).alias("name"), F.lit(i).alias("pos")))
             for i, (kind, word, name) in enumerate((k, w, n) for k, words in vocabulary.items() for w, n in words.items())]
    rows = texts.select("user_id", "text_id", "ts", F.explode(F.array_compact(F.array(*found))).alias("e"))
    return (rows.groupBy("user_id", "text_id", "ts", "e.entity_type", F.lower("e.name").alias("key"))
            .agg(F.min_by("e.name", "e.pos").alias("name"), F.min("e.pos").cast("long").alias("pos"))
            .withColumn("confidence", F.lit(confidence)))


def _matches(text: Column, pattern: str, flags: str) -> Column:
    """The first filled group of every match, in order."""
    groups = re.compile(re.sub(r"\\p\{\w+\}", "x", pattern)).groups
    arrays = [F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(g)) for g in range(1, groups + 1)]
    out = arrays[0]
    for other in arrays[1:]:
        out = F.zip_with(out, other, lambda a, b: F.when(a != "", a).otherwise(b))
    return out


def _tidy(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[.,;:]+$", "")


def _at(rule: int, match: Column) -> Column:
    """Order of detection: rule by rule, match by match."""
    return (F.lit(rule) * F.lit(1 << 40) + match).cast("long")


def entities(texts: DataFrame, vocabulary: Mapping[str, Mapping[str, str]] = V.ENTITY_VOCABULARY,
             rules: Sequence[tuple[str, str, float]] = V.ENTITY_RULES, flags: str = UNICODE) -> DataFrame:
    """Entities of each text, one row per type and name, in order of detection (EX-01, EX-02).

    A name the vocabulary already placed is not labelled again by a pattern.
    """
    known = vocabulary_entities(texts, vocabulary)
    def by_pattern(n: int, kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(_matches(F.col("text"), pattern, flags), lambda m, j: F.struct(
            F.lit(kind).alias("entity_type"), _tidy(m).alias("name"), F.lit(confidence).alias("confidence"), _at(n + 1, j).alias("pos")))

    parts = [by_pattern(i, *rule) for i, rule in enumerate(rules)]
    rows = texts.select("user_id", "text_id", "ts", F.explode(F.concat(*parts)).alias("e")).filter(F.length("e.name") >= 2)
    by_rule = rows.groupBy("user_id", "text_id", "ts", "e.entity_type", F.lower("e.name").alias("key")).agg(
        F.min_by("e.name", "e.pos").alias("name"), F.min("e.pos").alias("pos"), F.min_by("e.confidence", "e.pos").alias("confidence"))
    fresh = by_rule.join(known.select("text_id", "key"), ["text_id", "key"], "left_anti")
    return known.unionByName(fresh)


def entity_rollup(mentions: DataFrame, step: float = 0.05) -> DataFrame:
    """One node per user, type and name: first confidence plus a step per further text (EX-03).

    Mentions themselves are the evidence table; a frequent entity has too many for an array.
    """
    order = F.struct("ts", "text_id")
    n = F.count("*")
    return mentions.groupBy("user_id", "entity_type", "key").agg(
        F.min_by("name", order).alias("name"), F.least(F.lit(1.0), F.min_by("confidence", order) + step * (n - 1)).alias("confidence"),
        n.alias("mention_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))


def relations(texts: DataFrame, mentions: DataFrame, verbs: Sequence[tuple[str, Sequence[str]]] = V.RELATION_VERBS,
              flags: str = ANY_CASE, verb_confidence: float = 0.7, near_confidence: float = 0.4) -> DataFrame:
    """Relations between entities of one text, from the earlier to the later mention (EX-04).

    For every entity the nearest verb of each type after it and the end of its sentence are
    found once. A pair then only compares positions, and the join keeps those pairs alone
    that a verb or a shared sentence connects.
    """
    at = (mentions.select("text_id", "entity_type", "key", "name").join(texts.select("user_id", "text_id", "ts", F.lower("text").alias("low")), "text_id")
          .withColumn("pos", F.instr(F.col("low"), F.col("key"))).filter("pos > 0"))
    rest = F.expr("substring(low, pos)")
    far = F.lit(1 << 30)

    def after(pattern: str) -> Column:
        """Where the next match ends, counted in the whole text."""
        start = F.regexp_instr(rest, F.lit(flags + pattern))
        return F.when(start > 0, F.col("pos") + start - 1 + F.length(F.regexp_substr(rest, F.lit(flags + pattern)))).otherwise(far)

    ends = F.array(*[F.least(far, *[after(p) for p in patterns]) for _, patterns in verbs])
    stop = F.regexp_instr(rest, F.lit(r"[.\n]"))
    sources = at.select("user_id", "text_id", "ts", F.col("entity_type").alias("src_type"), F.col("key").alias("src"), "pos", ends.alias("ends"),
                        F.when(stop > 0, F.col("pos") + stop - 1).otherwise(far).alias("stop"))
    sources = sources.withColumn("first_end", F.array_min("ends"))
    targets = at.select("text_id", F.col("entity_type").alias("dst_type"), F.col("key").alias("dst"), F.col("pos").alias("to"))
    pairs = sources.join(targets, "text_id").filter((F.col("pos") < F.col("to")) & ((F.col("first_end") <= F.col("to")) | (F.col("stop") >= F.col("to"))))
    reached = F.array_position(F.transform("ends", lambda e: e <= F.col("to")), F.lit(True))
    kinds = {str(i + 1): kind for i, (kind, _) in enumerate(verbs)}
    kind = F.when(F.col("first_end") <= F.col("to"), lookup(reached.cast("string"), kinds, "")).otherwise("related_to")
    return pairs.select("user_id", "text_id", "ts", "src_type", "src", "dst_type", "dst", kind.alias("type"),
                        F.when(F.col("first_end") <= F.col("to"), verb_confidence).otherwise(near_confidence).alias("confidence"))


def relation_rollup(found: DataFrame, step: float = 0.05) -> DataFrame:
    """One edge per user, ends and type; strength grows with repeats (EX-05)."""
    n = F.count("*")
    return found.groupBy("user_id", "src_type", "src", "dst_type", "dst", "type").agg(
        n.alias("evidence_count"), F.least(F.lit(1.0), F.min_by("confidence", F.struct("ts", "text_id")) + step * (n - 1)).alias("strength"))


def project_fields(text: Column, phase: str = V.PHASE_PATTERN, next_step: str = V.NEXT_STEP_PATTERN,
                   status: Sequence[tuple[str, Sequence[str]]] = V.STATUS_PATTERNS) -> dict[str, Column]:
    def first(pattern: str) -> Column:
        found = F.trim(F.regexp_extract(text, pattern, 1))
        return F.when(found != "", found)

    state = None
    for name, any_of in status:
        hit = F.lower(text).rlike("|".join(any_of))
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return {"current_phase": first(phase), "next_step": first(next_step), "status": state}


def projects(texts: DataFrame, mentions: DataFrame, **patterns) -> DataFrame:
    """Project records: the last text that says something about a field decides it (EX-06).

    Technologies come from a fixed vocabulary, so their set stays small.
    """
    fields = project_fields(F.col("text"), **patterns)
    said = texts.select("text_id", *[c.alias(n) for n, c in fields.items()])
    tech = mentions.filter("entity_type = 'technology'").groupBy("text_id").agg(F.collect_set("name").alias("_tech"))
    rows = mentions.filter("entity_type = 'project'").join(said, "text_id").join(tech, "text_id", "left")
    order = F.struct("ts", "text_id")
    return rows.groupBy("user_id", "key").agg(
        F.min_by("name", order).alias("project_name"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), order)).alias(n) for n in fields],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("_tech", F.array().cast("array<string>")))))).alias("tech_stack"),
        F.max("ts").alias("updated_at")).withColumn("status", F.coalesce("status", F.lit("active")))


def decisions(texts: DataFrame, patterns: Sequence[tuple[str, str]] = V.DECISION_PATTERNS, reason: str = V.REASON_PATTERN,
              flags: str = "(?i)") -> DataFrame:
    """Decision statements, once per text and wording, with the reason the text gives (EX-07)."""
    def by_pattern(n: int, status: str, pattern: str) -> Column:
        return F.transform(_matches(F.col("text"), pattern, flags), lambda m, j: F.struct(
            _tidy(m).alias("decision"), F.lit(status).alias("status"), _at(n, j).alias("pos")))

    parts = [by_pattern(i, *rule) for i, rule in enumerate(patterns)]
    why = F.trim(F.regexp_extract("text", reason, 1))
    rows = texts.select("user_id", "text_id", "ts", F.when(why != "", why).alias("reason"), F.explode(F.concat(*parts)).alias("d")).filter(F.col("d.decision") != "")
    return (rows.groupBy("user_id", "text_id", "ts", "reason", F.lower("d.decision").alias("_k"))
            .agg(F.min_by("d.decision", "d.pos").alias("decision"), F.min_by("d.status", "d.pos").alias("status"), F.min("d.pos").alias("pos")).drop("_k")
            .withColumn("confidence", F.lit(0.7)))


def discover_patterns(memories: DataFrame, concepts: DataFrame, known_traits: DataFrame,
                      patterns: Sequence[tuple[str, Sequence[str], int]] = V.HIGHER_ORDER_PATTERNS,
                      min_evidence: float = V.PATTERN_MIN_EVIDENCE) -> DataFrame:
    """Higher-order traits a user's texts add up to and that are not known yet (EX-08).

    Each keyword becomes one boolean maximum per user, combined before the shuffle; no text is
    ever concatenated.
    """
    text = F.lower(F.concat_ws(" ", F.translate(F.coalesce("concept_name", F.lit("")), "_", " "), "description"))
    rows = (memories.filter(~F.col("cognitive_state").isin(*V.INACTIVE_STATES)).select("user_id", F.lower("content").alias("t"))
            .unionByName(concepts.select("user_id", text.alias("t"))))
    words = list(dict.fromkeys(w for _, ws, _ in patterns for w in ws))
    seen = rows.groupBy("user_id").agg(*[F.max(F.contains("t", F.lit(w))).alias(f"k{i}") for i, w in enumerate(words)])
    found = []
    for trait, ws, need in patterns:
        matched = F.array_compact(F.array(*[F.when(F.col(f"k{words.index(w)}"), F.lit(w)) for w in ws]))
        score = F.least(F.lit(1.0), F.size(matched) / len(ws) + 0.2)
        found.append(F.when((F.size(matched) >= need) & (score >= min_evidence), F.struct(
            F.lit(trait).alias("node_value"), score.alias("confidence"), matched.alias("matched_keywords"))))
    out = seen.select("user_id", F.explode(F.array_compact(F.array(*found))).alias("p")).select("user_id", "p.*")
    return out.join(known_traits.select("user_id", "node_value"), ["user_id", "node_value"], "left_anti")


def supporting_concepts(patterns: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts that name a matched keyword of a discovered trait (J-18)."""
    rows = patterns.select("user_id", "node_value", F.explode("matched_keywords").alias("w"))
    hit = F.contains(F.lower("concept_name"), F.col("w")) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.col("w"))
    return rows.join(concepts.select("user_id", "concept_id", "concept_name", "description"), "user_id").filter(hit).select("user_id", "node_value", "concept_id").distinct()
