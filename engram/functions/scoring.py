"""Heuristic text scores as columns (SC-02 … SC-11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.text import clamp, contains_any, count_of, hits, lookup, n_words


@dataclass(frozen=True)
class Lexicon:
    """The word lists a scorer looks for; replace any of them for another corpus."""

    high: Sequence[str] = field(default_factory=lambda: V.HIGH_UTILITY)
    low: Sequence[str] = field(default_factory=lambda: V.LOW_IMPORTANCE)
    identity: Sequence[str] = field(default_factory=lambda: V.IDENTITY_WORDS)
    pronouns: Sequence[str] = field(default_factory=lambda: V.PRONOUN_MARKS)
    emotional: Sequence[str] = field(default_factory=lambda: V.EMOTIONAL_WORDS)
    persistence: Sequence[str] = field(default_factory=lambda: V.PERSISTENCE_WORDS)
    emphatic: Sequence[str] = field(default_factory=lambda: V.EMPHATIC_WORDS)


DEFAULT = Lexicon()


def type_base(memory_type: Column) -> Column:
    return lookup(memory_type, V.TYPE_BASE, 0.50)


def future_utility(content: Column, base: Column, lex: Lexicon = DEFAULT) -> Column:
    text = F.lower(content)
    size = F.when(F.length(text) > 200, 0.1).when(F.length(text) < 20, -0.1).otherwise(0.0)
    return clamp(base + F.least(F.lit(0.3), hits(text, lex.high) * 0.05)
                 - F.least(F.lit(0.2), hits(text, lex.low) * 0.03) + size)


def identity_impact(content: Column, base: Column, lex: Lexicon = DEFAULT) -> Column:
    text = F.lower(content)
    pronouns = F.lit(0)
    for mark in lex.pronouns:
        pronouns = pronouns + count_of(text, mark)
    return clamp(base + F.least(F.lit(0.35), hits(text, lex.identity) * 0.07)
                 + F.least(F.lit(0.15), pronouns * 0.03))


def emotional_salience(content: Column, base: Column, lex: Lexicon = DEFAULT, count_caps: bool = False) -> Column:
    """Shouted words count only with ``count_caps``; by default the text is lowered first."""
    text = F.lower(content)
    loud = count_of(text, "!")
    if count_caps:
        loud = loud + F.size(F.regexp_extract_all(content, F.lit(r"(?:^|\s)(\p{Lu}[\p{Lu}\p{N}]+)(?=\s|$)"), F.lit(1)))
    return clamp(base + F.least(F.lit(0.4), hits(text, lex.emotional) * 0.08) + F.least(F.lit(0.2), loud * 0.05))


def reinforcement(content: Column, base: Column, lex: Lexicon = DEFAULT) -> Column:
    text = F.lower(content)
    size = F.when(n_words(text) > 100, 0.15).when(n_words(text) < 15, -0.10).otherwise(0.0)
    return clamp(base + size + F.least(F.lit(0.15), hits(text, lex.emphatic) * 0.05))


def temporal_persistence(content: Column, base: Column, lex: Lexicon = DEFAULT) -> Column:
    text = F.lower(content)
    general = F.when((F.length(text) > 100) & (n_words(text) > 20), 0.1).otherwise(0.0)
    return clamp(base + F.least(F.lit(0.3), hits(text, lex.persistence) * 0.06) + general)


def weighted_importance(scores: Mapping[str, Column]) -> Column:
    total = None
    for name, weight in V.IMPORTANCE_WEIGHTS.items():
        part = scores[name] * weight
        total = part if total is None else total + part
    return clamp(total)


def heuristic_scores(content: Column, memory_type: Column, lex: Lexicon = DEFAULT) -> dict[str, Column]:
    """The five dimensions and the importance they weigh up to (SC-07)."""
    base = type_base(memory_type)
    scores = {
        "future_utility": future_utility(content, base, lex),
        "identity_impact": identity_impact(content, base, lex),
        "emotional_salience": emotional_salience(content, base, lex),
        "reinforcement": reinforcement(content, base, lex),
        "temporal_persistence": temporal_persistence(content, base, lex),
    }
    return {**scores, "importance": weighted_importance(scores)}


def blend(external: Mapping[str, Column], heuristic: Mapping[str, Column], share: float = 0.7) -> dict[str, Column]:
    """Mix externally supplied dimensions with heuristic ones and weigh again (SC-08)."""
    mixed = {n: F.coalesce(external[n], F.lit(0.5)) * share + heuristic[n] * (1 - share) for n in V.SCORE_NAMES}
    return {**{n: clamp(c) for n, c in mixed.items()}, "importance": weighted_importance(mixed)}


def initial_state(importance: Column) -> Column:
    return (F.when(importance >= 0.80, "active").when(importance >= 0.60, "reinforced")
            .when(importance >= 0.40, "semantic_candidate").when(importance >= 0.20, "dormant")
            .otherwise("decaying"))


def initial_decay_rate(importance: Column, memory_type: Column) -> Column:
    return lookup(memory_type, V.TYPE_DECAY, 0.05) * (1.0 - importance * 0.5)


def ingest_importance(content: Column, summary: Column, memory_type: Column,
                      high: Sequence[str] = V.INGEST_HIGH, low: Sequence[str] = V.INGEST_LOW,
                      marks: Sequence[Sequence[str]] = V.SPECIFICITY_MARKS) -> Column:
    """Importance of a row that came without one (SC-11)."""
    both = F.concat(F.lower(content), F.lit(" "), F.lower(F.coalesce(summary, F.lit(""))))
    n_high, n_low = hits(both, high), hits(both, low)
    keyword = F.when((n_high == 0) & (n_low == 0), 0.5).otherwise(clamp(0.3 + (n_high * 0.15 - n_low * 0.1)))
    length = F.length(content)
    size = F.when(length < 10, 0.2).when(length < 50, 0.6).when(length < 500, 0.9).otherwise(0.7)
    signs = (n_words(content) > 10).cast("int")
    for group in marks:
        signs = signs + contains_any(content, group).cast("int")
    specific = 0.5 + signs * 0.1
    return clamp(type_base(memory_type) * 0.4 + keyword * 0.3 + specific * 0.2 + size * 0.1)
