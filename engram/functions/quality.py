"""Health, entropy and quality columns (SC-58 … SC-70)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.text import clamp


def band_score(value: Column, low: float, high: float) -> Column:
    """1 inside the band, falling off linearly outside it (SC-58)."""
    width = max(high - low, 0.05)
    return (F.when(value.between(low, high), 1.0)
            .when(value < low, F.greatest(F.lit(0.0), 1.0 - (low - value) / width))
            .otherwise(F.greatest(F.lit(0.0), 1.0 - (value - high) / width)))


def health_score(duplicate: Column, archived: Column, forgotten: Column, strength: Column, entropy: Column,
                 graph: Column) -> Column:
    """Overall health out of 100 (SC-59)."""
    w = V.HEALTH_WEIGHTS
    raw = ((1 - duplicate) * w["duplicate"] + band_score(archived, 0.05, 0.40) * w["archive"]
           + band_score(forgotten, 0.0, 0.15) * w["forgotten"] + strength * w["strength"]
           + (1 - entropy) * w["entropy"] + graph * w["graph"])
    return clamp(raw * 100, 0.0, 100.0)


def entropy_score(redundancy: Column, conflicts: Column, fragmentation: Column, obsolete: Column) -> Column:
    w = V.ENTROPY_WEIGHTS
    return F.least(F.lit(1.0), redundancy * w["redundancy"] + conflicts * w["conflicts"]
                   + fragmentation * w["fragmentation"] + obsolete * w["obsolete"])


def coverage(required: Column, text: Column) -> Column:
    """Share of required topics that the lowered text touches (SC-65)."""
    def touched(c: Column) -> Column:
        return F.contains(text, F.translate(c, "_", " ")) | F.exists(F.split(c, "_"), lambda w: F.contains(text, w))
    return F.when(F.size(required) > 0, F.size(F.filter(required, touched)) / F.size(required)).otherwise(1.0)


def reasoning_quality(cover: Column, redundancy: Column, contradictions: Column, missing: Column) -> Column:
    return clamp(cover * 0.6 + (1 - redundancy) * 0.4 - F.least(F.lit(0.5), missing * 0.1)
                 - F.least(F.lit(0.5), contradictions * 0.1))


def non_contradiction(contradictions: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - contradictions * 0.15)


def context_quality(cover: Column, redundancy: Column, identity: Column, goal: Column, reasoning: Column,
                    contradictions: Column) -> Column:
    """Weighted quality of a composed context (SC-66)."""
    w = V.QUALITY_WEIGHTS
    return clamp(cover * w["coverage"] + (1 - redundancy) * w["non_redundancy"] + identity * w["identity_alignment"]
                 + goal * w["goal_alignment"] + reasoning * w["reasoning"]
                 + non_contradiction(contradictions) * w["non_contradiction"])


def importance_bucket(importance: Column) -> Column:
    """Five equal ranges (SC-69)."""
    return (F.when(importance < 0.2, "0.0-0.2").when(importance < 0.4, "0.2-0.4").when(importance < 0.6, "0.4-0.6")
            .when(importance < 0.8, "0.6-0.8").otherwise("0.8-1.0"))


def importance_level(importance: Column) -> Column:
    return F.when(importance >= 0.70, "high").when(importance >= 0.40, "medium").otherwise("low")


def merge_confidence(avg_similarity: Column, avg_importance: Column) -> Column:
    return clamp(F.coalesce(avg_similarity * 0.7 + avg_importance * 0.3, F.lit(0.0)))
