"""Decay, state transitions, reinforcement and forgetting as columns (SC-41 … SC-57)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram import vocab as V
from engram.functions.relevance import DAY
from engram.functions.text import clamp, lookup


def anchor(last_accessed: Column, created_at: Column) -> Column:
    return F.coalesce(last_accessed, created_at)


def base_decay(memory_type: Column, importance: Column) -> Column:
    trivial = (memory_type == "episodic") & (F.coalesce(importance, F.lit(0.5)) < V.EPISODIC_LOW_IMPORTANCE)
    return F.when(trivial, V.EPISODIC_LOW_DECAY).otherwise(lookup(memory_type, V.BASE_DECAY, V.FALLBACK_DECAY))


def effective_decay(memory_type: Column, importance: Column, age_seconds: Column, retrievals: Column,
                    reinforcement: Column, emotional: Column, in_concept: Column, in_identity: Column) -> Column:
    """Base rate shaped by age, use, membership, importance and emotion (SC-42)."""
    age_days = F.greatest(F.lit(0.0), F.coalesce(age_seconds, F.lit(0.0)) / DAY)
    membership = F.when(in_identity, 0.5).otherwise(1.0) * F.when(in_concept, 0.7).otherwise(1.0)
    rate = (base_decay(memory_type, importance)
            * F.least(F.lit(2.0), 1.0 + age_days / 365.0)
            * (1.0 / (1.0 + F.log1p(F.coalesce(retrievals, F.lit(0)))))
            * (1.0 - F.coalesce(reinforcement, F.lit(0.5)) * 0.6)
            * membership
            * (1.0 - F.coalesce(importance, F.lit(0.5)) * 0.5)
            * (1.0 - F.coalesce(emotional, F.lit(0.5)) * 0.3))
    return clamp(rate, 0.0001, 1.0)


def decayed(strength: Column, rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(strength, F.lit(0.5)) * (1.0 - rate))


def decayed_steps(strength: Column, rate: Column, steps: Column | int) -> Column:
    """Several decay periods at once; each period floors at zero (SC-48)."""
    n = F.lit(steps) if isinstance(steps, int) else steps
    return F.when(n > 0, F.greatest(F.lit(0.0), strength * F.pow(F.greatest(F.lit(0.0), 1.0 - rate), n))).otherwise(strength)


def state_on_access(state: Column, strength: Column) -> tuple[Column, Column]:
    """(new state, new strength) of a row that was just read (SC-45)."""
    asleep = state.isin("dormant", "decaying", "archived")
    woken = F.when(strength >= 0.70, "active").when(strength >= 0.50, "reinforced").otherwise("dormant")
    return (F.when(asleep, woken).otherwise(state),
            F.when(asleep, F.least(F.lit(1.0), strength + 0.1)).otherwise(strength))


def state_on_reinforcement(state: Column, strength: Column, count: Column) -> Column:
    return (F.when((count >= 5) & (strength >= 0.70), "semantic_candidate")
            .when((count >= 3) & (strength >= 0.75), "active")
            .when((count >= 2) & (strength >= 0.65), "reinforced").otherwise(state))


def state_by_idle_days(state: Column, idle: Column) -> Column:
    """Time-driven demotion, one step at most."""
    return (F.when(state.isin("active", "reinforced") & (idle > 30), "dormant")
            .when((state == "dormant") & (idle > 60), "decaying")
            .when((state == "decaying") & (idle > 90), "archived").otherwise(state))


def time_decay(state: Column, strength: Column, rate: Column, idle: Column) -> tuple[Column, Column]:
    """(new state, new strength) with a demotion penalty, or one decay period (SC-47)."""
    new_state = state_by_idle_days(state, idle)
    penalty = lookup(state, {"active": 0.9, "reinforced": 0.85, "dormant": 0.8, "decaying": 0.7}, 1.0)
    return new_state, F.when(new_state != state, strength * penalty).otherwise(
        F.greatest(F.lit(0.0), strength * (1.0 - rate)))


def transition_allowed(state: Column, target: Column) -> Column:
    allowed = F.lit(False)
    for source, targets in V.TRANSITIONS.items():
        allowed = allowed | ((state == source) & target.isin(*targets))
    return F.coalesce(allowed, F.lit(False))


def transition(state: Column, strength: Column, target: Column) -> tuple[Column, Column, Column]:
    """(success, new state, new strength) of a requested move (SC-49)."""
    ok = transition_allowed(state, target)
    moved = clamp(strength + lookup(target, V.TRANSITION_STRENGTH, 0.0))
    return ok, F.when(ok, target).otherwise(state), F.when(ok, moved).otherwise(strength)


def after_decay(state: Column, strength: Column, idle: Column) -> tuple[Column, Column]:
    """State by idle days without a further strength loss; long archival forgets (SC-50)."""
    stepped = state_by_idle_days(state, idle)
    gone = (stepped == "archived") & (idle > V.IDLE_DAYS["archived"])
    return (F.when(gone, "forgotten").otherwise(stepped),
            F.when(gone, F.greatest(F.lit(0.0), F.coalesce(strength, F.lit(0.0)) * 0.5)).otherwise(strength))


def forgetting_decision(state: Column, strength: Column, age_days: Column) -> tuple[Column, Column]:
    """(decision, confidence) for an already decayed row (SC-51)."""
    s = F.coalesce(strength, F.lit(0.5))
    put_away = state.isin(*V.INACTIVE_STATES)
    forget = (state == "archived") & (s <= V.FORGET_AT) & (age_days >= V.FORGET_MIN_DAYS)
    weak = ~put_away & (s <= V.ARCHIVE_AT)
    fading = ~put_away & (s > V.ARCHIVE_AT) & (s <= V.WEAKEN_AT)
    decision = (F.when(forget, "Forgotten")
                .when(weak, F.when(transition_allowed(state, F.lit("archived")), "Archived").otherwise("Remain"))
                .when(fading, "Weaken").otherwise("Remain"))
    confidence = (F.when(forget, F.least(F.lit(1.0), (1.0 - s) + (age_days / 365.0) * 0.1))
                  .when(weak, F.least(F.lit(1.0), 1.0 - s)).when(fading, 0.6)
                  .otherwise(1.0 - F.abs(s - 0.7)))
    return decision, confidence


def reinforced_state(strength: Column, count: Column) -> Column:
    return (F.when((strength >= 0.85) & (count >= 3), "active")
            .when((strength >= 0.70) & (count >= 2), "reinforced")
            .when((count >= 5) & (strength >= 0.60), "semantic_candidate")
            .when(strength < 0.30, "decaying")
            .when(count >= 4, "semantic_candidate").otherwise("reinforced"))


def reinforce(strength: Column, count: Column, rate: Column, boost: Column | float = 0.1) -> dict[str, Column]:
    """New strength, count, decay rate and state of a reinforced row (SC-52)."""
    boost = F.lit(boost) if isinstance(boost, float) else boost
    new_strength, new_count = F.least(F.lit(1.0), strength + boost), count + 1
    return {"memory_strength": new_strength, "reinforcement_count": new_count,
            "decay_rate": F.greatest(F.lit(0.0), rate * 0.8),
            "cognitive_state": reinforced_state(new_strength, new_count)}


def revive(strength: Column) -> tuple[Column, Column]:
    """(new state, new strength) of a revived row (SC-55)."""
    known = F.when(strength != 0, strength).otherwise(0.3)
    new_strength = F.least(F.lit(1.0), known + V.REVIVE_BOOST)
    return F.when(new_strength >= 0.70, "active").otherwise("reinforced"), new_strength


def resolution_score(recency: Column, reinforcement: Column, strength: Column) -> Column:
    """Which of two conflicting rows wins (SC-56)."""
    return (recency * 0.40 + F.coalesce(reinforcement, F.lit(0.5)) * 0.35
            + F.coalesce(strength, F.lit(0.5)) * 0.25)


def replay_priority(importance: Column, prediction_confidence: Column, strength: Column, count: Column,
                    recent_identity: Column, conflicting: Column) -> Column:
    """How much a row deserves to be looked at again (SC-57)."""
    known = F.coalesce(F.when(prediction_confidence != 0, prediction_confidence),
                       F.when(strength != 0, strength), F.lit(0.5))
    return (F.coalesce(importance, F.lit(0.5)) * 0.35 + (1.0 - known) * 0.25
            + F.when(recent_identity, 0.3).otherwise(0.0) + F.when(conflicting, 0.3).otherwise(0.0)
            + F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / 10.0) * 0.20)


