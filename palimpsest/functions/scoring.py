"""Scores of memories as column expressions. Times are seconds or days as named; ``now`` is always given by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, to the microsecond; null if either is."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def ltp(epistemic: Column, pragmatic: Column, accesses: Column, age_days: Column, floor: float = 0.0, decay: float = 0.01) -> Column:
    """Long-term strength: worth times log of use, decaying exponentially with age. Unbounded above."""
    return F.greatest(F.lit(floor), (epistemic + pragmatic) / 2) * F.log1p(accesses) * F.exp(-decay * age_days)


def recency(hours_since_access: Column, hours_since_creation: Column) -> Column:
    """A week of access and a month of age, linear, weighted 7 to 3."""
    return 0.7 * F.greatest(F.lit(0.0), 1 - hours_since_access / 168) + 0.3 * F.greatest(F.lit(0.0), 1 - hours_since_creation / 720)


def importance(epistemic: Column, pragmatic: Column, accesses: Column, stability: Column) -> Column:
    bonus = F.least(F.lit(0.3), 0.1 * F.log1p(accesses)) + F.least(F.lit(0.2), 0.1 * (stability - 1))
    return F.least(F.lit(1.0), (epistemic + pragmatic) / 2 + bonus)


def tier_score(strength: Column, recent: Column, important: Column) -> Column:
    return 0.6 * strength + 0.25 * recent + 0.15 * important


def stability(accesses: Column) -> Column:
    return 1 + 0.5 * F.log1p(accesses)


def retention(days: Column, stable: Column) -> Column:
    """Forgetting curve: what is left after ``days`` at a stability of so many days."""
    return F.exp(-days / F.greatest(stable, F.lit(0.01)))


def days_until(target: float, stable: Column) -> Column:
    """Days after which retention has sunk to ``target``."""
    return -stable * F.log(F.lit(target))


def temporal_proximity(seconds_apart: Column, hours: float = 24.0) -> Column:
    return F.when(seconds_apart.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(seconds_apart) / (hours * 3600)))


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def beta_std(a: Column, b: Column) -> Column:
    return F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def beta_ucb(a: Column, b: Column, z: float = 1.65) -> Column:
    return F.least(F.lit(1.0), beta_mean(a, b) + z * beta_std(a, b))


def half_life(value: Column, days: Column, half_life_days: float) -> Column:
    return value * F.pow(F.lit(2.0), -days / half_life_days)


def recency_half_life(hours: Column, half_life_hours: float, floor: float = 0.1) -> Column:
    return F.greatest(F.lit(floor), F.pow(F.lit(2.0), -hours / half_life_hours))


def freshness(hours: Column) -> Column:
    """Exponential with a half-life of a week."""
    return F.exp(-0.693 * hours / 168)


def synaptic_boost(strength_sum: Column) -> Column:
    return 1 + F.least(F.log1p(strength_sum), F.lit(9.0))


def chrono_weight(score: Column, seconds: Column, rate: float = 1e-6) -> Column:
    return score / (1 + rate * seconds)


def salience(valence: Column, arousal: Column) -> Column:
    inside = lambda c, low: F.least(F.lit(1.0), F.greatest(F.lit(low), c))
    return F.abs(inside(valence, -1.0)) * inside(arousal, 0.0)


def health(recent: Column, frequent: Column, stable: Column, weights: tuple[float, float, float] = (0.35, 0.35, 0.30)) -> Column:
    return weights[0] * recent + weights[1] * frequent + weights[2] * stable


def gap_priority(recent: Column, frequent: Column, confidence: Column) -> Column:
    return 0.5 * recent + 0.3 * frequent + 0.2 * (1 - confidence)


def sm2_easiness(easiness: Column, quality: Column) -> Column:
    miss = 5 - quality
    return F.greatest(F.lit(1.3), easiness + 0.1 - miss * (0.08 + miss * 0.02))


def sm2_interval(repetitions: Column, previous: Column, easiness: Column, quality: Column) -> Column:
    """Days to the next review: a failed one starts over."""
    return F.when(quality < 3, 1).when(repetitions <= 0, 1).when(repetitions == 1, 6).otherwise(F.round(previous * easiness).cast("int"))


def review_action(kept: Column, salient: Column) -> Column:
    return F.when(kept <= 0.10, "evict").when((kept <= 0.40) & (salient >= 0.5), "boost").when(kept <= 0.40, "review").otherwise("consolidate")


def confidence_level(value: Column, contradicted: Column, stale: Column) -> Column:
    return F.when(contradicted, "contradicted").when(stale, "stale").when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def backoff(attempt: Column, base: float = 1.0, cap: float = 3600.0) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def tier_boost(score: Column, tier: Column) -> Column:
    """Hits of the hot tier count a tenth more, of the cold a tenth less, at most 1."""
    return F.least(F.lit(1.0), score * F.when(tier == "hot", 1.1).when(tier == "cold", 0.9).otherwise(1.0))


def tier_of(score: Column, hot: float = 0.7, warm: float = 0.35) -> Column:
    return F.when(score >= hot, "hot").when(score >= warm, "warm").otherwise("cold")
