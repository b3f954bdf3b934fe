"""Scores of memories as Column expressions with an explicit "now"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(at: Column, now: Column, micros: int) -> Column:
    """Whole units of time from `at` to `now`, toward zero."""
    d = F.unix_micros(now) - F.unix_micros(at)
    return (d - d % micros) / F.lit(float(micros))


def hours_since(at: Column, now: Column) -> Column:
    return _whole(at, now, 3_600_000_000)


def days_since(at: Column, now: Column) -> Column:
    return _whole(at, now, 86_400_000_000)


def recency(last_accessed: Column, now: Column) -> Column:
    return F.exp(-hours_since(last_accessed, now) / F.lit(168.0))


def relevance(strength: Column, last_accessed: Column, access_count: Column, now: Column) -> Column:
    """Strength, recency and frequency; an item never accessed is at minus infinity."""
    frequency = F.when(access_count > 0, F.ln(access_count.cast("double"))).otherwise(F.lit(float("-inf")))
    return F.lit(0.5) * strength + F.lit(0.3) * recency(last_accessed, now) + F.lit(0.2) * frequency / 10


def _stability(access_count: Column, strength: Column) -> Column:
    times = F.when(access_count > 0, F.greatest(F.ln(access_count.cast("double")), F.lit(1.0))).otherwise(F.lit(1.0))
    return times * strength


def decay(strength: Column, access_count: Column, last_accessed: Column, created_at: Column, now: Column) -> Column:
    """What is left by the forgetting curve, 0.1 at least; items older than a week keep longer."""
    days = hours_since(last_accessed, now) / F.lit(24.0)
    s = _stability(access_count, strength) * F.when(days_since(created_at, now) > 7, 1.2).otherwise(1.0)
    return F.when(s == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), F.exp(F.try_divide(F.lit(-0.1) * days, s))))


def review_hours(strength: Column, access_count: Column) -> Column:
    """Hours until retention falls to 0.7, one at least."""
    return F.greatest(F.lit(1.0), -_stability(access_count, strength) * F.ln(F.lit(0.7)) / F.lit(0.1) * 24)


def needs_review(strength: Column, access_count: Column, last_accessed: Column, created_at: Column, now: Column) -> Column:
    return (decay(strength, access_count, last_accessed, created_at, now) < 0.7) & (strength > 0.3)


def consolidates(emotion: Column, strength: Column, access_count: Column, strong: float = 0.6, often: int = 3) -> Column:
    return (emotion != "Neutral") | (strength >= strong) | (access_count >= often)


def felt(strength: Column, emotion: Column) -> Column:
    """Strength of an item with an emotion."""
    return F.when(emotion != "Neutral", F.least(F.lit(1.0), strength * 1.5)).otherwise(strength)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def visual_decay(strength: Column, valence: Column, recalls: Column, rate: float) -> Column:
    """Linear decay; strong feelings and recalls slow it down."""
    return F.greatest(F.lit(0.0), strength - F.lit(rate) * (1 - 0.3 * F.abs(valence)) * (1 / (1 + 0.1 * recalls)))


def risk(strength: Column, access_count: Column, last_accessed: Column, now: Column) -> Column:
    """Of forgetting, from 0 to 1."""
    return F.least(F.lit(1.0), days_since(last_accessed, now) / F.lit(30.0) * 0.4 + (1 - strength) * 0.4 + 1 / (access_count + F.lit(1.0)) * 0.2)


def urgency(risk: Column) -> Column:
    return F.when(risk > 0.7, "High").when(risk > 0.5, "Medium").when(risk > 0.3, "Low")


def confidence(success: Column, failure: Column) -> Column:
    n = success + failure
    return F.when(n == 0, F.lit(0.5)).otherwise(F.try_divide(success.cast("double"), n))


def importance(novelty: Column, valence: Column, rarity: Column) -> Column:
    return clamp(0.5 + 0.25 * novelty + 0.2 * F.abs(valence) + 0.05 * rarity, 0.3, 1.0)
