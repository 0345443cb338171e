"""Rounding, ratios, scores, levels and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caps and weights of the two scores, and the trend levels.
VELOCITY_CAPS = {"push": 100, "pull_request": 50, "developers": 10, "events_per_day": 20}
VELOCITY_WEIGHTS = {"push": 0.3, "pull_request": 0.4, "developers": 0.2, "events_per_day": 0.1}
HEALTH_CAPS = {"contributors": 50, "retention": 100, "events": 1000, "engagement": 100}
HEALTH_WEIGHTS = {"contributors": 0.3, "retention": 0.3, "events": 0.2, "engagement": 0.2}
TREND_LEVELS = [(20, "high"), (10, "medium"), (5, "low")]
TREND_DEFAULT = "stable"
HEALTHY = "🟢 HEALTHY"
UNHEALTHY = "🔴 UNHEALTHY"


def round2(x: Column) -> Column:
    """Two decimals, ties of the scaled value to even (SQL-side rounding)."""
    return F.rint(x * 100) / 100


def round2_exact(x: Column) -> Column:
    """Two decimals from the exact binary value, ties to even (score rounding)."""
    return F.call_function("format_number", x, F.lit("0.00")).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is 0."""
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))


def _weighted(parts: dict[str, Column], caps: dict[str, int], weights: dict[str, float]) -> Column:
    total = None
    for name, value in parts.items():
        term = F.least(value / caps[name], F.lit(1.0)) * weights[name]
        total = term if total is None else total + term
    return round2_exact(total * 100)


def velocity_score(
    push: Column, pull_request: Column, developers: Column, events_per_day: Column
) -> Column:
    parts = {
        "push": push,
        "pull_request": pull_request,
        "developers": developers,
        "events_per_day": events_per_day,
    }
    return _weighted(parts, VELOCITY_CAPS, VELOCITY_WEIGHTS)


def health_score(
    contributors: Column, retention: Column, events: Column, engagement: Column
) -> Column:
    parts = {
        "contributors": contributors,
        "retention": retention,
        "events": events,
        "engagement": engagement,
    }
    return _weighted(parts, HEALTH_CAPS, HEALTH_WEIGHTS)


def trend_level(score: Column) -> Column:
    level = F.lit(TREND_DEFAULT)
    for floor, name in reversed(TREND_LEVELS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def health_status(value: Column, threshold: Column) -> Column:
    """Unhealthy only when strictly above the threshold."""
    return F.when(value > threshold, UNHEALTHY).otherwise(HEALTHY)


def band(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """The colour of the highest step not above ``value``; steps ascend and the
    first one is the base colour."""
    colour = F.lit(steps[0][1])
    for floor, name in steps[1:]:
        colour = F.when(value >= floor, name).otherwise(colour)
    return F.when(value.isNotNull(), colour)


def distinct_count(column: Column, approx: bool = False) -> Column:
    """Distinct non-null values: exact, or a sketch with 1 % relative error."""
    return F.approx_count_distinct(column, 0.01) if approx else F.count_distinct(column)
