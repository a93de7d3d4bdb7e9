"""Intent score, levels and the simple engagement rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions.scalars import as_ts

# Points for the age of the last visit, in hours.
RECENCY_POINTS = [(24, 30), (72, 25), (168, 20), (336, 15), (720, 10)]
RECENCY_OLDER = 5

# Lowest score of each level, highest first.
LEVELS = [(80, "burning"), (60, "hot"), (40, "warm")]
HOT_SCORE = 60


def recency_points(last_visit: Column, as_of) -> Column:
    age_hours = (F.unix_micros(as_ts(as_of)) - F.unix_micros(last_visit)) / F.lit(3_600_000_000)
    out = F.when(last_visit.isNull(), F.lit(0))
    for hours, points in RECENCY_POINTS:
        out = out.when(age_hours <= hours, F.lit(points))
    return out.otherwise(F.lit(RECENCY_OLDER))


def engagement_points(pageviews: Column, active_seconds: Column, milestones: Column) -> Column:
    return F.least(F.lit(25.0), pageviews * F.lit(1.5) + active_seconds / F.lit(60.0)
                   + milestones.cast("double"))


def intent_score(last_visit: Column, sessions: Column, pageviews: Column,
                 active_seconds: Column, milestones: Column, pricing: Column,
                 case_studies: Column, products: Column, forms: Column,
                 videos: Column, as_of) -> Column:
    """Score 0-100 from five capped parts.

    Recency 0-30, frequency 4 per session up to 20, engagement up to 25,
    high-intent pages up to 25, conversions up to 20. The parts can reach 120,
    so the sum is capped too. One point is given per scroll milestone reached.
    """
    frequency = F.least(sessions * 4, F.lit(20))
    pages = F.least(pricing * 8 + case_studies * 5 + products * 4, F.lit(25))
    conversions = F.least(forms * 15 + videos * 5, F.lit(20))
    total = (recency_points(last_visit, as_of) + frequency + pages + conversions
             + engagement_points(pageviews, active_seconds, milestones))
    return F.round(F.least(F.lit(100.0), total), 2)


def level_of(score: Column) -> Column:
    out = None
    for floor, name in LEVELS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise("cold")


def engagement_rule(sessions: Column, pricing: Column, visited: Column) -> Column:
    """Level of a served profile; a coarser scale than the intent score's."""
    return (F.when((sessions >= 3) & pricing, "hot")
            .when((sessions >= 2) | pricing, "warm")
            .when(visited, "cold")
            .otherwise("new"))
