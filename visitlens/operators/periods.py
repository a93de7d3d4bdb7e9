"""Time filters that also prune a table stored by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.scalars import as_ts


def before(as_of, **units: int) -> Column:
    """``as_of`` less some days, hours or minutes."""
    micros = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000}
    return F.timestamp_micros(F.unix_micros(as_ts(as_of)) - sum(
        n * micros[u] for u, n in units.items()))


def in_period(events: DataFrame, since=None, until=None) -> DataFrame:
    """Events from ``since`` to ``until``, both included.

    With an ``event_date`` column the days are tested too. ``since`` and
    ``until`` are constants, so the planner folds them and reads only those
    days of a table partitioned by it.
    """
    by_day = "event_date" in events.columns
    if since is not None:
        events = events.filter(F.col("ts") >= as_ts(since))
        if by_day:
            events = events.filter(F.col("event_date") >= F.to_date(as_ts(since)))
    if until is not None:
        events = events.filter(F.col("ts") <= as_ts(until))
        if by_day:
            events = events.filter(F.col("event_date") <= F.to_date(as_ts(until)))
    return events
