"""Registry of named queries: a Spark job and, where one exists, a check query.

Check queries are ANSI SQL over the sample tables. They are written from the
meaning of each operator, not from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.operators import enrich
from visitlens.plans.flows import with_devices
from visitlens.session import configure
from visitlens.sources import samples

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the sample tables have them."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return zoneless(fn(configure(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = samples.check_sql(sql)
        return run

    return register


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return samples.tracking_events(spark, folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Sample events with normalised type, category, path and devices."""
    from visitlens.functions import urls

    typed = enrich.typed(raw_events(spark, folder))
    return with_devices(typed).withColumn("path", urls.path(F.col("url")))


def load_all() -> None:
    """Import every module that registers queries."""
    from visitlens.plans import (  # noqa: F401
        behavior_queries, event_queries, identity_queries, profile_queries,
        source_queries, stream_queries)


def sql_hash32(text: str) -> str:
    """The 32-bit rolling hash in SQL, as base-36 text."""
    value = (f"list_reduce(list_prepend(0::bigint, list_transform(string_split({text}, ''),"
             " lambda c: unicode(c)::bigint)), lambda a, c:"
             " ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)")
    return (f"(select case when h < 0 then '-' else '' end || lower(to_base(abs(h), 36))"
            f" from (select {value} as h))")
