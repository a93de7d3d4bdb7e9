"""Audience conditions over profile tables, and exported variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.scalars import filled


def _as_number(text: str) -> float | None:
    """Leading number of a text, as a browser reads it; None without one."""
    import re

    found = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", text)
    return float(found.group(0)) if found else None


def condition(df: DataFrame, text: str | None) -> Column:
    """Boolean column of a condition: ``field>number``, ``field=value``, ``field``.

    ``>`` is looked for before ``=``, so ``score>=50`` compares with ``=50``,
    which is no number, and is never true. ``=`` compares as text, quotes
    included. A bare field is true unless null, false, zero or empty. An
    unknown field is false.
    """
    never = F.lit(False)
    if not text:
        return never
    types = {f.name: f.dataType for f in df.schema.fields}
    if ">" in text:
        name, value = [p for p in text.split(">")][:2]
        name, bound = name.strip(), _as_number(value)
        numeric = isinstance(types.get(name), T.NumericType)
        if not numeric or bound is None:
            return never
        return F.coalesce(F.col(name) > F.lit(bound), never)
    if "=" in text:
        name, value = [p for p in text.split("=")][:2]
        name, value = name.strip(), value.strip()
        if name not in types:
            return F.lit(value == "undefined")
        return F.coalesce(_shown(F.col(name), types[name]), F.lit("null")) == F.lit(value)
    if text not in types:
        return never
    return truthy(F.col(text), types[text])


def _shown(c: Column, kind: T.DataType) -> Column:
    """A value as text; whole numbers have no decimal point."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def truthy(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    if isinstance(kind, T.StringType):
        return filled(c).isNotNull()
    return c.isNotNull()


def audience_filter(profiles: DataFrame, text: str | None) -> DataFrame:
    return profiles.filter(condition(profiles, text))


def audience_assignment(profiles: DataFrame, audiences: dict[str, str], key: str) -> DataFrame:
    """``key, audience`` for every audience a profile is in, in one pass."""
    tests = [F.when(condition(profiles, text), F.lit(name)) for name, text in audiences.items()]
    return profiles.select(key, F.explode(F.array_compact(F.array(*tests))).alias("audience"))


# Variables handed on, with the profile column of each; text ones when filled, others when known.
TEXT_VARIABLES = {
    "first_name": "first_name", "last_name": "last_name", "person_name": "person_name", "email": "email",
    "phone": "phone", "linkedin": "linkedin_url", "company": "company_name", "company_name": "company_name",
    "company_description": "company_description", "company_size": "company_headcount",
    "revenue": "company_revenue", "industry": "company_industry", "company_website": "company_website",
    "company_linkedin": "company_linkedin", "domain": "domain", "job_title": "job_title",
    "seniority": "job_seniority", "department": "job_department", "campaign_id": "campaign_id",
    "campaign_name": "campaign_name", "engagement_level": "engagement_level", "visitor_id": "visitor_id",
}
OTHER_VARIABLES = {
    "intent_score": "intent_score", "total_visits": "total_sessions", "total_pageviews": "total_pageviews",
    "is_first_visit": "is_first_visit", "viewed_pricing": "viewed_pricing", "submitted_form": "submitted_form",
}


def export_variables(profiles: DataFrame, key: str, absent: tuple[str, ...] = ()) -> DataFrame:
    """Profile as a map of its known variables.

    A table must have every column a variable comes from, or name it in ``absent``. Campaign id and name
    come from the latest of ``campaigns`` (JSON) where the table has that instead.
    """
    types = {f.name: f.dataType for f in profiles.schema.fields}
    latest = ["campaign_id", "campaign_name"] if "campaigns" in types else []
    missing = {c for c in {**TEXT_VARIABLES, **OTHER_VARIABLES}.values()
               if c not in types and c not in latest and c not in absent}
    if missing:
        raise ValueError(f"profiles lack {sorted(missing)}")
    pairs: list[Column] = []
    for name, column in {**TEXT_VARIABLES, **OTHER_VARIABLES}.items():
        if column in types:
            value = _shown(F.col(column), types[column])
        elif column in latest:
            value = F.get_json_object("campaigns", f"$[0].{column}")
        else:
            continue
        pairs += [F.lit(name), filled(value) if name in TEXT_VARIABLES else value]
    return profiles.select(key, F.map_filter(
        F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("variables"))
