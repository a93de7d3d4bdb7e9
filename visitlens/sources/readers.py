"""Reading event batches, campaign leads, identities and stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens import schemas
from visitlens.functions.scalars import first_filled

# Header spellings accepted in a campaign lead file.
LEAD_HEADERS = {
    "email": ["email", "Email"],
    "first_name": ["firstName", "First Name", "first_name"],
    "last_name": ["lastName", "Last Name", "last_name"],
    "company": ["company", "Company"],
}


def parsed_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per accepted envelope, rejected ones), the last received of each batch.

    ``envelopes``: ``batch_id, body, request, received_at``. Accepted rows have ``events``,
    an array in sending order, beside ``request`` (see :data:`schemas.REQUEST`) and ``sent_at``.
    Copies are combined before the shuffle. A body whose ``events`` is no array is rejected.
    """
    place = F.struct("received_at", F.xxhash64("body"))
    one = (envelopes.groupBy("batch_id")
           .agg(F.max_by(F.struct("body", "request"), place).alias("_e"), F.max("received_at").alias("received_at"))
           .select("batch_id", "received_at", "_e.*"))
    # One row out of a generator, which no filter is pushed through: each body is parsed once.
    parsed = one.withColumn("_b", F.explode(F.array(F.from_json("body", schemas.EVENT_BATCH))))
    good = parsed.filter(F.col("_b.events").isNotNull()).select(
        "batch_id", "received_at", "request", F.timestamp_millis("_b.meta.sentAt").alias("sent_at"),
        F.col("_b.events").alias("events"))
    return good, parsed.filter(F.col("_b.events").isNull()).select(*envelopes.columns)


def unfolded_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per event of accepted envelopes: event fields, the request's fields, and a stable id.

    The id is a hash of batch and position, so a batch that is read again gives the same ids.
    """
    rows = envelopes.select(*[c for c in envelopes.columns if c not in ("events", "request")], "request",
                            F.posexplode("events").alias("pos", "_e"))
    return rows.select(
        F.xxhash64("batch_id", "pos").alias("event_id"),
        *[c for c in rows.columns if c not in ("request", "_e")], F.col("_e.type").alias("raw_type"),
        F.timestamp_millis("_e.timestamp").alias("ts"), F.col("_e.sessionId").alias("session_id"),
        F.col("_e.visitorId").alias("visitor_id"), F.col("_e.url").alias("url"),
        F.col("_e.referrer").alias("referrer"), F.col("_e.data").alias("data"), "request.*")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON lines of ``batch_id, body, request, received_at`` (milliseconds).

    A line without a batch id is named by the hash of its body.
    """
    rows = spark.read.schema(schemas.ENVELOPE).json(path)
    return rows.select(F.coalesce("batch_id", F.sha2("body", 256)).alias("batch_id"), "body", "request",
                       F.timestamp_millis("received_at").alias("received_at"))


def parse_event_batches(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split request bodies into (one row per event, rejected bodies).

    A body is rejected when its ``events`` is missing or no array. The position
    of an event in its batch is kept; later steps depend on "first event".
    """
    parsed = bodies.withColumn("_b", F.from_json(body, schemas.EVENT_BATCH))
    whole = F.col("_b.events").isNotNull()
    events = (parsed.filter(whole)
              .select(*[c for c in bodies.columns if c != body],
                      F.timestamp_millis("_b.meta.sentAt").alias("sent_at"),
                      F.posexplode("_b.events").alias("pos", "_e"))
              .select("*", F.col("_e.type").alias("raw_type"),
                      F.timestamp_millis("_e.timestamp").alias("ts"),
                      F.col("_e.sessionId").alias("session_id"),
                      F.col("_e.visitorId").alias("visitor_id"),
                      F.col("_e.url").alias("url"), F.col("_e.referrer").alias("referrer"),
                      F.col("_e.data").alias("data"))
              .drop("_e"))
    rejected = parsed.filter(F.col("_b.events").isNull()).select(*bodies.columns)
    return events, rejected


def read_event_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Event batches from files with one request body per line."""
    bodies = (spark.read.text(path).withColumnRenamed("value", "body")
              .withColumn("batch_id", F.sha2("body", 256)))
    return parse_event_batches(bodies)


def read_campaign_leads(spark: SparkSession, path: str) -> DataFrame:
    """Campaign leads from CSV with a header; several header spellings."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    out = []
    for name, spellings in LEAD_HEADERS.items():
        present = [df[f"`{s}`"] for s in dict.fromkeys(spellings) if s in df.columns]
        out.append((first_filled(*present) if present else F.lit(None).cast("string")).alias(name))
    # A blank line reads as a row of nulls.
    return df.select(*out).dropna(how="all")


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """Identity records: a JSON array per file."""
    df = spark.read.schema(schemas.IDENTITY).json(path, multiLine=True)
    return df.select(
        F.col("shortId").alias("short_id"), F.col("visitorId").alias("visitor_id"), "email",
        F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"), "company",
        F.col("campaignId").alias("campaign_id"), F.col("campaignName").alias("campaign_name"),
        F.col("sequenceStep").alias("sequence_step"),
        F.timestamp_millis("createdAt").alias("created_at"),
        F.timestamp_millis("expiresAt").alias("expires_at"))


@dataclass
class Scan:
    """A table read as the store's request language allows it."""
    equals: dict[str, object] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    is_null: list[str] = field(default_factory=list)
    at_least: dict[str, object] = field(default_factory=dict)
    within: dict[str, list] = field(default_factory=dict)
    any_equals: dict[str, object] = field(default_factory=dict)
    columns: list[str] | None = None
    order: list[Column] | None = None
    limit: int | None = None
    offset: int = 0


def scan_filtered(df: DataFrame, scan: Scan) -> DataFrame:
    """Filters (equality, null tests, lower bounds, IN, OR), projection, paging.

    Every test is a plain comparison with a literal, so on Parquet or JDBC it
    reaches the scan.
    """
    tests = ([F.col(c) == F.lit(v) for c, v in scan.equals.items()]
             + [F.col(c).isNotNull() for c in scan.not_null]
             + [F.col(c).isNull() for c in scan.is_null]
             + [F.col(c) >= (v if isinstance(v, Column) else F.lit(v))
                for c, v in scan.at_least.items()]
             + [F.col(c).isin(list(v)) for c, v in scan.within.items()])
    either = None
    for c, v in scan.any_equals.items():
        test = F.col(c) == F.lit(v)
        either = test if either is None else either | test
    if either is not None:
        tests.append(either)
    for test in tests:
        df = df.filter(test)
    if scan.order:
        df = df.orderBy(*scan.order)
    if scan.offset:
        df = df.offset(scan.offset)
    if scan.limit is not None:
        df = df.limit(scan.limit)
    return df.select(*scan.columns) if scan.columns else df
